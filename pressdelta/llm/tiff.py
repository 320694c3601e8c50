"""TIFF columns: one row per page.

`pages` walks the image directories of each stored file, decodes strips or tiles (none, PackBits, LZW, deflate), undoes the horizontal
predictor and emits a row per page, with running digests over the pages of a file, so that a file is told whole without being put
together again.  `encode` writes bytes as 8-bit grey pages of a fixed width.

Defined cases: a null file gives one row with page null and the error "null"; a file that cannot be read gives the pages before the fault and
one row with page null and the error; directories that run in a circle end at the first repeat; an empty table gives no rows; columns other than the
key and the file are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pressdelta.llm.common import pieces

# fixed values of the format
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
TYPE_SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8), 13: ("I", 4)}


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    depth: int
    compression: int
    samples: np.ndarray


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        end = i + 1
        while end < len(data) and end - i < 128 and not (data[end : end + 1] * 3 == data[end : end + 3]):
            end += 1
        out.append(end - i - 1)
        out += data[i:end]
        i = end
    return bytes(out)


def _codes(data: bytes) -> Iterator[tuple[int, callable]]:
    """Reader of codes, most significant bit first."""
    at = 0
    def read(bits: int) -> int:
        nonlocal at
        first = at >> 3
        value = int.from_bytes(data[first : first + 4].ljust(4, b"\0"), "big") >> (32 - bits - (at & 7))
        at += bits
        return value & ((1 << bits) - 1) if at <= 8 * len(data) else 257
    return read


def unpack_lzw(data: bytes) -> bytes:
    read, out, strings, bits, last = _codes(data), [], [], 9, b""
    while (code := read(bits)) != 257:
        if code == 256:
            strings, bits, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not strings:
            raise ValueError("LZW data without a start")
        if code < len(strings):
            now = strings[code]
        elif code == len(strings) and last:
            now = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(now)
        if last:
            strings.append(last + now[:1])
        last = now
        # the width grows one code early
        bits = min(12, max(9, (len(strings) + 1).bit_length()))
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    value = count = 0
    table, bits, last = {bytes((i,)): i for i in range(256)}, 9, b""
    def put(code: int) -> None:
        nonlocal value, count
        value, count = value << bits | code, count + bits
    put(256)
    size = 258
    for b in data:
        now = last + bytes((b,))
        if now in table:
            last = now
            continue
        put(table[last])
        table[now] = size
        size += 1
        bits = min(12, max(9, size.bit_length()))
        if size > 4093:
            put(256)
            table, bits, size = {bytes((i,)): i for i in range(256)}, 9, 258
        last = bytes((b,))
    if last:
        put(table[last])
        size += 1
        bits = min(12, max(9, size.bit_length()))
    put(257)
    return (value << (-count % 8)).to_bytes((count + 7) // 8, "big")


def unpack(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return unpack_lzw(data)
    raise ValueError(f"compression {compression}")


def pack(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 6)
    return {NONE: bytes, PACKBITS: pack_bits, LZW: pack_lzw}[compression](data)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of every image directory, in the order of the chain."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack_from(order + "I", data, 4), set()
    while at and at not in seen:
        seen.add(at)
        (n,), tags = struct.unpack_from(order + "H", data, at), {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TYPE_SIZES:
                letter, size = TYPE_SIZES[kind]
                place = at + 10 + 12 * i if count * size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, place)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def walk(data: bytes) -> Iterator[Page]:
    """The pages of a file."""
    for order, tags in directories(data):
        one = lambda tag, other: tags.get(tag, (other,))[0]
        width, height, spp, bits, compression = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, NONE)
        if bits not in (8, 16):
            raise ValueError(f"{bits} bits per sample")
        kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
        separate = one(PLANAR, 1) == 2
        planes, depth = (spp, 1) if separate else (1, spp)
        tiled = TILE_OFFSETS in tags
        block_w, block_h = (one(TILE_WIDTH, width), one(TILE_HEIGHT, height)) if tiled else (width, min(height, one(STRIP_ROWS, height)))
        offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
        across, down = -(-width // block_w) if width else 0, -(-height // block_h) if height else 0
        image = np.zeros((planes, height, width, depth), kind)
        for k in range(planes * across * down):
            plane, rest = divmod(k, across * down)
            y, x = rest // across * block_h, rest % across * block_w
            rows = block_h if tiled else min(block_h, height - y)
            block = np.frombuffer(unpack(data[offsets[k] : offsets[k] + sizes[k]], compression), kind, rows * block_w * depth).reshape(rows, block_w, depth)
            if one(PREDICTOR, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            part = image[plane, y : y + rows, x : x + block_w]
            part[...] = block[: part.shape[0], : part.shape[1]]
        samples = np.moveaxis(image, 0, 2).reshape(height, width, spp) if separate else image[0]
        yield Page(width, height, bits, compression, samples)


def encode(payload: bytes, width: int = 64, page_rows: int = 1024, strip_rows: int = 256, compression: int = DEFLATE, predictor: int = 2, tile: int = 0, order: str = "<") -> bytes:
    """Grey 8-bit pages of `width` columns holding `payload` row by row; its length is a multiple of `width`.  `tile` > 0 writes square tiles."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), 4
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        if tile:
            blocks = [np.pad(b, ((0, tile - b.shape[0]), (0, tile - b.shape[1]))) for y in range(0, len(page), tile) for x in range(0, width, tile) for b in [page[y : y + tile, x : x + tile]]]
        else:
            blocks = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        offsets, sizes = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            packed = pack(b.tobytes(), compression)
            offsets.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) % 2)
        tags = {WIDTH: (3, [width]), HEIGHT: (4, [len(page)]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])}
        tags |= {TILE_WIDTH: (3, [tile]), TILE_HEIGHT: (3, [tile]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, sizes)} if tile else {STRIP_OFFSETS: (4, offsets), STRIP_ROWS: (4, [strip_rows]), STRIP_BYTES: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{TYPE_SIZES[kind][0]}", *values)
            if len(raw) > 4:
                place = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


class Reading:
    """Running digests over the samples of a file's pages."""

    def __init__(self) -> None:
        self.sha, self.size, self.tail, self.total, self.squares, self.edges = hashlib.sha256(), 0, b"", 0, 0, 0
        self.bins = np.zeros(16, np.int64)

    def add(self, page: Page) -> bytes:
        raw = page.samples.tobytes()
        self.sha.update(raw)
        self.size += len(raw)
        self.tail = (self.tail + raw[-64:])[-64:]
        flat = page.samples.astype(np.int64, copy=False)
        self.total += int(flat.sum())
        self.squares += int(np.square(flat).sum())
        self.edges += int(np.abs(np.diff(flat, axis=1)).sum())
        self.bins += np.bincount(page.samples.reshape(-1) >> (page.depth - 4), minlength=16)
        return raw

    def feature(self) -> str:
        """Mean, variance and mean horizontal step in thousandths (whole numbers), and the histogram in 16 bins."""
        n = max(1, self.size)
        return f"mean={1000 * self.total // n};var={1000 * (n * self.squares - self.total**2) // n**2};step={1000 * self.edges // n};bins=" + ",".join(map(str, self.bins.tolist()))


def form_of(raw: bytes) -> dict:
    """How a text is stored, by its checksum: mostly deflate, an eighth LZW, a sixteenth each PackBits and plain; a quarter in tiles, half
    with a predictor, half in either byte order."""
    h = zlib.crc32(raw)
    compression = {0: NONE, 1: PACKBITS, 2: LZW, 3: LZW}.get(h % 16, DEFLATE)
    return {"compression": compression, "tile": 64 if h >> 4 & 3 == 0 else 0, "predictor": 1 + (h >> 6 & 1), "order": "<>"[h >> 7 & 1]}


def padded(raw: bytes) -> bytes:
    """Zero bytes up to the next positive multiple of 64; a length that is one already gets none."""
    return raw + bytes(-len(raw) % 64 if raw else 64)


def to_media(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """(key, n_bytes, media): each text's bytes, filled with zero bytes to a positive multiple of 64 (`padded`), as a TIFF file.  Its form follows the
    text (`form_of`); `how` fixes parts of it."""
    kind = docs.schema[key].dataType
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            sizes, media = [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                raw = raw or b""
                sizes.append(len(raw))
                media.append(encode(padded(raw), **{**form_of(raw), **how}))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["key", "n_bytes", "media"])
    out = T.StructType([T.StructField("key", kind), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(made, out)


PAGE_FIELDS = [("page", T.IntegerType()), ("last", T.BooleanType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("compression", T.IntegerType()), ("image_bytes", T.LongType()), ("image_sha256", T.StringType()),
               ("tail_crc32", T.LongType()), ("feature", T.StringType()), ("samples", T.BinaryType()), ("error", T.StringType())]


def pages(files: DataFrame, key: str = "key", media: str = "media", samples: bool = True) -> DataFrame:
    """One row per page.  image_bytes, image_sha256, tail_crc32 and feature tell of all samples of the file up to this page; `last` marks its last page."""
    kind = files.schema[key].dataType
    names = [n for n, _ in PAGE_FIELDS]
    arrow = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    kinds = [arrow[t] for _, t in PAGE_FIELDS]
    def read(data: bytes | None) -> Iterator[list]:
        reading, held = Reading(), None
        try:
            if data is None:
                raise ValueError("null")
            for i, page in enumerate(walk(data)):
                if held:
                    yield held
                raw = reading.add(page)
                held = [i, False, page.width, page.height, page.compression, reading.size, reading.sha.hexdigest(), zlib.crc32(reading.tail), reading.feature(), raw if samples else None, None]
            if held:
                held[1] = True
                yield held
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as fault:
            if held:
                yield held
            yield [None, None, None, None, None, None, None, None, None, None, str(fault) or type(fault).__name__]
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", 4 << 20):
            rows, at = [], []
            for i, data in enumerate(batch.column("media").to_pylist()):
                for row in read(data):
                    rows.append(row)
                    at.append(i)
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int32())), *columns], names=["key", *names])
    out = T.StructType([T.StructField("key", kind), *[T.StructField(n, t) for n, t in PAGE_FIELDS]])
    return files.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(opened, out)
