"""Token ids in length-delimited binary records, with an offset index.

A record is its length (8 bytes), the masked CRC-32C of the length, the payload, and the masked CRC-32C of the payload, all little
endian: readers of the TFRecord format understand the files.  The payload is a flag byte, the document id and the ids as 16- or 32-bit numbers.
The index, one row per record with file, offset and size, is a table of its own: readers may take records in any order.

Texts are dealt by ranges of the document id and sorted, each task writes files of bounded size into the shared folder through the
file system of its address, and only a finished task's files are named by the index; a task that runs again writes new files.

Defined cases: a null or empty text is one end id; rows without an id come first and read back without one; equal ids are ordered by text; an
empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from pressdelta.llm.common import open_store, per_process, pieces, scratch, store
from pressdelta.llm.words import WordEncoder

# fixed values of the checksum
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
CHUNK = 512
HEAD = "<Bq"
HEAD_BYTES = 9
NO_ID = 128
FILE_BYTES = 64 << 20
READ_BYTES = 8 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Four tables to take four bytes at a time, and four that move a checksum past CHUNK zero bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(POLYNOMIAL), first >> 1).astype(np.uint32)
    steps = [first]
    for _ in range(3):
        steps.append(first[steps[-1] & 255] ^ (steps[-1] >> 8))
    moved = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(CHUNK):
        moved = first[moved & 255] ^ (moved >> 8)
    return np.stack(steps[::-1]), moved


def crc32c(values: Sequence[bytes]) -> np.ndarray:
    """CRC-32C of each value, at least four bytes long.  All chunks of all values advance together; then each value's chunks are joined."""
    steps, moved = per_process(("crc32c",), _tables)
    sizes = np.array([len(v) for v in values], np.int64)
    chunks = -(-sizes // CHUNK)
    # zero bytes in front leave a zero checksum as it is; the initial value is folded into the first four bytes
    data = np.frombuffer(b"".join(bytes(-len(v) % CHUNK) + (int.from_bytes(v[:4], "little") ^ 0xFFFFFFFF).to_bytes(4, "little") + v[4:] for v in values), "<u4").reshape(-1, CHUNK // 4)
    crc = np.zeros(len(data), np.uint32)
    for column in np.ascontiguousarray(data.T):
        crc ^= column
        crc = steps[0][crc & 255] ^ steps[1][(crc >> 8) & 255] ^ steps[2][(crc >> 16) & 255] ^ steps[3][crc >> 24]
    starts = np.cumsum(chunks) - chunks
    total = np.zeros(len(values), np.uint32)
    for j in range(int(chunks.max(initial=0))):
        on = np.flatnonzero(chunks > j)
        t = total[on]
        total[on] = moved[0][t & 255] ^ moved[1][(t >> 8) & 255] ^ moved[2][(t >> 16) & 255] ^ moved[3][t >> 24] ^ crc[starts[on] + j]
    return total ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK_DELTA)


def frame(payloads: Sequence[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    return [n + struct.pack("<I", a) + p + struct.pack("<I", b) for n, a, p, b in zip(lengths, masked(crc32c(lengths)).tolist(), payloads, masked(crc32c(payloads)).tolist())]


def unframe(records: Sequence[bytes]) -> list[bytes]:
    """Payloads of whole records; a wrong length or checksum is an error."""
    heads, payloads = [r[:8] for r in records], [r[12:-4] for r in records]
    for r, n, p, a, b in zip(records, heads, payloads, masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()):
        if struct.unpack("<Q", n)[0] != len(p) or struct.unpack("<I", r[8:12])[0] != a or struct.unpack("<I", r[-4:])[0] != b:
            raise ValueError("damaged record")
    return payloads


INDEX = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("file", T.StringType()), T.StructField("at", T.LongType()), T.StructField("size", T.LongType()),
                      T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("before", T.LongType())])


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, text: str = "text", doc_id: str = "doc_id", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the documents' ids in ascending id order into `folder`.  Returns the index; `before` counts the ids of the part so far."""
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, before = per_process(("words", tokenizer), lambda: WordEncoder(tokenizer)), TaskContext.get().partitionId(), 0, 0
        width = 2 if max(encoder.size, end_id + 1) <= 1 << 16 else 4
        end = end_id.to_bytes(width, "little")
        fs, inner = open_store(folder)
        fs.create_dir(inner)
        out, name, at = None, "", 0
        for batch in pieces(batches, "text"):
            rows, payloads = [], []
            for key, ids in zip(batch.column("key").to_pylist(), encoder.encode(batch.column("text").to_pylist(), width)):
                payloads.append(struct.pack(HEAD, width | (NO_ID if key is None else 0), key or 0) + ids + end)
            for key, payload, record in zip(batch.column("key").to_pylist(), payloads, frame(payloads)):
                if out is None or at >= file_bytes:
                    if out:
                        out.close()
                    name, at = f"part-{part:06d}-{uuid.uuid4().hex}.tfrecord", 0
                    out = fs.open_output_stream(f"{inner}/{name}")
                out.write(record)
                n = (len(payload) - HEAD_BYTES) // width
                rows.append((part, seq, name, at, len(record), key, n, before))
                seq, at, before = seq + 1, at + len(record), before + n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=INDEX.names)
        if out:
            out.close()
    rows = docs.select(F.col(doc_id).cast("long").alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    # many rows without an id, or with one id, are ranges of their own
    return store(rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h", "text").drop("h").mapInArrow(written, INDEX), "record-index")


READ = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("before", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def read(index: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """The records an index names, read by offset: the document, its number of ids, their checksum as 32-bit numbers, and the ids if asked for."""
    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = open_store(folder)
        for batch in batches:
            todo = sorted(zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("size").to_pylist(), batch.column("part").to_pylist(), batch.column("before").to_pylist()))
            i = 0
            while i < len(todo):
                # neighbours in a file come in one read, up to a bound
                j = i + 1
                while j < len(todo) and todo[j][0] == todo[i][0] and todo[j][1] == todo[j - 1][1] + todo[j - 1][2] and todo[j][1] + todo[j][2] - todo[i][1] <= READ_BYTES:
                    j += 1
                with fs.open_input_file(f"{inner}/{todo[i][0]}") as f:
                    block = f.read_at(todo[j - 1][1] + todo[j - 1][2] - todo[i][1], todo[i][1])
                rows = []
                for (_, _, _, part, before), payload in zip(todo[i:j], unframe([block[t[1] - todo[i][1] : t[1] - todo[i][1] + t[2]] for t in todo[i:j]])):
                    flags, key = struct.unpack_from(HEAD, payload)
                    numbers = np.frombuffer(payload, "<u2" if flags & 127 == 2 else "<u4", offset=HEAD_BYTES).astype("<u4")
                    rows.append((part, None if flags & NO_ID else key, before, len(numbers), zlib.crc32(numbers.tobytes()), numbers.astype(np.int32) if ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=READ.names)
                i = j
    # by place, so that a task reads neighbours; large index files do not make large tasks
    wanted = index.select("part", "file", "at", "size", "before").repartition("file", F.floor(F.col("at") / F.lit(READ_BYTES))).sortWithinPartitions("file", "at")
    return wanted.mapInArrow(opened, READ)


def starts(index: DataFrame) -> DataFrame:
    """(part, start): ids in all parts before.  One row per part that was written."""
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the documents' ids and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = scratch(docs.sparkSession, "records")
    index = write(docs, tokenizer, folder, end_id)
    found = read(index, folder, ids=False).join(F.broadcast(starts(index)), "part")  # one row per write task
    return found.select("doc_id", (F.col("part_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
