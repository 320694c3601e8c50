"""Exact dedup against a minimal perfect hash over the distinct digests seen so far.

Two texts are equal when they are identical without white space; a text's key is the SHA-256 digest of what is left.  The history is
a table with one row per bucket of digests.  A bucket holds a minimal perfect hash function (levelled bit arrays with ranks: a
digest's slot is the number of set bits before its own), and per slot the full digest, the size of its group, and the locator of the group's
winner: code points, id and row number.  A batch is grouped by digest first, so copies cost nothing further on, and its distinct
digests meet their bucket once.  A look-up takes any digest to some slot or to none; it is a member only if all 32 bytes of the slot are
its own.  Members add to their slot and may replace its winner; nonmembers have been grouped separately and become new entries, and the
bucket's function is built anew over both.  Buckets are split when they would hold more than `BUCKET` digests on average.

Batches follow the order of ids; each is about as large as all before it together, so entries are laid out anew once per doubling.
Digests spread evenly, whatever the texts.  Only the last step, in which every row learns its group, meets hot groups: those with more than one in
`HOT` of all rows (so fewer than `HOT` of them) are sent to every task, the others are joined by digest.  No text is shuffled.

Of equal texts the row with the most code points in the original text stays, then the one with the smallest id, then the one read first.

Defined cases: a null text is empty, and all texts of nothing but white space are equal to it; rows without an id take part and come last
among equals (the largest long stands for a missing id), as a winner their keep_id is null; repeated rows are copies of each other and exactly one of them
stays; an empty table gives an empty result; extra columns of any name do no harm: `decisions` returns none of them,
`distinct_documents` returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressdelta.llm.common import LAST_ID, remove, scratch, store, text_of

BLANKS = " \t\n\u000b\f\r"
BUCKET, BATCH_ROWS, HOT = 4096, 8192, 1024
# bits per digest in the array of a level
GAMMA = 2
DIGEST, WORDS = 32, 4
ENTRY = "digest binary, n bigint, chars bigint, doc bigint, row bigint"
INDEX = "bucket bigint, sizes binary, bits binary, slots binary"
SLOT = np.dtype([("digest", np.uint8, DIGEST), ("n", "<i8"), ("chars", "<i8"), ("doc", "<i8"), ("row", "<i8")])


# --- one bucket -------------------------------------------------------------------------------------------------------------
def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each digest in a level's array: one of its 64-bit words, a different one on the next level, mixed with the level."""
    x = digests.view("<u8").reshape(-1, WORDS)[:, level % WORDS] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct digests (rows of 32 bytes).  Level by level, a digest alone on its bit sets it; the others go on."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.ranks = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        left, sizes, levels = digests, [], []
        while len(left):
            size = GAMMA * len(left)
            at = _place(left, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            sizes.append(size)
            left = np.ascontiguousarray(left[hits[at] != 1])
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 where no level has one.  A digest that is no member may get any slot."""
        out, going, before = np.full(len(digests), -1, np.int64), np.arange(len(digests)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(np.ascontiguousarray(digests[going]), level, size) + before
            hit = self.bits[at]
            out[going[hit]] = self.ranks[at[hit]]
            going, before = going[~hit], before + size
        return out


def _entries(table: pa.Table) -> np.ndarray:
    """Rows of ENTRY as one array."""
    out = np.zeros(len(table), SLOT)
    if len(table):
        out["digest"] = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, DIGEST)
        for c in ("n", "chars", "doc", "row"):
            out[c] = table[c].to_numpy()
    return out


def _digests(entries: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(entries["digest"])


def _bucket_row(bucket: int, entries: np.ndarray) -> dict:
    function = PerfectHash.build(_digests(entries))
    slots = np.empty_like(entries)
    slots[function.slots(_digests(entries))] = entries
    return {"bucket": bucket, "sizes": function.sizes.tobytes(), "bits": np.packbits(function.bits).tobytes(), "slots": slots.tobytes()}


def _opened(row: dict) -> tuple[PerfectHash, np.ndarray]:
    sizes = np.frombuffer(row["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
    return PerfectHash(sizes, bits), np.frombuffer(row["slots"], SLOT).copy()


def members(function: PerfectHash, slots: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Slot of each digest that is in the history, by comparison of all its bytes; -1 for others."""
    at = function.slots(digests)
    known = np.flatnonzero(at >= 0)
    same = (slots["digest"][at[known]] == digests[known]).all(axis=1)
    at[known[~same]] = -1
    return at


def _merged(slots: np.ndarray, met: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The slots after entries `met` at slots `at`: sizes add up, the better winner stays."""
    old = slots[at]
    better = (met["chars"] > old["chars"]) | (met["chars"] == old["chars"]) & ((met["doc"] < old["doc"]) | (met["doc"] == old["doc"]) & (met["row"] < old["row"]))
    for c in ("chars", "doc", "row"):
        slots[c][at] = np.where(better, met[c], old[c])
    slots["n"][at] = old["n"] + met["n"]
    return slots


def _number(digests: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each digest: its first bits."""
    head = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64)
    return head >> (32 - bits)


def _index_type() -> pa.Schema:
    return pa.schema([("bucket", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()), ("slots", pa.binary())])


# --- the history ------------------------------------------------------------------------------------------------------------
class History:
    """Distinct digests seen so far, as a table of buckets in the shared folder."""

    def __init__(self, spark: SparkSession, bucket: int = BUCKET):
        self.spark, self.bucket, self.path, self.bits, self.size = spark, bucket, None, 0, 0

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(self.path) if self.path else self.spark.createDataFrame([], INDEX)

    def _split(self, bits: int) -> DataFrame:
        """The index with more buckets."""
        if bits == self.bits:
            return self.index()

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    _, slots = _opened(row)
                    number = _number(slots["digest"], bits)
                    yield pa.RecordBatch.from_pylist([_bucket_row(int(b), slots[number == b]) for b in np.unique(number)], _index_type())
        return self.index().mapInArrow(cut, INDEX)

    def add(self, groups: DataFrame) -> None:
        """Take in a batch, grouped by digest (ENTRY)."""
        path = scratch(self.spark, "digest-groups")
        groups = store(groups, "digest-groups", path)
        bits = max(self.bits, math.ceil(math.log2(max(1, (self.size + groups.count()) / self.bucket))))

        def meet(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
            batch = _entries(new)
            if len(old):
                function, slots = _opened(old.to_pylist()[0])
                at = members(function, slots, _digests(batch))
                slots = _merged(slots, batch[at >= 0], at[at >= 0])
                batch = np.concatenate([slots, batch[at < 0]])
            return pa.Table.from_pylist([_bucket_row(key[0].as_py(), batch)], _index_type())

        head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
        dealt = groups.withColumn("bucket", F.shiftrightunsigned(head, 32 - bits))
        later = scratch(self.spark, "digest-index")
        self._split(bits).groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(meet, INDEX).write.parquet(later)
        self.drop()
        remove(path)
        self.path, self.bits = later, bits
        self.size = (self.index().agg(F.sum(F.octet_length("slots"))).first()[0] or 0) // SLOT.itemsize

    def entries(self) -> DataFrame:
        """(digest, n, chars, doc, row): every distinct digest with its group's size and winner."""
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column("slots").to_pylist():
                    slots = np.frombuffer(raw, SLOT)
                    yield pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in slots["digest"]], pa.binary()), *[pa.array(np.ascontiguousarray(slots[c])) for c in ("n", "chars", "doc", "row")]],
                                                     names=["digest", "n", "chars", "doc", "row"])
        return self.index().select("slots").mapInArrow(read, ENTRY)

    def drop(self) -> None:
        if self.path:
            remove(self.path)
        self.path = None


# --- documents --------------------------------------------------------------------------------------------------------------
def content_digest(text: str | Column) -> Column:
    """SHA-256 of the text without white space."""
    return F.unhex(F.sha2(F.translate(text_of(text), BLANKS, ""), 256))


def _doc(doc_id: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID))


def grouped(keys: DataFrame) -> DataFrame:
    """ENTRY rows: one per digest.  Combined on the map side, so a hot group is a few rows."""
    best = F.min(F.struct((-F.col("chars")).alias("chars"), "doc", "row"))
    return keys.groupBy("digest").agg(F.count("*").alias("n"), best.alias("b")).select("digest", "n", (-F.col("b.chars")).alias("chars"), "b.doc", "b.row")


def batch_count(rows: int, batch_rows: int = BATCH_ROWS) -> int:
    """Batches for so many rows: 2 + log4(1 + rows / batch_rows), rounded up."""
    return 2 + math.ceil(math.log(1 + rows / batch_rows, 4))


def decisions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", batches: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id (id of the row that stays), group_size, kept, digest, chars."""
    spark = docs.sparkSession
    keys = store(docs.select(_doc(doc_id).alias("doc"), F.length(text_of(F.col(f"`{text}`"))).cast("long").alias("chars"), content_digest(F.col(f"`{text}`")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digest-keys")
    total = keys.count()
    batches = batches or batch_count(total)
    # each batch as large as all before it
    cuts = sorted({min(int(c), LAST_ID) for c in keys.approxQuantile("doc", [0.5**i for i in range(1, batches)], 0.01)}) if total and batches > 1 else []
    edges = [None, *cuts, None]
    history = History(spark)
    for low, high in zip(edges, edges[1:]):
        part = keys
        part = part if low is None else part.filter(F.col("doc") > F.lit(low))
        part = part if high is None else part.filter(F.col("doc") <= F.lit(high))
        history.add(grouped(part))
    groups = store(history.entries(), "digest-winners")
    history.drop()
    won = groups.select("digest", F.col("n").alias("group_size"), F.col("doc").alias("keep"), F.col("row").alias("keep_row"))
    # fewer than HOT groups can be this large
    hot = F.col("group_size") * HOT > total
    first = keys.join(F.broadcast(won.filter(hot)), "digest", "left")
    rest = first.filter("keep_row IS NULL").drop("group_size", "keep", "keep_row").join(won.filter(~hot), "digest")
    done = first.filter("keep_row IS NOT NULL").unionByName(rest)
    known = lambda c: F.nullif(F.col(c), F.lit(LAST_ID))
    return done.select(known("doc").alias("doc_id"), known("keep").alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "chars")


def distinct_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, whole.  Of rows with equal id and length and text but for white space, the smallest text stands."""
    staying = decisions(docs, text, doc_id).filter("kept").select(F.coalesce("keep_id", F.lit(LAST_ID)).alias("__doc"), F.col("chars").alias("__chars"), F.col("digest").alias("__digest"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(_doc(doc_id).alias("__doc"), F.length(text_of(F.col(f"`{text}`"))).cast("long").alias("__chars"), content_digest(F.col(f"`{text}`")).alias("__digest"), text_of(F.col(f"`{text}`")).alias("__text"), whole.alias("__whole"))
    one = keyed.groupBy("__doc", "__chars", "__digest").agg(F.min_by("__whole", "__text").alias("__whole"))
    return one.join(staying, ["__doc", "__chars", "__digest"], "left_semi").select("__whole.*")
