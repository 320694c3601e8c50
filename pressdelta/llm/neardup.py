"""Near-duplicates by ProbMinHash, banding and verification.

A document is the weighted set of its five-word shingles; a shingle that stands n times weighs 1 + ln n.  Each shingle starts a Poisson
process whose rate is its weight; every arrival goes to a random register, and a register keeps the shingle that arrives first.  Two
registers agree with probability equal to the probability Jaccard of the two documents (the Jaccard similarity when all weights are equal).  A process stops
once its next arrival comes after the last register was filled.

Bands of registers put documents into buckets.  Inside a bucket, one-byte prints of all registers tell which members can be similar at all
(links of the plausible graph); its components are candidate groups, and inside them texts are compared exactly.  Buckets and groups of any size are
cut into blocks, pairs of blocks are the tasks' units, and a unit emits only links that join what was apart: never more than its members.
With 24 bands of 4 registers a pair at the threshold is missed with probability 3e-6, and by the prints with less than 1e-6.

Equal word sequences (white space and A-Z case apart) are one class from the start and are compared once.

Defined cases: a null or empty text, or one of white space only, has no words: all such texts are one class; texts of one to four words have one shingle;
rows repeated with the same id and words are one document and stay or go together; a class takes the smallest of its ids, null if none has one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pressdelta.llm.common import LAST_ID, SPACE, pieces, remove, scratch, store

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
# share of equal prints below which a pair at SIMILAR lies with probability under 1e-6
PLAUSIBLE = 0.6
BLOCK_ROWS, BLOCK_BYTES = 256, 4 << 20
COLUMNS = 4096
_SPACES = bytes.maketrans(SPACE, b" " * len(SPACE))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_PLACES = _FACTORS * np.arange(1, 6, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().translate(_SPACES).split()


def content_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingles(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as 64-bit numbers, in order, and their weights."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        total += _mix(h[k : k + n] + _PLACES[k % 5])
    found, counts = np.unique(_mix(total), return_counts=True)
    return found, 1 + np.log(counts)


def signature(elements: np.ndarray, weights: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The first element to arrive at each register."""
    first, owner = np.full(m, np.inf), np.zeros(m, np.uint64)
    at, step = np.zeros(len(elements)), 0
    need = m * (np.log(m) + 4)
    while len(elements):
        # a few arrivals of every process at once: about as many as fill all registers
        block = int(min(64, max(1, np.ceil(need / len(elements)))))
        draws = _mix(elements[:, None] + _FACTORS[0] * np.arange(step + 1, step + block + 1, dtype=np.uint64))
        times = at[:, None] + np.cumsum(-np.log(((draws >> np.uint64(11)).astype(float) + 1) / 2.0**53), axis=1) / weights[:, None]
        register = (_mix(draws) % np.uint64(m)).astype(np.int64).reshape(-1)
        flat = times.reshape(-1)
        order = np.argsort(-flat, kind="stable")
        best, who = np.full(m, np.inf), np.zeros(m, np.uint64)
        best[register[order]] = flat[order]
        who[register[order]] = np.repeat(elements, block)[order]
        sooner = best < first
        first[sooner], owner[sooner] = best[sooner], who[sooner]
        on = times[:, -1] < first.max()
        elements, weights, at, step = elements[on], weights[on], times[on, -1], step + block
    return owner


SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("prints", T.BinaryType())])


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def signed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: hash of the whole text, content key, bytes, band hashes and one-byte prints of the registers; no bands without words."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in pieces(batches, "text"):
            keys, sizes, bands, prints, seen = [], [], [], [], {}
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(raw)
                key = content_key(words)
                if key not in seen:
                    if words:
                        owner = signature(*shingles(words))
                        parts = owner.reshape(BANDS, ROWS)
                        h = salts.copy()
                        for r in range(ROWS):
                            h = _mix(h + parts[:, r] * _FACTORS[r])
                        seen[key] = h.astype(np.int64), (owner >> np.uint64(56)).astype(np.uint8).tobytes()
                    else:
                        seen[key] = np.zeros(0, np.int64), b""
                keys.append(key)
                sizes.append(len(raw or b""))
                bands.append(seen[key][0])
                prints.append(seen[key][1])
            h1, h2 = _halves(keys)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("whole"), pa.array(h1), pa.array(h2), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(prints, pa.binary())], names=SIGNED.names)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("whole"), F.col(text).alias("text")).mapInArrow(sign, SIGNED)


def components(edges: DataFrame) -> DataFrame:
    """(node, group) of an undirected graph (a, b): `group` is the smallest node that can be reached.

    In each round every node goes to its smallest neighbour if that is smaller, and then to where that one went; the graph is
    contracted to what is left between different nodes, so it shrinks by more than half.  Each round is written, so lineage stays short.
    """
    spark, used = edges.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(scratch(spark, name))
        return store(df, name, used[-1])

    left = kept(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph-edges")
    groups = None
    while True:
        # a local minimum has no smaller neighbour and stays
        to = left.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("up"))
        every = left.select("a").union(left.select("b")).distinct().withColumnRenamed("a", "node").join(to, "node", "left").select("node", F.coalesce("up", "node").alias("up"))
        every = kept(every, "graph-parents")
        jump = every.select(F.col("node").alias("up"), F.col("up").alias("above"))
        every = kept(every.join(jump, "up").select("node", F.col("above").alias("up")), "graph-parents")
        step = every.select(F.col("node").alias("group"), "up")
        groups = kept(every.select("node", F.col("up").alias("group")) if groups is None else groups.join(step, "group", "left").select("node", F.coalesce("up", "group").alias("group")), "graph-groups")
        at = lambda c: every.select(F.col("node").alias(c), F.col("up").alias(f"{c}2"))
        ends = left.join(at("a"), "a").join(at("b"), "b").filter("a2 != b2")
        left = kept(ends.select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct(), "graph-edges")
        if left.isEmpty():
            for path in used[:-2]:
                remove(path)
            return groups


def dealt(rows: DataFrame, group: str, node: str, size: Column | None = None) -> DataFrame:
    """Adds unit, low and high: each row goes to every pair of blocks of its group in which its own block stands.

    A group is cut into blocks of about BLOCK_ROWS rows and BLOCK_BYTES bytes; two blocks meet in one unit.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.sum(size if size is not None else F.lit(0)).alias("__bytes")).filter("__n > 1")
    blocks = F.greatest(F.ceil(F.col("__n") / BLOCK_ROWS), F.ceil(F.col("__bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    counted = rows.join(counts.select(group, F.least(blocks, F.col("__n").cast("int")).alias("__blocks")), group)
    own = counted.withColumn("__own", F.pmod(F.xxhash64(node), F.col("__blocks")).cast("int"))
    met = own.withColumn("__met", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return met.withColumns({"low": F.least("__own", "__met"), "high": F.greatest("__own", "__met"), "side": (F.col("__own") > F.col("__met")).cast("int")}).drop("__own", "__met", "__blocks")


def units(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal keys, put together across batches."""
    held = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        table = [np.asarray(batch.column(k)) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([t[1:] != t[:-1] for t in table])) + 1
        bounds = [0, *change.tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(t[a] for t in table)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spanning(pairs: np.ndarray, n: int, links=None) -> list[tuple[int, int]]:
    """The pairs that join what was apart, in order; `links(i, j)` may still refuse one."""
    top, out = list(range(n)), []
    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i
    for i, j in pairs.tolist():
        a, b = root(i), root(j)
        if a != b and (links is None or links(i, j)):
            top[a] = b
            out.append((i, j))
    return out


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


def _pairs(allowed: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs of a unit: across its two blocks, or inside its one block."""
    if side.any():
        allowed = allowed & (side[:, None] < side[None, :])
    else:
        allowed = np.triu(allowed, 1)
    return np.argwhere(allowed)


def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between members of a bucket whose prints agree often enough.  Members are sorted, so buckets of the same members
    give mostly the same links."""
    found = []
    for unit in units(batches, ("bucket", "low", "high")):
        n = len(unit)
        if n < 2:
            continue
        nodes, side = np.asarray(unit.column("node")), np.asarray(unit.column("side"))
        prints = np.frombuffer(b"".join(unit.column("prints").to_pylist()), np.uint8).reshape(n, REGISTERS)
        if n == 2:
            if np.count_nonzero(prints[0] == prints[1]) >= PLAUSIBLE * REGISTERS:
                found.append((int(nodes[0]), int(nodes[1])))
        else:
            equal = np.zeros((n, n), np.uint8)
            for r in range(REGISTERS):
                equal += prints[:, r][:, None] == prints[:, r][None, :]
            found += [(int(nodes[i]), int(nodes[j])) for i, j in spanning(_pairs(equal >= PLAUSIBLE * REGISTERS, side), n)]
        if len(found) > 50_000:
            yield _edges(found)
            found = []
    yield _edges(found)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets given in order."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = wa[i], wb[j]
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    below = (wa.sum() - x.sum()) + np.concatenate([[0.0], np.cumsum(x)])[upto]
    above = (wb.sum() - y.sum()) + y.sum() - np.concatenate([[0.0], np.cumsum(y)])[upto]
    return float((1 / (below / x + above / y)).sum())


def similar(similarity: float):
    """Verified links between members of candidate groups."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(pieces(batches, "text"), ("group", "low", "high")):
            rows = {}
            for node, side, h1, h2, raw in zip(unit.column("node").to_pylist(), unit.column("side").to_pylist(), unit.column("h1").to_pylist(), unit.column("h2").to_pylist(), unit.column("text").cast(pa.binary()).to_pylist()):
                words = words_of(raw)
                # an id may stand for other texts too
                if node not in rows and content_key(words) == np.array([h1, h2], "<i8").tobytes():
                    rows[node] = side, shingles(words)
            n = len(rows)
            if n < 2:
                continue
            nodes, side, sets = list(rows), np.array([r[0] for r in rows.values()]), [r[1] for r in rows.values()]
            sizes = np.array([len(s) for s, _ in sets])
            every, inverse, counts = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True, return_counts=True)
            # only what two members share can meet; columns in slices bound the matrix
            shared = np.cumsum(counts > 1) - 1
            place = np.where(counts > 1, shared, -1)[inverse]
            owner = np.repeat(np.arange(n), sizes)
            on = place >= 0
            place, owner = place[on], owner[on]
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            both = np.zeros((n, n), np.float32)
            for start in range(0, int(shared[-1]) + 1 if len(shared) else 0, COLUMNS):
                a, b = np.searchsorted(place, [start, start + COLUMNS])
                matrix = np.zeros((n, COLUMNS), np.float32)
                matrix[owner[a:b], place[a:b] - start] = 1
                both += matrix @ matrix.T
            jaccard = both / np.maximum(1, sizes[:, None] + sizes[None, :] - both)
            plain = np.array([bool((w == 1).all()) for _, w in sets])
            # with equal weights the two measures are one; else weights move it, so look at pairs well below too
            allowed = np.where(plain[:, None] & plain[None, :], jaccard >= similarity - 1e-6, jaccard >= similarity / 4)
            pairs = _pairs(allowed, side)
            pairs = pairs[np.argsort(-jaccard[pairs[:, 0], pairs[:, 1]], kind="stable")]
            links = lambda i, j: plain[i] and plain[j] or probability_jaccard(*sets[i], *sets[j]) >= similarity - 1e-9
            found = spanning(pairs, n, links)
            if found:
                yield _edges([(nodes[i], nodes[j]) for i, j in found])
    return verify


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILAR) -> DataFrame:
    """(doc_id, h1, h2, class_h1, class_h2, class_id, class_rows): a row per document.  class_h1 and class_h2, the smallest content key of the class,
    name it; class_id is the smallest id in it, which other classes may have too: it is null without ids, and an id may stand for unlike texts."""
    spark = docs.sparkSession
    # the row number is fixed once written
    rows = store(signed(docs, text, doc_id).withColumn("row", F.monotonically_increasing_id()), "signatures")
    contents = rows.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    firsts = store(contents.withColumnRenamed("node", "row").join(rows.select("row", "doc_id", "whole", "size", "bands", "prints"), "row").withColumnRenamed("row", "node"), "contents")
    banded = firsts.select("node", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = banded.join(full, "bucket").join(firsts.select("node", "prints"), "node")
    met = dealt(members, "bucket", "node").select("bucket", "low", "high", "side", "node", "prints")
    maybe = met.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node").mapInArrow(plausible, EDGE)
    groups = components(maybe.distinct())
    wanted = groups.join(firsts.select("node", "doc_id", "whole", "h1", "h2", "size"), "node")
    cut = store(dealt(wanted, "group", "node", F.col("size")), "candidates")
    # a text meets its candidate by id and hash of the text, so rows without an id are no hot key; equal rows are one, ahead of the shuffle.
    # The join keeps the dealing of that step: texts are shuffled once at every size, as the candidates grow with the input
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("whole"), F.col(text).alias("text")).groupBy("id", "whole").agg(F.first("text").alias("text"))
    sought = cut.withColumn("id", F.coalesce("doc_id", F.lit(LAST_ID))).hint("merge")
    found = texts.join(sought, ["id", "whole"]).select("group", "low", "high", "side", "node", "h1", "h2", "text")
    links = found.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "node").mapInArrow(similar(similarity), EDGE)
    joined = components(links.distinct()).withColumnRenamed("group", "class")
    placed = firsts.select("h1", "h2", "node", "least", "copies").join(joined, "node", "left").withColumn("class", F.coalesce("class", "node"))
    told = placed.groupBy("class").agg(F.min(F.struct("h1", "h2")).alias("key"), F.min("least").alias("class_id"), F.sum("copies").alias("class_rows"))
    named = placed.join(told, "class").select("h1", "h2", F.col("key.h1").alias("class_h1"), F.col("key.h2").alias("class_h2"), "class_id", "class_rows")
    return rows.select("doc_id", "h1", "h2").join(named, ["h1", "h2"]).select("doc_id", "h1", "h2", "class_h1", "class_h2", "class_id", "class_rows")


def content_of(text: Column) -> Column:
    """struct<h1, h2> of a text column, as in `classes`."""
    @F.pandas_udf(T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]))
    def keyed(texts: pd.Series) -> pd.DataFrame:
        h1, h2 = _halves([content_key(words_of(t.encode("utf-8", "surrogatepass") if t else b"")) for t in texts])
        return pd.DataFrame({"h1": h1, "h2": h2})
    return keyed(text)


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each class, the one with the smallest id (of several texts under it, or without ids, the smallest content key; of rows
    equal in both, any one); all columns of the documents, whatever their names."""
    own = classes(docs, text, doc_id).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_h1", "class_h2", "doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    found = own.groupBy("class_h1", "class_h2", "doc_id").agg(F.min(F.struct("h1", "h2", "n")).alias("first"))
    kept = store(found.select(F.col("doc_id").alias("__id"), F.col("first.h1").alias("__h1"), F.col("first.h2").alias("__h2"), F.col("first.n").alias("__n")), "first-documents")
    # the columns travel in a struct: helper names cannot meet theirs
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{doc_id}`").cast("long").alias("__doc"), content_of(F.col(f"`{text}`")).alias("__content"))
    on = F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__content.h1") == F.col("__h1")) & (F.col("__content.h2") == F.col("__h2"))
    one = keyed.join(kept.filter("__n = 1"), on, "left_semi").select("__row.*")
    again = kept.filter("__n > 1")
    if again.isEmpty():
        return one
    repeated = keyed.join(again, on).dropDuplicates(["__id", "__h1", "__h2"]).select("__row.*")
    return one.unionByName(repeated)
