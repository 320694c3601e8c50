"""Hard negatives by an inverted multi-index over two half spaces.

Vectors are cut into two halves with a codebook each (k-means on a bounded sample); a cell is a pair of code words.  The best score a
row of a cell can have with an anchor is at most the sum of two half scores, <anchor half, code word> + |anchor half| * radius, where the radius is
the largest distance of any row's half from its code word.  A heap walks the pairs of the two sorted lists of half scores
(multi-sequence order), so an anchor meets cells by falling bound and stops where no cell to come can matter.  Four walks find all:

1. positives, first guess: cells until `SEED_ROWS` rows are read; the score of the last wanted row is a floor;
2. positives, certified: all further cells whose bound reaches the floor;
3. negatives, first guess: as 1, now that each positive's window of scores is known; the last wanted row in a window raises its floor;
4. negatives, certified: all further cells whose bound reaches the lowest floor of the anchor's windows.

Each walk is one Spark job.  Cells of one first code word are stored in slabs of at most `SLAB` rows, each in bounds of memory whatever the cell sizes;
anchors travel in blocks to the slabs they visit, and meet there only the cells they visit; what leaves a task are the few best rows above an
anchor's floors.  Scores are exact integers, so results are exact whatever the codebooks: they only decide how much is read.
On vectors without structure (random directions) bounds cut off little, and the work is that of a blocked comparison of all anchors with all rows.

Of rows with equal vector and label only the smallest ids can be among the first few of any list; the others are set aside before
cells are filled (in two salted rounds), so a group of copies of any size fills no cell.

Defined cases: rows with a null label, id or vector, or a null or non-finite component take no part; vectors of unequal length are
compared as if padded with zeros; equal rows count as often as they stand; ties go to the smaller id; an anchor without rows of its label has no positives and
no result; a positive with a negative score has an empty window; an empty table gives an empty result; extra columns are not read.  Components are
expected to be below 2^20 once scaled; beyond, an error tells so instead of inexact scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta.llm.common import digest64, store
from pressdelta.plans.patterns import top_per_group

POSITIVES, NEGATIVES, LOW = 5, 5, 80
# rows of a cell to aim at, code words per half at most, sample for the codebooks, rows of the first walk, rows of a slab, anchors of a block
CELL_ROWS, CODES, SAMPLE, SEED_ROWS, SLAB, BLOCK = 128, 512, 8192, 4096, 4096, 64
ROUNDS, LIMIT = 12, 1 << 20
SLABS = "c1 int, part int, kind int, ids binary, labels binary, vectors binary, second binary"
PROBES = "c1 int, part int, kind int, ids binary, labels binary, vectors binary, windows binary"
FOUND = "anchor_id bigint, other_id bigint, score bigint"
ANCHORS = "anchor_id bigint, label bigint, v array<double>, floors array<double>, caps array<double>"


# --- rows -------------------------------------------------------------------------------------------------------------------
def scaled(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v): rows that take part, components as floor(scale * x)."""
    x = F.col(f"`{embedding}`")
    sound = x.isNotNull() & F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("double"))
    return rows.filter(F.coalesce(sound, F.lit(False))).select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, short rows padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, width))
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        out = flat.reshape(-1, width)
    else:
        out = np.zeros((len(lengths), width))
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    if out.size and np.abs(out).max() >= LIMIT:
        raise ValueError(f"a scaled component of {np.abs(out).max():.0f} is beyond {LIMIT}: scores would not be exact")
    return out


def _row(c1: int, part: int, kind: int, packed: Sequence[np.ndarray], names: Sequence[str]) -> pa.Table:
    schema = pa.schema([("c1", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in names]])
    return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip([c1, part, kind, *(x.tobytes() for x in packed)], schema)], schema=schema)


# --- index ------------------------------------------------------------------------------------------------------------------
def _codebook(points: np.ndarray, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from a fixed choice of points.  Code words are whole numbers, so that half scores are exact and a bound has the same value
    wherever it is computed; one without points keeps its place."""
    points = np.unique(points, axis=0)
    codes = max(1, min(codes, len(points)))
    if not len(points):
        return np.zeros((1, points.shape[1]))
    words = points[np.random.default_rng(7).permutation(len(points))[:codes]].copy()
    for _ in range(rounds):
        near = _nearest(points, words)[0]
        sums, counts = np.zeros_like(words), np.bincount(near, minlength=codes)
        np.add.at(sums, near, points)
        words[counts > 0] = np.rint(sums[counts > 0] / counts[counts > 0, None])
    return words


def _nearest(points: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest code word of each point, and its distance."""
    near = ((words * words).sum(axis=1) - 2 * points @ words.T).argmin(axis=1)
    return near, np.sqrt(((points - words[near]) ** 2).sum(axis=1))


class Index:
    """Codebooks, radii, cell sizes (bounded by `CODES`, so small) and the slabs of rows."""

    def __init__(self, words: list[np.ndarray], radii: list[np.ndarray], sizes: np.ndarray, slabs: DataFrame, width: int, parts: np.ndarray):
        self.words, self.radii, self.sizes, self.slabs, self.width, self.parts = words, radii, sizes, slabs, width, parts
        self.cut = width // 2


def half_bounds(halves: Sequence[np.ndarray], words: Sequence[np.ndarray], radii: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Upper bounds of the half scores, anchors x code words, for both halves; none for a code word without rows."""
    out = []
    for half, book, radius in zip(halves, words, radii):
        length = np.sqrt((half * half).sum(axis=1))[:, None]
        # products are whole numbers; the margin covers the rounding of lengths and radii
        out.append(np.where(radius >= 0, half @ book.T + (length * np.maximum(radius, 0) * (1 + 1e-9) + 1e-3), -np.inf))
    return out


def build_index(rows: DataFrame, keep: int, cell_rows: int = CELL_ROWS, codes: int = CODES, sample: int = SAMPLE, slab: int = SLAB) -> Index:
    """Index over (id, label, v).  `keep`: of equal rows so many smallest ids are held."""
    some = store(top_per_group(rows, ["v", "label"], [F.asc("id")], keep, spread=["id"]).select("id", "label", "v"), "negatives-rows")
    told = some.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = told.n, max(2, told.width or 0)
    cut = width // 2
    # a cut of hashes: about `sample` rows, all of a small table
    share = min(1.0, sample / max(1, n))
    picked = some.filter(digest64(F.col("id"), 17) <= F.lit(int(-(2**63) + share * (2**64 - 1)))).select("v") if share < 1 else some.select("v")
    points = _matrix(picked.toArrow()["v"], width)
    wanted = max(1, min(codes, round(math.sqrt(n / cell_rows))))
    words = [_codebook(points[:, :cut], wanted), _codebook(points[:, cut:], wanted)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            (c1, r1), (c2, r2) = _nearest(m[:, :cut], words[0]), _nearest(m[:, cut:], words[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([x.tobytes() for x in m.astype("<f4")], pa.binary()), pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), pa.array(r1), pa.array(r2)],
                                             names=["id", "label", "v", "c1", "c2", "r1", "r2"])
    homes = store(some.select("id", "label", "v").mapInArrow(assign, "id bigint, label bigint, v binary, c1 int, c2 int, r1 double, r2 double"), "negatives-cells")
    # one row per cell: at most codes * codes
    cells = homes.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toArrow()
    sizes = np.zeros((len(words[0]), len(words[1])), np.int64)
    radii = [np.full(len(w), -1.0) for w in words]
    a, b = cells["c1"].to_numpy(), cells["c2"].to_numpy()
    sizes[a, b] = cells["n"].to_numpy()
    np.maximum.at(radii[0], a, cells["r1"].to_numpy())
    np.maximum.at(radii[1], b, cells["r2"].to_numpy())
    parts = np.maximum(1, -(-sizes.sum(axis=1) // slab))

    def pack(key: tuple, rows_: pa.Table) -> pa.Table:
        second = rows_["c2"].to_numpy()
        order = np.lexsort([rows_["id"].to_numpy(), second])
        v = np.frombuffer(b"".join(rows_["v"].to_pylist()), "<f4").reshape(-1, width)
        packed = [rows_["id"].to_numpy()[order], rows_["label"].to_numpy()[order], v[order], second[order].astype("<i4")]
        return _row(key[0].as_py(), key[1].as_py(), 0, packed, ("ids", "labels", "vectors", "second"))
    number = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("c1") + 1)
    dealt = homes.withColumn("part", F.pmod(digest64(F.col("id"), 5), number).cast("int"))
    slabs = store(dealt.groupBy("c1", "part").applyInArrow(pack, SLABS), "negatives-slabs")
    return Index(words, radii, sizes, slabs, width, parts)


# --- walks ------------------------------------------------------------------------------------------------------------------
def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of places by falling sum of bounds: (sum, place in `first`, place in `second`).  A heap holds the pairs that may come next."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    if not len(a) or not len(b):
        return
    heap, waiting = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}
    while heap:
        cost, i, j = heapq.heappop(heap)
        yield -cost, int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in waiting:
                waiting.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, floor: float, rows: int, on: bool) -> tuple[float, float, set[int]]:
    """Bounds and first code words of the cells to visit: (lowest bound, bound they stay below, code words).

    The first walk takes cells down to `floor` until it met `rows` rows; with `on`, the next one takes what is left down to `floor`.
    Cells of equal bound belong together."""
    seen, edge, met, before, open_ = 0, math.inf, set(), None, True
    for bound, i, j in multi_sequence(first, second):
        if open_ and seen >= rows and bound != before:
            open_ = False
            if not on:
                break
        if bound == -math.inf or bound < floor:
            break
        if open_:
            edge = before = bound
            seen += int(sizes[i, j])
        if sizes[i, j] and open_ != on:
            met.add(i)
    return (max(floor, -1e300), edge, met) if on else (edge, math.inf, met)


def _best(anchors: np.ndarray, others: np.ndarray, scores: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first `keep` of each anchor in its window."""
    rows = np.flatnonzero((scores >= low) & (scores <= high))
    order = rows[np.lexsort([others[rows], -scores[rows], anchors[rows]])]
    a = anchors[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = a[1:] != a[:-1]
    place = np.arange(len(a)) - np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    return order[place < keep]


def visit(index: Index, anchors: DataFrame, same: bool, keep: int, on: bool, seed_rows: int = SEED_ROWS, block: int = BLOCK) -> DataFrame:
    """(anchor_id, other_id, score): one walk.  `anchors` has for each anchor windows of scores, floors and caps; found are the first `keep`
    rows of each window in every slab visited, of the anchor's label or of others, never the anchor's id itself."""
    words, radii, sizes, parts, width, cut = index.words, index.radii, index.sizes, index.parts, index.width, index.cut

    def bounds(m: np.ndarray) -> list[np.ndarray]:
        return half_bounds((m[:, :cut], m[:, cut:]), words, radii)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), block):
                batch = whole.slice(start, block)
                m = _matrix(batch.column("v"), width)
                ids, labels = batch.column("anchor_id").to_numpy(), batch.column("label").to_numpy()
                windows = np.zeros((len(batch), 2 + 2 * keep))
                visits: dict[int, list[int]] = {}
                one, two = bounds(m)
                for a, (low, high) in enumerate(zip(batch.column("floors").to_pylist(), batch.column("caps").to_pylist())):
                    if not low:
                        continue
                    lowest, below, met = walk(one[a], two[a], sizes, min(low), seed_rows, on)
                    windows[a] = [lowest, below, *low, *[math.inf] * (keep - len(low)), *high, *[-math.inf] * (keep - len(high))]
                    for c1 in met:
                        visits.setdefault(c1, []).append(a)
                for c1, who in visits.items():
                    packed = [ids[who], labels[who], m[who].astype("<f4"), windows[who]]
                    for part in range(int(parts[c1])):
                        yield from _row(c1, part, 1, packed, ("ids", "labels", "vectors", "windows")).to_batches()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, slab_key = None, None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                vectors = np.frombuffer(row["vectors"], "<f4").reshape(-1, width).astype(np.float64)
                if row["kind"] == 0:
                    second = np.frombuffer(row["second"], "<i4")
                    edges = np.flatnonzero(np.append(True, second[1:] != second[:-1]))
                    slab, slab_key = (ids, labels, vectors, second[edges], np.append(edges, len(second))), (row["c1"], row["part"])
                elif slab_key == (row["c1"], row["part"]):
                    windows = np.frombuffer(row["windows"], np.float64).reshape(len(ids), -1)
                    yield compared(slab, row["c1"], ids, labels, vectors, windows)

    def compared(slab: tuple, c1: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
        s_ids, s_labels, s_vectors, cells, edges = slab
        one, two = bounds(vectors)
        bound = one[:, [c1]] + two[:, cells]
        visited = (bound >= windows[:, [0]]) & (bound < windows[:, [1]])
        floors, caps = windows[:, 2 : 2 + keep], windows[:, 2 + keep :]
        least, most = floors.min(axis=1), caps.max(axis=1)
        found = []
        for c in np.flatnonzero(visited.any(axis=0)):
            who, rows = np.flatnonzero(visited[:, c]), slice(edges[c], edges[c + 1])
            scores = vectors[who] @ s_vectors[rows].T
            wanted = (labels[who][:, None] == s_labels[rows]) == same
            a, r = np.nonzero(wanted & (scores >= least[who][:, None]) & (scores <= most[who][:, None]) & (ids[who][:, None] != s_ids[rows]))
            found.append((who[a], s_ids[rows][r], scores[a, r]))
        a, other, score = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        rows = [_best(a, other, score, floors[a, j], caps[a, j], keep) for j in range(keep)]
        # a row in several windows is told once; rows of equal id, anchor and score are rows of their own
        rows = np.unique(np.concatenate(rows))
        return pa.RecordBatch.from_arrays([pa.array(ids[a[rows]]), pa.array(other[rows]), pa.array(score[rows].astype(np.int64))], names=["anchor_id", "other_id", "score"])

    probes = anchors.mapInArrow(probe, PROBES)
    both = index.slabs.unionByName(probes, allowMissingColumns=True)
    # the slab comes first, then the anchors that visit it, one block after the other
    return both.repartition("c1", "part").sortWithinPartitions("c1", "part", "kind").mapInArrow(meet, FOUND)


# --- mining -----------------------------------------------------------------------------------------------------------------
def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, seed_rows: int = SEED_ROWS, **sizes: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` as of `scaled`; `is_anchor` is a condition on id, label and v.  An anchor's positives are its `positives` best other rows of its label;
    for each, the best `negatives` rows of other labels with low * positive <= 100 * negative <= 100 * positive."""
    keep = max(positives, negatives)
    # (id, label, v) once per id: an id that stands more than once is asked for its first row
    asked = rows.filter(is_anchor).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select(F.col("id").alias("anchor_id"), "x.label", "x.v")
    anchors = store(asked.repartition(F.xxhash64("anchor_id")), "negatives-anchors")
    index = build_index(rows, keep + 1, **sizes)

    def ranked(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    window = lambda low_, high: (F.array(low_).alias("floors"), F.array(high).alias("caps"))
    top, bottom = F.lit(1e300), F.lit(-1e300)
    # positives: a first walk, then all cells that reach the last of them
    guess = store(ranked(visit(index, anchors.select("anchor_id", "label", "v", *window(bottom, top)), True, keep, False, seed_rows), ["anchor_id"], positives).drop("rank"), "negatives-guess")
    floor = guess.groupBy("anchor_id").agg(F.when(F.count("*") >= positives, F.min("score")).alias("floor"))
    told = anchors.join(floor, "anchor_id", "left").select("anchor_id", "label", "v", *window(F.coalesce(F.col("floor").cast("double"), bottom), top))
    more = visit(index, told, True, keep, True, seed_rows)
    best = store(ranked(guess.unionByName(more), ["anchor_id"], positives).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    # windows of scores, one per positive: at most `positives` in a list
    least = F.ceil(F.col("positive_score") * low / 100).cast("double")
    open_ = best.filter("positive_score >= 0").select("anchor_id", "positive_id", "positive_score", least.alias("floor"), F.col("positive_score").cast("double").alias("cap"))

    def windows(w: DataFrame) -> DataFrame:
        lists = w.select("anchor_id", "floor", "cap").distinct().groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("cap", "floor"))).alias("x"))
        return anchors.join(lists, "anchor_id").select("anchor_id", "label", "v", F.col("x.floor").alias("floors"), F.col("x.cap").alias("caps"))

    def inside(found: DataFrame) -> DataFrame:
        return ranked(open_.join(found, "anchor_id").filter((F.col("score") >= F.col("floor")) & (F.col("score") <= F.col("cap"))), ["anchor_id", "positive_id", "positive_score"], negatives)

    first = store(visit(index, windows(open_), False, keep, False, seed_rows), "negatives-first")
    full = inside(first).groupBy("anchor_id", "cap").agg(F.when(F.max("rank") >= negatives, F.min("score")).cast("double").alias("raised"))
    raised = open_.join(full, ["anchor_id", "cap"], "left").withColumn("floor", F.greatest("floor", F.coalesce("raised", "floor")))
    found = first.unionByName(visit(index, windows(raised), False, keep, True, seed_rows))
    return inside(found).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
