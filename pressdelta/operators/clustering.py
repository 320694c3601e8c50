"""Story clusters: nearest neighbours by cosine, and clusters that articles join one after the other.

The neighbour search is exact.  Vectors lie in a tree of balls: a ball with too many vectors is split by far pivots until all are below a
size, so pivots grow with the input.  Pairs of balls are followed down from the root; a pair goes on only if the triangle inequality on angles
allows two members within the threshold, and members are compared for the pairs of leaves that are left.  Equal vectors are one vector
for the search and expand afterwards, so copies cost nothing.

Vectors are written once and once more in tiles of leaves; a task holds one tile and reads the tiles near it from the table, so what is
written does not grow with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, FloatType

from pressdelta.plans.patterns import small, top_per_group, written

NEIGHBOURS, THRESHOLD = 10, 0.86
# vectors of a leaf, balls a ball is split into at once, vectors its pivots are chosen from (about)
LEAF, FAN, SAMPLE = 512, 32, 512
# times the centres of a split move
MOVES = 5
# tiles a core gets at least, if leaves allow it; rows of a pair of tiles in an Arrow batch; products held at once
TILES_PER_CORE, BATCH_TILES, CHUNK = 4, "2", 1 << 18
# angles of nearly equal vectors are rounded by about this much
SLACK = 1e-6
NODES = "ball string, parent string, center array<double>, radius double, size bigint"


def latest_vectors(versions: DataFrame) -> DataFrame:
    """Latest embedding of each article: (article_id, embedding)."""
    v = versions.filter(F.col("embedding").isNotNull())
    return v.groupBy("article_id").agg(F.max_by("embedding", "scanned_at").alias("embedding"))


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


# --- tree of balls ------------------------------------------------------------------------------------------------------------
def far_split(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Centres of up to `parts` groups of unit vectors: the largest group is split by two far pivots, its farthest vector from any one of
    it and the farthest from that one, until there are enough or all vectors of a group point the same way.  Centres then move to the middle of the
vectors nearest to them, a few times, so that balls are tight whatever the pivots were."""
    groups, solid = [np.arange(len(vectors))], []
    while groups and len(groups) + len(solid) < parts:
        groups.sort(key=len)
        g = groups.pop()
        one = g[_angles(vectors[g], vectors[g[:1]])[:, 0].argmax()]
        from_one = _angles(vectors[g], vectors[[one]])[:, 0]
        other = g[from_one.argmax()]
        if from_one.max() <= SLACK:
            solid.append(g)
            continue
        nearer = from_one <= _angles(vectors[g], vectors[[other]])[:, 0]
        groups += [g[nearer], g[~nearer]]
    near = np.empty(len(vectors), dtype=int)
    for i, g in enumerate(groups + solid):
        near[g] = i
    centers = np.zeros((len(groups + solid), vectors.shape[1]))
    for _ in range(MOVES + 1):
        for i in np.unique(near):
            center = vectors[near == i].mean(axis=0)
            centers[i] = center / max(np.linalg.norm(center), 1e-12)
        near = _angles(vectors, centers).argmin(axis=1)
    return centers


def _rows(column: pa.ListArray) -> np.ndarray:
    """Lists of equal length as one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _scaled(rows: np.ndarray) -> np.ndarray:
    m = rows.astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _descend(units: np.ndarray, tree: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(ball, positions, angles to its centre) of the balls without a split that the vectors end in, from the root on."""
    todo = [("0", np.arange(len(units)), np.full(len(units), np.pi))]
    while todo:
        ball, at, angle = todo.pop()
        if ball not in tree:
            yield ball, at, angle
            continue
        angles = _angles(units[at], tree[ball])
        near = angles.argmin(axis=1)
        angle = angles[np.arange(len(at)), near]
        order = near.argsort(kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
            if len(part):
                todo.append((f"{ball}.{near[part[0]]}", at[part], angle[part]))


def ball_tree(vectors: DataFrame, leaf: int = LEAF, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(members, nodes) for vectors (g, embedding): the ball of each vector (g, embedding, ball, angle), and all balls with parent, centre,
    radius (of all vectors below) and size.

    Each round splits all balls that are too large, each into as many as its size asks for, `fan` at most; the pivots of a ball come from a
    sample of it, the split itself takes all.  Only the centres are kept from round to round (one for some hundred vectors, on the driver): a pass
    over the vectors takes each down to its ball, so vectors are written once and never shuffled.  A ball whose vectors all point the same way stays as it is."""
    spark = vectors.sparkSession
    vectors = written(vectors.select("g", "embedding"), "ball-vectors")
    kind = vectors.schema["embedding"].dataType.simpleString()
    tree: dict[str, np.ndarray] = {}

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[float]] = {}
        for batch in batches:
            for ball, at, angle in _descend(_scaled(_rows(batch["embedding"])), tree) if len(batch) else ():
                x = found.setdefault(ball, [0, 0.0])
                x[:] = x[0] + len(at), max(x[1], float(angle.max()))
        yield pa.RecordBatch.from_pydict({"ball": pa.array(list(found), pa.string()), "size": pa.array([x[0] for x in found.values()], pa.int64()), "radius": pa.array([x[1] for x in found.values()], pa.float64())})

    def centers(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = int(min(fan, max(2, -(-2 * large[key[0]] // leaf))))
        found = far_split(np.stack(pdf.sort_values("g").embedding), parts)
        split = [(key[0], [c.tolist() for c in found])] if len(found) > 1 else []
        return pd.DataFrame(split, columns=["ball", "centers"], dtype=object)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, cut = _scaled(_rows(batch["embedding"])), batch["cut"].to_numpy()
            picked = [(ball, at[cut[at] * large[ball] < SAMPLE]) for ball, at, _ in _descend(units, tree) if ball in large] if len(batch) else []
            at = np.concatenate([x for _, x in picked] or [np.zeros(0, dtype=int)])
            balls = [ball for ball, x in picked for _ in x]
            yield pa.RecordBatch.from_pydict({"g": batch["g"].take(pa.array(at)), "ball": pa.array(balls, pa.string()), "embedding": pa.array(list(units[at]), pa.list_(pa.float64()))})

    def sizes() -> dict[str, tuple[int, float]]:
        found = vectors.select("embedding").mapInArrow(told, "ball string, size bigint, radius double").groupBy("ball").agg(F.sum("size").alias("size"), F.max("radius").alias("radius"))
        return {r.ball: (r["size"], r.radius) for r in found.collect()}

    first = vectors.agg(F.count("*").alias("size"), F.max(F.size("embedding")).alias("width")).first()
    nodes = [("0", None, [0.0] * (first.width or 0), float(np.pi), first.size)]
    large = {"0": first.size} if first.size > leaf else {}
    # evenly spread over 0 to 1, by the vector alone
    cut = (F.pmod(F.xxhash64("g", F.lit(3)), F.lit(1 << 30)) / (1 << 30)).alias("cut")
    while large:
        picked = vectors.select("g", "embedding", cut).mapInArrow(sample, "g bigint, ball string, embedding array<double>")
        split = {r.ball: np.array(r.centers) for r in picked.groupBy("ball").applyInPandas(centers, "ball string, centers array<array<double>>").collect()}
        if not split:
            break
        tree = tree | split
        filled = sizes()
        fresh = [(f"{ball}.{i}", ball, c.tolist(), filled[f"{ball}.{i}"][1], filled[f"{ball}.{i}"][0]) for ball, cs in split.items() for i, c in enumerate(cs) if f"{ball}.{i}" in filled]
        nodes += fresh
        large = {ball: size for ball, _, _, _, size in fresh if size > leaf}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            balls, angles = np.empty(len(batch), dtype=object), np.empty(len(batch))
            for ball, at, angle in _descend(_scaled(_rows(batch["embedding"])), tree) if len(batch) else ():
                balls[at], angles[at] = ball, angle
            yield pa.RecordBatch.from_pydict({"g": batch["g"], "embedding": batch["embedding"], "ball": pa.array(balls, pa.string()), "angle": pa.array(angles)})

    return vectors.mapInArrow(place, f"g bigint, embedding {kind}, ball string, angle double"), spark.createDataFrame(nodes, NODES)


def near_leaves(nodes: DataFrame, theta: float) -> DataFrame:
    """(a, b): ordered pairs of leaves that may hold two vectors within the angle `theta`.  Pairs go down from the root, level by level."""
    nodes = written(nodes, "ball-tree")
    inner = nodes.select(F.col("parent").alias("ball")).distinct()
    leaves = nodes.join(inner, "ball", "left_anti").select("ball")
    down = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("ball"), F.col("ball").alias("next")).unionByName(leaves.select("ball", F.col("ball").alias("next")))
    told = small(nodes.select("ball", "center", "radius"))
    side = lambda d, s: d.select(*[F.col(c).alias(f"{s}_{c}") for c in d.columns])

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cos = np.einsum("ij,ij->i", np.stack(pdf.l_center), np.stack(pdf.r_center))
                kept = np.arccos(np.clip(cos, -1, 1)) - pdf.l_radius - pdf.r_radius <= theta + SLACK
                yield pd.DataFrame({"a": pdf.l_ball[kept], "b": pdf.r_ball[kept]})

    pairs = nodes.filter("parent IS NULL").select(F.col("ball").alias("a"), F.col("ball").alias("b"))
    inside = lambda side: pairs.join(inner.withColumnRenamed("ball", side), side, "left_semi")
    while not inside("a").union(inside("b").select("a", "b")).isEmpty():
        wide = pairs.join(down.select(F.col("ball").alias("a"), F.col("next").alias("l_ball")), "a").join(down.select(F.col("ball").alias("b"), F.col("next").alias("r_ball")), "b")
        known = wide.select("l_ball", "r_ball").join(side(told, "l"), "l_ball").join(side(told, "r"), "r_ball")
        pairs = written(known.mapInPandas(close, "a string, b string"), "ball-pairs")
    return pairs


def tiles(nodes: DataFrame, most: int) -> DataFrame:
    """(ball, size, tile) of each leaf: its highest ball of at most `most` vectors, or itself.  Tiles are what is read to meet other tiles."""
    leaves = nodes.join(nodes.select(F.col("parent").alias("ball")).distinct(), "ball", "left_anti").select("ball", "size")
    steps = F.split("ball", r"\.")
    above = leaves.select(F.col("ball").alias("leaf"), F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "."))).alias("ball"))
    high = above.join(nodes.select("ball", "size"), "ball").filter(F.col("size") <= most).groupBy(F.col("leaf").alias("ball")).agg(F.min_by("ball", F.length("ball")).alias("tile"))
    return leaves.join(high, "ball", "left").select("ball", "size", F.coalesce("tile", "ball").alias("tile"))


def compared_share(nodes: DataFrame, pairs: DataFrame) -> float:
    """Share of all ordered pairs of vectors that lie in pairs of leaves to compare."""
    size = nodes.select("ball", "size")
    found = pairs.join(size.withColumnsRenamed({"ball": "a", "size": "n"}), "a").join(size.withColumnsRenamed({"ball": "b", "size": "m"}), "b").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    total = nodes.filter("parent IS NULL").first()["size"]
    return (found or 0) / max(1, total * total)


class _Tile:
    """A stored tile: ids, unit vectors, the same in single precision, and its leaves with centres and radii."""

    def __init__(self, row: dict):
        self.ids, balls = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["balls"], dtype=np.int64)
        self.vectors = _scaled(np.frombuffer(row["vectors"], dtype=row["kind"]).reshape(len(self.ids), -1))
        self.single = self.vectors.astype(np.float32)
        edges = np.r_[0, np.flatnonzero(np.diff(balls)) + 1, len(balls)]
        self.leaves = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        centers = np.array([self.vectors[x].mean(axis=0) for x in self.leaves])
        self.centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        self.radii = np.array([_angles(self.vectors[x], c[None])[:, 0].max() for x, c in zip(self.leaves, self.centers, strict=True)])

    def of(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the leaves with these numbers hold."""
        if len(leaves) == len(self.leaves):
            return self.ids, self.vectors, self.single
        at = np.concatenate([np.arange(self.leaves[i].start, self.leaves[i].stop) for i in leaves])
        return self.ids[at], self.vectors[at], self.single[at]


class _Best:
    """The first `keep` vectors above the threshold of each vector of one leaf, while tiles come by."""

    def __init__(self, tile: _Tile, leaf: int, keep: int, threshold: float):
        at = tile.leaves[leaf]
        self.ids, self.vectors, self.single, self.center, self.radius = tile.ids[at], tile.vectors[at], tile.single[at], tile.centers[leaf], tile.radii[leaf]
        self.keep, self.threshold = keep, threshold
        # what a further one must reach, rounded as it is ranked
        self.low = np.full(len(self.ids), threshold)
        self.row, self.other, self.similarity = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        self.waiting: list[tuple] = []
        # products of single precision are off by less
        self.off = (self.vectors.shape[1] + 8) * 1.2e-7

    def meet(self, tile: _Tile, held: np.ndarray, hit: np.ndarray) -> None:
        """`held` and `hit` are room for CHUNK products and what is found among them."""
        theta = float(np.arccos(np.clip(self.low.min() - 2e-9, -1, 1)))
        near = np.flatnonzero(_angles(self.center[None], tile.centers)[0] - self.radius - tile.radii <= theta + SLACK)
        if not len(near):
            return
        ids, vectors, single = tile.of(near)
        step = max(1, CHUNK // len(self.ids))
        for start in range(0, len(ids), step):
            some = single[start:start + step]
            size = len(self.ids) * len(some)
            products = np.matmul(self.single, some.T, out=held[:size].reshape(len(self.ids), -1))
            floor = (self.low - 2e-9 - self.off).astype(np.float32) - np.float32(1e-7)
            np.greater_equal(products, floor[:, None], out=hit[:size].reshape(products.shape))
            # eight at a time: there are few
            hit[size:-(-size // 8) * 8] = False
            some8 = np.flatnonzero(hit[:-(-size // 8) * 8].view(np.uint64))
            if not len(some8):
                continue
            found = (some8[:, None] * 8 + np.arange(8)).ravel()
            r, c = np.divmod(found[hit[found]], len(some))
            exact = np.einsum("ij,ij->i", self.vectors[r], vectors[start + c])
            kept = (exact >= self.threshold) & (exact >= self.low[r] - 2e-9)
            self.waiting.append((r[kept], ids[start + c[kept]], exact[kept]))
            if sum(len(x[0]) for x in self.waiting) > 2 * len(self.ids):
                self.settle()

    def settle(self) -> None:
        """Ranks what has come up since the last time."""
        if self.waiting:
            self.take(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)))
            self.waiting = []

    def take(self, row: np.ndarray, other: np.ndarray, similarity: np.ndarray) -> None:
        row, other, similarity = np.concatenate([self.row, row]), np.concatenate([self.other, other]), np.concatenate([self.similarity, similarity])
        ranked = similarity.round(9)
        order = np.lexsort((other, -ranked, row))
        row = row[order]
        first = np.r_[True, row[1:] != row[:-1]]
        rank = np.arange(len(row)) - np.flatnonzero(first)[first.cumsum() - 1]
        kept = order[rank < self.keep]
        full = order[rank == self.keep - 1]
        self.row, self.other, self.similarity = row[rank < self.keep], other[kept], similarity[kept]
        self.low[row[rank == self.keep - 1]] = np.maximum(ranked[full], self.threshold)


def similar_pairs(vectors: DataFrame, k: int = NEIGHBOURS, threshold: float = THRESHOLD, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Nearest neighbours per article with at least the threshold: (article_id, neighbour_id, similarity, rn).

    vectors: (article_id, embedding).  Leaves have at most `leaf` vectors each, but for those that point the same way.  Leaves are stored by tiles,
    a row each.  A task holds a tile, streams the tiles near it from the table and keeps the best of each vector: nothing is shuffled between."""
    spark = vectors.sparkSession
    theta = float(np.arccos(np.clip(threshold, -1, 1)))
    given = vectors.schema["embedding"].dataType
    # single precision stays so where it lies on disk
    kind = "array<float>" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "array<double>"
    v = vectors.filter(F.col("embedding").isNotNull()).select("article_id", F.col("embedding").cast(kind).alias("embedding")).withColumn("g", F.xxhash64(F.col("embedding").cast("array<double>")))
    members, nodes = ball_tree(v.groupBy("g").agg(F.first("embedding").alias("embedding")), leaf, fan)
    nodes = written(nodes, "ball-nodes")
    total = nodes.filter("parent IS NULL").first()["size"]
    most = int(min(leaf * fan, max(leaf, total // (TILES_PER_CORE * spark.sparkContext.defaultParallelism))))
    # a leaf of equal directions may be larger than a tile: it is dealt into parts
    tile = written(tiles(nodes, most).withColumn("leaf", F.xxhash64("ball")), "ball-tiles")
    upper = nodes.join(small(tile.select(F.col("tile").alias("ball")).distinct().withColumn("whole", F.lit(True))), "ball", "left").filter(F.col("whole") | (F.col("size") > most)).drop("whole")
    near = near_leaves(upper, theta).groupBy(F.col("a").alias("tile")).agg(F.collect_set("b").alias("near"))
    parts = F.ceil(F.col("size") / most).cast("int")
    homes = members.join(small(tile), "ball").select("g", "embedding", "leaf", "tile", F.when(F.col("size") > most, F.pmod(F.xxhash64("g", F.lit(7)), parts)).otherwise(F.lit(0)).cast("int").alias("part"))
    number = "<f4" if kind == "array<float>" else "<f8"

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("leaf", "ascending"), ("g", "ascending")]).combine_chunks()
        one = lambda c, kind: [table[c].to_numpy().astype(kind).tobytes()]
        return pa.table({"tile": [key[0].as_py()], "part": pa.array([key[1].as_py()], pa.int32()), "ids": one("g", "<i8"), "balls": one("leaf", "<i8"), "vectors": [_rows(table["embedding"].chunk(0)).astype(number).tobytes()], "kind": [number]})

    # a partition for each tile, so that tasks are as many
    cells = max(1, -(-2 * total // most))
    stored = written(homes.repartition(cells, "tile", "part").groupBy("tile", "part").applyInArrow(packed, "tile string, part int, ids binary, balls binary, vectors binary, kind string"), "ball-cells")
    own = stored.join(small(near), "tile").select(*[F.col(c).alias(f"q_{c}") for c in stored.columns], "near").repartition(cells, "q_tile", "q_part")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[_Best]] = {}
        room = np.empty(0, dtype=np.float32), np.empty(0, dtype=bool)
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["q_tile"], row["q_part"])
                if key not in held:
                    mine = _Tile({c: row[f"q_{c}"] for c in ("ids", "balls", "vectors", "kind")})
                    held[key] = [_Best(mine, i, k + 1, threshold) for i in range(len(mine.leaves))]
                    # a whole leaf against one vector is the least that is held
                    size = max(CHUNK, -(-max(len(x.ids) for x in held[key]) // 8) * 8)
                    if size > len(room[0]):
                        room = np.empty(size, dtype=np.float32), np.empty(size, dtype=bool)
                tile = _Tile(row)
                for x in held[key]:
                    x.meet(tile, *room)
        for found in held.values():
            for x in found:
                x.settle()
                yield pa.RecordBatch.from_pydict({"a": x.ids[x.row], "b": x.other, "similarity": x.similarity})

    # the left side is one stream that every task reads for itself, the right side the tiles that tasks hold
    met = stored.coalesce(1).hint("shuffle_replicate_nl").join(own, F.expr("array_contains(near, tile)")).drop("near")
    size, batch = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(size, BATCH_TILES)
    try:
        top = written(met.mapInArrow(best, "a bigint, b bigint, similarity double"), "ball-near")
    finally:
        spark.conf.set(size, batch)
    # copies: every article of a vector sees the first k + 1 articles of a neighbouring vector
    few = top_per_group(v.select("g", "article_id"), ["g"], [F.asc("article_id")], k + 1, spread=["article_id"]).select(F.col("g").alias("b"), F.col("article_id").alias("neighbour_id"))
    near = v.select(F.col("g").alias("a"), "article_id").join(top, "a").join(few, "b").filter(F.col("article_id") != F.col("neighbour_id"))
    rank = F.row_number().over(W.partitionBy("article_id").orderBy(F.desc(F.round("similarity", 9)), "neighbour_id"))
    return near.withColumn("rn", rank).filter(F.col("rn") <= k).select("article_id", "neighbour_id", "similarity", "rn")


# --- clusters -----------------------------------------------------------------------------------------------------------------
def leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): those that come up in order with no earlier leader having taken them.  `edges` (a, b), a < b: a takes b if it is a leader.

    In rounds: a node without an undecided earlier neighbour leads, and who has a leader before it does not.  A node with one undecided earlier
    neighbour leads if that one does not; such pointers are doubled every round, so a chain of n nodes takes log n rounds.
    """
    state = written(nodes.select("node").distinct().withColumn("leads", F.lit(None).cast("boolean")), "cluster-state")
    edges = written(edges.distinct(), "cluster-edges")
    ptr = None
    while True:
        into = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"), F.max("a").alias("up"))
        fresh = into.filter("n = 1").select("node", "up", F.lit(True).alias("flip"))
        if ptr is not None:
            fresh = ptr.unionByName(fresh.join(ptr.select("node"), "node", "left_anti"))
        far = fresh.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("flip").alias("flip2"))
        ptr = written(fresh.join(far, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), F.when(F.col("up2").isNull(), F.col("flip")).otherwise(F.col("flip") != F.col("flip2")).alias("flip")), "cluster-pointers")
        free = state.join(into.select("node", "n"), "node", "left").withColumn("leads", F.coalesce("leads", F.when(F.col("n").isNull(), True))).select("node", "leads")
        known = free.filter("leads IS NOT NULL").select(F.col("node").alias("up"), F.col("leads").alias("up_leads"))
        by_chain = ptr.join(known, "up").select("node", (F.col("flip") != F.col("up_leads")).alias("chain"))
        taken = edges.join(known.filter("up_leads").select(F.col("up").alias("a")), "a").select(F.col("b").alias("node")).distinct().withColumn("taken", F.lit(True))
        new = free.join(by_chain, "node", "left").join(taken, "node", "left").select("node", F.coalesce("leads", F.when(F.col("taken"), False), "chain").alias("leads"))
        state = written(new, "cluster-state")
        open_ = state.filter("leads IS NULL").select("node")
        if open_.isEmpty():
            return state.filter("leads").select("node")
        settled = state.filter("leads IS NOT NULL")
        # who has a leader before it is decided; what those who do not lead might take is free of them
        edges = written(edges.join(open_.withColumnRenamed("node", "b"), "b", "left_semi").join(settled.filter("NOT leads").select(F.col("node").alias("a")), "a", "left_anti"), "cluster-edges")


def resolved(pointers: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, up) whose roots point to themselves, by pointer doubling."""
    now = written(pointers.select("node", "up"), "cluster-forest")
    while True:
        nxt = written(now.join(now.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "cluster-forest")
        now = nxt.select("node", "up")
        if nxt.filter("moved").isEmpty():
            return now.withColumnRenamed("up", "root")


def assign_clusters(pairs: DataFrame, existing: DataFrame | None = None, articles: DataFrame | None = None) -> DataFrame:
    """Cluster of each article: (cluster_id, article_id, similarity).

    Articles come up in the order of their ids; those that have a cluster, from before (`existing`) or by an earlier one, are passed over.
    One that comes up joins the cluster of its best neighbour that has one, else it starts a cluster named by its id; then all its
    neighbours without a cluster join too.  Similarity is 1 for an article that came up, else that to the one that took it in.
    `articles` adds articles without neighbours.

    The sequence is resolved as a forest: who comes up (`leaders`), who takes in whom (the earliest that can), and to whom each one that comes up
    points: its best neighbour that is earlier or was taken in earlier.  Pointers are doubled until all end at roots.
    """
    pairs = written(pairs.select("article_id", "neighbour_id", "similarity"), "cluster-pairs")
    nodes = pairs.select(F.col("article_id").alias("node")).union(pairs.select("neighbour_id"))
    if articles is not None:
        nodes = nodes.union(articles.select("article_id"))
    nodes = nodes.distinct()
    known = None if existing is None else existing.select(F.col("article_id").alias("node"), "cluster_id")
    fresh = nodes if known is None else nodes.join(known.select("node"), "node", "left_anti")
    fresh = written(fresh, "cluster-nodes")
    takes = pairs.select(F.col("article_id").alias("a"), F.col("neighbour_id").alias("b"), "similarity")
    free = takes.join(fresh.withColumnRenamed("node", "a"), "a", "left_semi").join(fresh.withColumnRenamed("node", "b"), "b", "left_semi").filter("a < b")
    lead = written(leaders(fresh, free.select("a", "b")), "cluster-leaders")
    # the earliest leader takes in
    taken = free.join(lead.withColumnRenamed("node", "a"), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min(F.struct("a", "similarity")).alias("x"))
    taken = written(taken.join(lead, "node", "left_anti").select("node", F.col("x.a").alias("by"), "x.similarity"), "cluster-taken")
    # when each article has its cluster: from before, when it came up, or when it was taken in
    since = lead.select("node", F.col("node").alias("since")).unionByName(taken.select("node", F.col("by").alias("since")))
    if known is not None:
        since = since.unionByName(known.select("node", F.lit(-(2**63)).cast("bigint").alias("since")).join(nodes, "node", "left_semi"))
    asked = pairs.join(lead.withColumnRenamed("node", "article_id"), "article_id", "left_semi").join(since.withColumnRenamed("node", "neighbour_id"), "neighbour_id").filter("since < article_id")
    best = asked.groupBy(F.col("article_id").alias("node")).agg(F.min_by("neighbour_id", F.struct(-F.round("similarity", 9), "neighbour_id")).alias("up"))
    up = lead.join(best, "node", "left").select("node", F.coalesce("up", "node").alias("up")).unionByName(taken.select("node", F.col("by").alias("up")))
    if known is not None:
        up = up.unionByName(known.join(nodes, "node", "left_semi").select("node", F.col("node").alias("up")))
    roots = resolved(up)
    if known is None:
        named = roots.withColumn("cluster_id", F.col("root"))
    else:
        named = roots.join(known.withColumnRenamed("node", "root"), "root", "left").withColumn("cluster_id", F.coalesce("cluster_id", "root")).join(fresh, "node", "left_semi")
    return named.join(taken.select("node", "similarity"), "node", "left").select("cluster_id", F.col("node").alias("article_id"), F.coalesce("similarity", F.lit(1.0)).alias("similarity"))


def with_clusters(t_clusters: DataFrame | None, assigned: DataFrame) -> DataFrame:
    """Stored assignments plus the new ones."""
    return assigned if t_clusters is None else t_clusters.unionByName(assigned.join(t_clusters.select("article_id"), "article_id", "left_anti").select(*t_clusters.columns))
