"""Mixing overlapping sources to target weights by minimum-cost flow.

Documents are added up by membership pattern (the set of sources a document belongs to).  Token capacity flows from
patterns to source quotas: the first pass over a pattern costs nothing, each further pass costs more (convex costs), so
repetition is used only where a quota needs it and where it is cheapest.  The flow is solved on the driver over one row
per pattern.  Documents of a pattern lie on a tape in seeded hash order; a flow of F tokens takes the tape's first F
tokens, pass after pass.  Each cut of the tape becomes the hash of the last document before it, so choosing documents
is a comparison against a small table: no text is ever shuffled.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null or empty list of
sources belongs to no source and is never taken; rows with the same id get the same decision; empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pressdelta.llm.common import WORD, store, text_of

# price of a token in the first, second and third pass over its document
REPEAT_COSTS = (0, 1, 3)
# rows the driver holds: one per membership pattern that occurs; more raise an error, nothing is left out
MAX_PATTERNS = 100_000
# slices of the hash order whose running sums are worked on separately; the cut does not depend on it
SLICE_DIGITS = 3
EVERYTHING = "~"


def size_of(text: str | Column) -> Column:
    """Words of a text."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def key_of(sources: Column) -> Column:
    """Membership pattern as a string: distinct sources in order, null last."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def order_of(doc_id: str | Column, seed: int) -> Column:
    """Place of a document in the seeded order, 32 hexadecimal digits."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))).cast("binary"))


def fill(sizes: Sequence[int], weights: Sequence[float], most: int) -> list[float]:
    """Targets in proportion to `weights` that add up to all sizes and stop at `most` times a source's size; what is above is shared
    again by weight among the others, until none is above."""
    total, open_, targets = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = total / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * share > most * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = weights[i] * share
            break
        for i in above:
            targets[i] = float(most * sizes[i])
            total -= targets[i]
        open_ = [i for i in open_ if i not in above]
    return targets


def route(patterns: Mapping[str, tuple[Sequence[int], int]], quotas: Sequence[int], costs: Sequence[int] = REPEAT_COSTS) -> dict[str, dict[int, int]]:
    """Minimum-cost flow.  patterns: name -> (its sources' numbers, tokens).  Returns tokens per pattern and source.

    Successive cheapest augmenting paths with potentials; arcs are kept with their reverse, side by side.
    """
    names = sorted(patterns)
    n, first_quota, sink = len(names), 1 + len(names), 1 + len(names) + len(quotas)
    to, room, price, leaving = [], [], [], [[] for _ in range(sink + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> int:
        for u, v, c, p in ((a, b, capacity, cost), (b, a, 0, -cost)):
            leaving[u].append(len(to))
            to.append(v)
            room.append(c)
            price.append(p)
        return len(to) - 2

    carries = {}
    for i, name in enumerate(names):
        members, tokens = patterns[name]
        for cost in costs:
            arc(0, 1 + i, tokens, cost)
        for s in members:
            carries[i, s] = arc(1 + i, first_quota + s, len(costs) * tokens, 0)
    for s, quota in enumerate(quotas):
        arc(first_quota + s, sink, quota, 0)

    potential = [0] * (sink + 1)
    while True:
        best, via, heap = [None] * (sink + 1), [-1] * (sink + 1), [(0, 0)]
        best[0] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            for e in leaving[u]:
                if room[e] > 0 and (best[to[e]] is None or d + price[e] + potential[u] - potential[to[e]] < best[to[e]]):
                    best[to[e]], via[to[e]] = d + price[e] + potential[u] - potential[to[e]], e
                    heapq.heappush(heap, (best[to[e]], to[e]))
        if best[sink] is None:
            break
        potential = [p + (b if b is not None else best[sink]) for p, b in zip(potential, best)]
        path, v = [], sink
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    flows: dict[str, dict[int, int]] = {name: {} for name in names}
    for (i, s), e in carries.items():
        if room[e ^ 1]:
            flows[names[i]][s] = room[e ^ 1]
    return flows


@dataclass(frozen=True)
class Mix:
    """`sources`: (source, source_size, target) per source.  `cuts`: per pattern and pass, up to which hash a source takes the
    documents.  Both are small: one row per source, and per pattern."""
    sources: DataFrame
    cuts: DataFrame
    passes: int
    seed: int

    def copies(self, rows: DataFrame, doc_id: Column, sources: Column, out: str = "copies") -> DataFrame:
        """Add `out`: for each copy of the document that the mix takes, the source it counts for."""
        keyed = rows.withColumn("__mix_key", key_of(sources)).withColumn("__mix_order", order_of(doc_id, self.seed))
        cuts = self.cuts.select(F.col("key").alias("__mix_key"), F.col("cuts").alias("__mix_cuts"))
        joined = keyed.join(F.broadcast(cuts), "__mix_key", "left")  # at most MAX_PATTERNS rows
        taken = F.transform(F.sequence(F.lit(0), F.lit(self.passes - 1)), lambda k: F.get(F.filter("__mix_cuts", lambda c: (c["k"] == k) & (F.col("__mix_order") <= c["cut"])), F.lit(0)))
        return joined.withColumn(out, F.coalesce(F.transform(F.filter(taken, lambda c: c.isNotNull()), lambda c: c["source"]), F.array().cast("array<string>"))).drop("__mix_key", "__mix_order", "__mix_cuts")


def plan_mix(spark: SparkSession, rows: DataFrame, weigh, doc_id: str = "id", sources: str = "sources", size: str = "size", costs: Sequence[int] = REPEAT_COSTS, seed: int = 1) -> Mix:
    """Plan a mix of `rows` (id, sources array<string>, size).  `weigh(number)` gives the weight of a source by its number in order."""
    spots = store(rows.select(key_of(F.col(sources)).alias("key"), F.array_sort(F.array_distinct(F.col(sources))).alias("sources"), F.col(size).cast("long").alias("size"), order_of(doc_id, seed).alias("place")), "mix-rows")
    found = spots.groupBy("key").agg(F.any_value("sources").alias("sources"), F.sum("size").alias("tokens")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: merge sources first")
    names = sorted({s for r in found for s in r["sources"] or []}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    patterns = {r["key"]: ([number[s] for s in r["sources"]], int(r["tokens"])) for r in found if r["sources"]}
    sizes = [0] * len(names)
    for members, tokens in patterns.values():
        for s in members:
            sizes[s] += tokens
    targets = fill(sizes, [float(weigh(i)) for i in range(len(names))], len(costs))
    # an overlapping document counts in each of its sources' sizes, but the mix as a whole is as large as the corpus
    corpus, wanted = sum(t for _, t in patterns.values()), sum(targets)
    targets = [t * corpus / wanted for t in targets] if wanted and wanted != corpus and sum(sizes) != corpus else targets
    flows = route(patterns, [int(t + 0.5) for t in targets], costs)

    whole, open_ = [], []
    for key, (_, tokens) in patterns.items():
        end = 0
        for s, flow in sorted(flows[key].items()):
            end += flow
            for k in range(len(costs)):
                if end >= (k + 1) * tokens:
                    whole.append((key, k, end, names[s], EVERYTHING))
                elif end > k * tokens:
                    open_.append((key, k, end, names[s], tokens))
    slices = spots.withColumn("slice", F.substring("place", 1, SLICE_DIGITS))
    sums = slices.groupBy("key", "slice").agg(F.sum("size").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("key").orderBy("slice")) - F.col("n")).drop("n")
    inside = slices.withColumn("within", F.sum("size").over(W.partitionBy("key", "slice").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    wanted_cuts = spark.createDataFrame(open_, "key string, k int, end long, source string, tokens long")
    placed = inside.join(before, ["key", "slice"]).join(F.broadcast(wanted_cuts), "key")  # at most one open cut per pattern and source
    middle = 2 * (F.col("k") * F.col("tokens") + F.col("before") + F.col("within")) + F.col("size")
    reached = placed.filter(middle < 2 * F.col("end")).groupBy("key", "k", "end", "source").agg(F.max("place").alias("cut"))
    cuts = reached.unionByName(spark.createDataFrame(whole, "key string, k int, end long, source string, cut string"))
    cuts = cuts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "end", "source", "cut"))).alias("cuts"))
    listed = spark.createDataFrame(list(zip(names, sizes, targets)), "source string, source_size long, target double")
    return Mix(listed, store(cuts, "mix-cuts"), len(costs), seed)


def weight_of(number: int) -> int:
    """Weights of the standing query: 5, 2, 1, repeating."""
    return (5, 2, 1)[number % 3]


def mixed(spark: SparkSession, docs: DataFrame, seed: int = 1) -> DataFrame:
    """Documents with one source each: size, the source's size and target, and the words the mix takes of the document."""
    rows = store(docs.select("doc_id", F.array("source").alias("sources"), size_of("text").alias("size")), "mix-docs")
    mix = plan_mix(spark, rows, weight_of, doc_id="doc_id", seed=seed)
    got = mix.copies(rows, F.col("doc_id"), F.col("sources"))
    named = mix.sources.select(F.to_json(F.array("source")).alias("key"), "source_size", "target")
    return (got.withColumn("key", F.to_json("sources")).join(F.broadcast(named), "key")
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken")))
