"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Every row descends the tree.  At each level the children draw: the draw of a child is an exponential variable with the
child's weight as its rate, made from the hash of the key and the child's name, and the smallest draw wins.  A child
wins in proportion to its weight; when a weight grows, only the draws of the subtrees above it get smaller.  So at every level rows move
only into the child that grew or out of the one that shrank, and never between two others.  Added shards each stand as a
region of their own until the tree is laid out anew, so a new shard takes rows only into itself.

Built-in functions only.  Slots number the rows of a shard without gaps: rows are numbered inside hash slices of a shard, and a
slice starts after the ones before it, so no task holds a whole shard.

Defined cases: a null key hashes as null, all null keys share a shard; a null text has no bytes and the checksum of
empty bytes; repeated rows get their own slots; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta.llm.common import digest64, text_of

SLICES = 1024
ROW_BYTES = 16


@dataclass(frozen=True)
class Node:
    """A subtree: leaves carry the shard number."""
    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def branch(name: str, children: Sequence[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), tuple(children))


def layout(shards: int, regions: int = 2, racks: int = 4, per_rack: int = 5, weights: dict[int, float] | None = None) -> Node:
    """Tree of `shards` shards.  The first regions x racks x per_rack fill the grid in order; every later one is its own region."""
    weights = weights or {}
    leaf = lambda s: Node(f"shard{s}", float(weights.get(s, 1.0)), (), s)
    grid, tree = min(shards, regions * racks * per_rack), []
    for r in range(regions):
        rows = []
        for k in range(racks):
            start = (r * racks + k) * per_rack
            own = [leaf(s) for s in range(start, min(start + per_rack, grid))]
            if own:
                rows.append(branch(f"rack{r * racks + k}", own))
        if rows:
            tree.append(branch(f"region{r}", rows))
    tree += [branch(f"added-region{s}", [branch(f"added-rack{s}", [leaf(s)])]) for s in range(grid, shards)]
    return branch("root", tree)


def draw(key: Column, node: Node) -> Column:
    """Exponential draw of a child: 53 bits of the hash as a uniform number over (0, 1], minus its logarithm, over the weight."""
    uniform = (F.shiftrightunsigned(digest64(key, node.name), 11).cast("double") + 1) / F.lit(float(2**53))
    return -F.log(uniform) / F.lit(node.weight)


def winner(key: Column, children: Sequence[Node]) -> Column:
    """Number of the child with the smallest draw.  Children without weight are never drawn."""
    open_ = [(i, c) for i, c in enumerate(children) if c.weight > 0]
    if len(open_) < 2:
        return F.lit(open_[0][0] if open_ else 0)
    return F.array_min(F.array(*[F.struct(draw(key, c).alias("draw"), F.lit(i).alias("child")) for i, c in open_]))["child"]


def descend(rows: DataFrame, key: str, tree: Node, out: str) -> DataFrame:
    """Add the shard of a key as `out`: one column per level, and each level draws only inside the subtree reached."""
    regions = tree.children
    racks = [k for r in regions for k in r.children]
    first = [sum(len(r.children) for r in regions[:i]) for i in range(len(regions))]
    choose = lambda column, options: F.coalesce(*[F.when(F.col(column) == i, o) for i, o in enumerate(options)])
    at_region = rows.withColumn("__region", winner(F.col(key), regions))
    at_rack = at_region.withColumn("__rack", choose("__region", [F.lit(first[i]) + winner(F.col(key), r.children) for i, r in enumerate(regions)]))
    leaves = [F.element_at(F.array(*[F.lit(leaf.shard) for leaf in k.children]), winner(F.col(key), k.children) + 1) for k in racks]
    return at_rack.withColumn(out, choose("__rack", leaves).cast("int")).drop("__region", "__rack")


def shard_of(rows: DataFrame, key: str, shards: int, out: str = "shard", **shape) -> DataFrame:
    return descend(rows, key, layout(shards, **shape), out)


def with_slots(rows: DataFrame, shard: str, order: Sequence[str], out: str = "slot", slices: int = SLICES) -> DataFrame:
    """Gapless numbers from 0 within each shard."""
    cut = rows.withColumn("__slice", F.pmod(digest64(*[F.col(c) for c in order]), F.lit(slices)).cast("int"))
    numbered = cut.withColumn("__n", F.row_number().over(W.partitionBy(shard, "__slice").orderBy(*order)))
    ends = numbered.groupBy(shard, "__slice").agg(F.count(F.lit(1)).alias("__rows"))
    starts = ends.withColumn("__start", F.sum("__rows").over(W.partitionBy(shard).orderBy("__slice")) - F.col("__rows")).drop("__rows")
    # one row per shard and slice: the tree and `slices` bound it
    return numbered.join(F.broadcast(starts), [shard, "__slice"]).withColumn(out, (F.col("__start") + F.col("__n") - 1).cast("long")).drop("__slice", "__n", "__start")


def placed(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and size of every document, and its shard after one more shard was added."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(text_of(text)) + ROW_BYTES).cast("long").alias("size"), F.crc32(text_of(text).cast("binary")).alias("text_crc32"))
    rows = shard_of(shard_of(rows, "doc_id", shards, "shard"), "doc_id", shards + 1, "grown_shard")
    return with_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
