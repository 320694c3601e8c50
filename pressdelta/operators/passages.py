"""Passages of two texts that belong together: candidates by shared tokens, then a matching in order of the new passages.

Each new passage, in its order, takes the most similar old passage that is left, if that is similar enough.  The result of this
sequence is found set-wise, in rounds (`matched_in_order`).  Candidates come from a prefix filter: two token sets with a Jaccard similarity of t share a token among the first
n - ceil(t n) + 1 of each in any common order, so only those tokens are joined; long words come first, as they are rare.
"""

from __future__ import annotations

from collections.abc import Sequence
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta.functions.text import collapse_ws, let, letter_tokens, set_jaccard
from pressdelta.session import checkpoint_dir

CHANGE_LIST = "array<struct<old:string,new:string>>"
CONTEXT = 140


def scored_passages(items: DataFrame, keys: Sequence[str], threshold: float, lead_chars: int | None = None) -> DataFrame:
    """(keys, old_pos, new_pos, tier, score): old and new passages that are similar enough.

    `items` is (keys, old boolean, pos, text).  Score is the Jaccard similarity of the tokens, at least the threshold (tier 0); with
    `lead_chars`, others that begin with at least so many equal characters count by their number (tier 1), after all of tier 0.
    """
    keys = list(keys)
    t = items.select(*keys, "old", "pos", letter_tokens(F.col("text")).alias("tokens"), F.lower(collapse_ws(F.col("text"))).alias("plain"))
    order = F.array_sort(F.transform("tokens", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    first = F.size("tokens") - F.ceil(F.size("tokens") * F.lit(threshold)).cast("int") + 1
    marks = F.transform(F.slice(order, F.lit(1), F.greatest(first, F.lit(0))), lambda x: x["w"])
    if lead_chars is not None:
        marks = F.concat(marks, F.when(F.length("plain") >= lead_chars, F.array(F.concat(F.lit("\n"), F.substring("plain", 1, lead_chars)))).otherwise(F.array().cast("array<string>")))
    marked = t.select(*keys, "old", "pos", F.explode(F.array_distinct(marks)).alias("mark"))
    side = lambda d, old: d.filter(F.col("old") == old).withColumnRenamed("pos", "old_pos" if old else "new_pos").drop("old")
    maybe = side(marked, True).join(side(marked, False), [*keys, "mark"]).select(*keys, "old_pos", "new_pos").distinct()
    full = maybe.join(side(t, True).withColumnsRenamed({"tokens": "a", "plain": "pa"}), [*keys, "old_pos"]).join(side(t, False).withColumnsRenamed({"tokens": "b", "plain": "pb"}), [*keys, "new_pos"])
    alike = set_jaccard(F.col("a"), F.col("b"))
    tier, score = F.when(alike >= threshold, 0), F.when(alike >= threshold, alike)
    if lead_chars is not None:
        lead = lambda c: F.substring(c, 1, lead_chars)
        long = (F.length("pa") >= lead_chars) & (F.length("pb") >= lead_chars) & (lead("pa") == lead("pb"))
        tier, score = F.coalesce(tier, F.when(long, 1)), F.coalesce(score, F.when(long, common_length(F.col("pa"), F.col("pb")).cast("double")))
    return full.select(*keys, "old_pos", "new_pos", tier.alias("tier"), score.alias("score")).filter(F.col("score").isNotNull())


def matched_in_order(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, old_pos, new_pos): the pairs that arise when the new passages, by position, each take their best old passage that is left.

    Best is by tier, score and position of the old passage.  In a round every new passage asks for the best of its list; the first of those that
    ask for an old passage bars it to all later ones.  New passages with the same list ask for different entries at once, the
    r-th for the r-th, as those before it are sure to take the ones before.  When a round bars nothing, every request stands.  A list gets
    shorter in every round it does not stand, so the rounds end; pairs without a rival need none.
    """
    keys, spark = list(keys), edges.sparkSession
    checkpoint_dir(spark)
    best = F.struct("tier", (-F.col("score")).alias("score"), "old_pos").alias("best")
    all_ = edges.select(*keys, "old_pos", "new_pos", best).checkpoint()
    rivals = all_.withColumns({"__o": F.count("*").over(W.partitionBy(*keys, "old_pos")), "__n": F.count("*").over(W.partitionBy(*keys, "new_pos"))})
    alone = rivals.filter("__o = 1 AND __n = 1").select(*keys, "old_pos", "new_pos")
    live = rivals.filter("__o > 1 OR __n > 1").drop("__o", "__n").checkpoint()
    left = live.count()
    while left:
        lists = live.groupBy(*keys, "new_pos").agg(F.transform(F.array_sort(F.collect_list("best")), lambda x: x["old_pos"]).alias("wanted"))
        turn = F.row_number().over(W.partitionBy(*keys, "wanted").orderBy("new_pos")) - 1
        asked = lists.withColumn("old_pos", F.get("wanted", turn)).filter("old_pos IS NOT NULL").groupBy(*keys, "old_pos").agg(F.min("new_pos").alias("__first"))
        live = live.join(asked, [*keys, "old_pos"], "left").filter("__first IS NULL OR new_pos <= __first").drop("__first").checkpoint()
        before, left = left, live.count()
        if left == before:
            settled = asked.select(*keys, "old_pos", F.col("__first").alias("new_pos")).checkpoint()
            return alone.unionByName(settled)
    return alone


def match_passages(items: DataFrame, keys: Sequence[str], threshold: float, lead_chars: int | None = None) -> DataFrame:
    """(keys, old_pos, new_pos) of passages that belong together; `items` as of `scored_passages`."""
    return matched_in_order(scored_passages(items, keys, threshold, lead_chars), keys)


def paired(items: DataFrame, keys: Sequence[str], threshold: float, lead_chars: int | None = None) -> DataFrame:
    """(keys, place, old, new): every passage once, with its partner or alone; new ones in their order, then lone old ones."""
    keys = list(keys)
    pairs = match_passages(items, keys, threshold, lead_chars)
    olds = items.filter("old").select(*keys, F.col("pos").alias("old_pos"), F.col("text").alias("old"))
    news = items.filter("NOT old").select(*keys, F.col("pos").alias("new_pos"), F.col("text").alias("new"))
    joined = olds.join(pairs, [*keys, "old_pos"], "left").join(news, [*keys, "new_pos"], "full")
    place = F.struct(F.when(F.col("new").isNull(), 1).otherwise(0).alias("lone"), F.coalesce(F.when(F.col("new").isNotNull(), F.col("new_pos")), F.col("old_pos")).alias("pos"))
    return joined.select(*keys, place.alias("place"), "old", "new")


def listed(rows: DataFrame, keys: Sequence[str], out: str = "changes") -> DataFrame:
    """(keys, changes) from (keys, place, old, new)."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "old", "new"))).alias("x")).select(*keys, F.transform("x", lambda c: F.struct(c["old"].alias("old"), c["new"].alias("new"))).alias(out))


def common_length(a: Column, b: Column) -> Column:
    """Number of equal leading characters, bit by bit from the largest."""
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    def grow(p: Column, k: Column) -> Column:
        return F.when((p + k <= F.least(F.length(a), F.length(b))) & (F.substring(a, 1, p + k) == F.substring(b, 1, p + k)), p + k).otherwise(p)
    return F.aggregate(steps, F.lit(0), grow)


def diff_region(old: Column, new: Column, context: int = CONTEXT) -> Column:
    """struct<old, new>: the differing middle of two texts with some context; cut ends are marked with an ellipsis."""
    def window(s: Column, head: Column, tail: Column) -> Column:
        start, end = F.greatest(head - context, F.lit(0)), F.least(F.length(s), F.length(s) - tail + context)
        return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), F.substring(s, start + 1, end - start), F.when(end < F.length(s), F.lit("…")).otherwise(""))
    def cut(head: Column) -> Column:
        rest = lambda s: F.reverse(F.substring(s, head + 1, F.length(s)))
        return let(common_length(rest(old), rest(new)), lambda tail: F.struct(window(old, head, tail).alias("old"), window(new, head, tail).alias("new")))
    return let(common_length(old, new), cut)


def list_changes(rows: DataFrame, keys: Sequence[str], removed: str, added: str, threshold: float = 0.35) -> DataFrame:
    """(keys, changes): structured difference of two paragraph lists.  Of a changed paragraph only the differing region is kept;
    one whose regions are equal shows nothing and is left out.  Keys without anything to show are missing."""
    keys = list(keys)
    side = lambda c, old: rows.select(*keys, F.lit(old).alias("old"), F.posexplode(c).alias("pos", "text"))
    both = paired(side(removed, True).unionByName(side(added, False)), keys, threshold)
    region = both.withColumn("r", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), diff_region(F.col("old"), F.col("new"))))
    shown = region.select(*keys, "place", F.coalesce("r.old", "old").alias("old"), F.coalesce("r.new", "new").alias("new")).filter(~F.coalesce(F.col("old") == F.col("new"), F.lit(False)))
    return listed(shown, keys)


# --- the same for the two lists one stream row holds --------------------------------------------------------------------
def region_of(old: str, new: str, context: int = CONTEXT) -> tuple[str, str]:
    head = len(commonprefix([old, new]))
    tail = len(commonprefix([old[head:][::-1], new[head:][::-1]]))
    start = max(0, head - context)
    ends = [min(len(s), len(s) - tail + context) for s in (old, new)]
    first, second = (("…" if start else "") + s[start:e] + ("…" if e < len(s) else "") for s, e in zip((old, new), ends))
    return first, second


def changes_of(removed: Sequence[tuple[str, Sequence[str]]], added: Sequence[tuple[str, Sequence[str]]], threshold: float = 0.35) -> list[tuple[str | None, str | None]]:
    """As `list_changes`, for (text, tokens) lists."""
    olds, left, partner = [frozenset(t) for _, t in removed], dict.fromkeys(range(len(removed))), {}
    for j, (_, tokens) in enumerate(added):
        new = frozenset(tokens)
        alike = [(-len(new & olds[i]) / len(new | olds[i]), i) for i in left if new and olds[i]]
        score, i = min(alike, default=(0.0, -1))
        if -score >= threshold:
            partner[j] = i
            del left[i]
    out = [region_of(removed[partner[j]][0], text) if j in partner else (None, text) for j, (text, _) in enumerate(added)]
    return [c for c in out if c[0] != c[1]] + [(text, None) for i, (text, _) in enumerate(removed) if i in left]
