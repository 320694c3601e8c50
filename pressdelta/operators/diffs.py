"""Readable differences: reconciling change lists, word diffs, cards, repeated live entries."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pressdelta.functions.text import collapse_ws, decode_entities, para_key, trim_ws
from pressdelta.operators.context import real_date_shift
from pressdelta.operators.passages import listed, paired

# --- fixed values: thresholds ---------------------------------------------------------------------------------------------
PAIR_OVERLAP = 0.4        # token Jaccard from which a loose addition and a loose removal are one change
PAIR_PREFIX = 80          # or this many common leading characters

WORD = re.compile(r"\S+\s*")
DIFF_ROWS = "id bigint, item int, hunk int, seq int, op string, text string"


def word_ops(old: str, new: str) -> list[tuple[str, str]]:
    """Word diff of two texts: (eq | del | ins, text) in order; eq and del give the old text back, eq and ins the new one."""
    a, b = WORD.findall(old), WORD.findall(new)
    out = []
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if kind == "equal":
            out.append(("eq", "".join(a[a0:a1])))
        else:
            out += [(op, "".join(part)) for op, part in (("del", a[a0:a1]), ("ins", b[b0:b1])) if part]
    return out


def _diff_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, item, old, new in zip(pdf["id"], pdf["item"], pdf["old"], pdf["new"]):
            hunk, before = 0, "eq"
            for seq, (op, text) in enumerate(word_ops(old, new)):
                # a hunk is a run of changes and the unchanged words before it
                hunk += op == "eq" and before != "eq"
                before = op
                rows.append((key, item, hunk, seq, op, text))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIFF_ROWS.split(", ")])


def diff_ops(pairs: DataFrame) -> DataFrame:
    """Inline word diff of text pairs (id, item, old, new) in long form: (id, item, hunk, seq, op, text).  Pairs are
    spread by their own hash first: the changes of one busy article do not stay in one task."""
    d = pairs.select("id", F.col("item").cast("int").alias("item"), "old", "new").filter(F.col("old").isNotNull() & F.col("new").isNotNull())
    return d.repartition(F.xxhash64("id", "item", "old")).mapInPandas(_diff_batches, DIFF_ROWS)


def reconcile_changes(snapshots: DataFrame, keys: Sequence[str] = ("id",), column: str = "changes") -> DataFrame:
    """The change list of each snapshot, decoded and reconciled, in place.

    Loose additions and removals that are the same passage become one change, by shared words or a long common beginning;
    changes whose sides look the same go.  Whole changes come first, in their order.
    """
    keys = list(keys)
    text = lambda s: F.nullif(decode_entities(F.col(f"x.{s}"), collapse=False), F.lit(""))
    items = snapshots.select(*keys, F.posexplode(column).alias("pos", "x")).select(*keys, "pos", text("old").alias("o"), text("new").alias("n"))
    whole = items.filter("o IS NOT NULL AND n IS NOT NULL").select(*keys, F.struct(F.lit(-1).alias("lone"), "pos").alias("place"), F.col("o").alias("old"), F.col("n").alias("new"))
    loose = items.filter("(o IS NULL) <> (n IS NULL)").select(*keys, F.col("o").isNotNull().alias("old"), "pos", F.coalesce("o", "n").alias("text"))
    both = whole.unionByName(paired(loose, keys, PAIR_OVERLAP, PAIR_PREFIX))
    seen = both.filter(~F.coalesce(collapse_ws(F.col("old")) == collapse_ws(F.col("new")), F.lit(False)))
    rest = [c for c in snapshots.columns if c != column]
    done = snapshots.select(*rest, F.col(column).isNotNull().alias("__had")).join(listed(seen, keys, column), keys, "left")
    empty = F.array().cast("array<struct<old:string,new:string>>")
    return done.withColumn(column, F.when(F.col("__had"), F.coalesce(column, empty))).select(*snapshots.columns)


# --- cards ----------------------------------------------------------------------------------------------------------------
def change_cards(snapshots: DataFrame, key: str = "id", shown: int | None = None) -> DataFrame:
    """Facts of a change card from reconciled changes: (id, shown, more, added_paras, removed_paras, date_changed).
    The largest passages come first; with `shown` so many are given and the rest is counted; paragraph counts come from the reconciled list."""
    ch = F.coalesce("changes", F.array().cast("array<struct<old:string,new:string>>"))
    size = lambda x: F.coalesce(F.length(x["old"]), F.lit(0)) + F.coalesce(F.length(x["new"]), F.lit(0))
    ranked = F.array_sort(F.transform(ch, lambda x, i: F.struct((-size(x)).alias("o"), i.alias("i"), x["old"].alias("old"), x["new"].alias("new"))))
    only = lambda have, lack: F.size(F.filter(ch, lambda x: (F.coalesce(x[have], F.lit("")) != "") & (F.coalesce(x[lack], F.lit("")) == "")))
    return snapshots.select(
        key, F.transform(ranked if shown is None else F.slice(ranked, 1, shown), lambda x: F.struct(x["old"].alias("old"), x["new"].alias("new"))).alias("shown"), F.lit(0).alias("more") if shown is None else F.greatest(F.size(ch) - shown, F.lit(0)).alias("more"),
        only("new", "old").alias("added_paras"), only("old", "new").alias("removed_paras"), real_date_shift(F.col("pubdate_old"), F.col("pubdate_new")).alias("date_changed"))


def shown_paragraphs(snapshots: DataFrame) -> DataFrame:
    """New paragraphs of each snapshot with their key: (id, article_id, captured_at, pos, para, key)."""
    added = F.filter(F.transform(F.filter(F.coalesce("changes", F.array().cast("array<struct<old:string,new:string>>")), lambda x: x["new"].isNotNull() & x["old"].isNull()), lambda x: trim_ws(decode_entities(x["new"], collapse=False))), lambda p: p != "")
    own = F.when(F.size(added) > 0, added).when(F.coalesce("added", F.lit("")) != "", F.array(trim_ws(decode_entities(F.col("added"), collapse=False)))).otherwise(F.array().cast("array<string>"))
    return snapshots.select("id", "article_id", "captured_at", F.posexplode(own).alias("pos", "para")).withColumn("key", para_key(F.col("para")))


def first_shown(paras: DataFrame, order: str = "captured_at") -> DataFrame:
    """Flag `hidden`: the same paragraph of the article was shown at an earlier version.  The earliest version of each
    (article, key) is an aggregate; it is joined back instead of sorting all versions of a live report in one task."""
    first = paras.groupBy("article_id", "key").agg(F.min(order).alias("__first"))
    return paras.join(first, ["article_id", "key"]).withColumn("hidden", F.col(order) > F.col("__first")).drop("__first")


def added_sections(paras: DataFrame, shown: int | None = None, order: str = "captured_at") -> DataFrame:
    """New paragraphs of a snapshot that were not shown before; with `shown` the first so many, and how many more there are."""
    fresh = first_shown(paras, order).filter(~F.col("hidden"))
    lists = fresh.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "para"))).alias("p"))
    return lists.select("id", F.transform(F.col("p") if shown is None else F.slice("p", 1, shown), lambda x: x["para"]).alias("sections"), F.lit(0).alias("more") if shown is None else F.greatest(F.size("p") - shown, F.lit(0)).alias("more"))
