"""Which pages to capture next: selections over pages and articles, no scheduler.

All of them cut to a budget early (top-k with partial cuts), so that the later steps work on a few thousand rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from pressdelta.functions.numbers import half_up
from pressdelta.functions.timeutil import as_ts, seconds_between
from pressdelta.operators.filters import tolerance_hours
from pressdelta.plans.patterns import global_rank, small, top_per_group, written
from pressdelta.sources.tables import Tables, resighted

# (younger than h, older than h, due after h, share of the budget)
TIERS = ((24, 0, 1, 0.55), (48, 24, 6, 0.30), (72, 48, 24, 0.20))
LINKED_SEEN_H, LINKED_DUE_H, HORIZON_DAYS = 26, 24, 3


def active_ids(t: Tables) -> DataFrame:
    return t.sources.filter("active").select(F.col("id").alias("source_id"))


def open_article_pages(t: Tables, sources: DataFrame | None = None) -> DataFrame:
    """Article pages without a titled article: not captured yet."""
    p = t.pages.filter(F.col("kind") == "article").select("id", "url", "source_id")
    p = p if sources is None else p.join(small(sources), "source_id", "left_semi")
    return p.join(t.articles.filter(F.col("title").isNotNull()).select("url"), "url", "left_anti").select("id", "url", "source_id")


def source_quota(open_pages: DataFrame, sources: DataFrame, budget: int) -> DataFrame:
    """Budget per source: a floor for everybody, the rest in proportion to the backlog: (source_id, backlog, quota)."""
    n = sources.agg(F.count("*").alias("k"))
    back = sources.join(open_pages.groupBy("source_id").agg(F.count("*").alias("backlog")), "source_id", "left").withColumn("backlog", F.coalesce("backlog", F.lit(0)))
    floor = F.greatest(F.lit(20), F.floor(F.lit(budget) / (n.select("k").scalar() * 3)))
    d = back.withColumn("base", F.least("backlog", floor)).withColumn("more", F.col("backlog") - F.col("base"))
    tot = d.agg(F.sum("base").alias("assigned"), F.greatest(F.sum("more"), F.lit(1)).alias("more"))
    rest = F.greatest(F.lit(0), F.lit(budget) - tot.select("assigned").scalar())
    extra = F.floor(rest * F.col("more") / tot.select("more").scalar())
    return d.select("source_id", "backlog", (F.col("base") + F.least("more", extra)).cast("bigint").alias("quota"))


def select_new(open_pages: DataFrame, quota: DataFrame, budget: int) -> DataFrame:
    """Newest open pages within the quota of their source.  No quota exceeds the budget, which cuts the sort early."""
    ranked = top_per_group(open_pages, ["source_id"], [F.desc("id")], budget, spread=["id"])
    return ranked.join(small(quota.select("source_id", "quota")), "source_id").filter(F.col("rn") <= F.col("quota")).select("id", "url", "source_id")


def _overdue_first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows by last scan, or all of them."""
    return rows if limit is None else rows.orderBy("last_seen", "id").limit(limit)


def rescan_tier(t: Tables, now, low_h: int, high_h: int, due_h: int, sources: DataFrame, cap: int | None = None) -> DataFrame:
    """Titled articles of an age range whose last scan is long enough ago, most overdue first."""
    now = as_ts(now)
    ago = lambda h: now - F.expr(f"INTERVAL {h} HOURS")
    eff = F.coalesce("published_at", "first_seen")
    a = t.articles.filter(F.col("title").isNotNull() & (F.col("last_seen") <= ago(due_h)) & (eff >= ago(high_h)) & (eff <= ago(low_h)))
    return a.join(small(sources), "source_id", "left_semi").select("url", "source_id", "last_seen", "id").transform(_overdue_first, cap)


def linked_stale(t: Tables, sources: DataFrame, seen_since, due_before, limit: int | None = None) -> DataFrame:
    """Articles that are still linked but were not scanned lately, longest ago first."""
    p = t.pages.filter((F.col("kind") == "article") & (F.col("last_seen") >= as_ts(seen_since))).select("url")
    a = t.articles.filter(F.col("title").isNotNull() & (F.col("last_seen") <= as_ts(due_before))).select("id", "url", "source_id", "last_seen")
    return a.join(small(sources), "source_id", "left_semi").join(p, "url").select("url", "source_id", "last_seen", "id").transform(_overdue_first, limit)


def overdue(t: Tables, sources: DataFrame, since, limit: int | None = None) -> DataFrame:
    """Safety net: the most overdue articles of the horizon."""
    a = t.articles.filter(F.col("title").isNotNull() & ((F.col("published_at") >= as_ts(since)) | (F.col("first_seen") >= as_ts(since))))
    return a.join(small(sources), "source_id", "left_semi").select("url", "source_id", "last_seen", "id").transform(_overdue_first, limit)


def select_rescans(t: Tables, now, budget: int, sources: DataFrame | None = None, tiers=TIERS, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Articles to scan again: (url, source_id, stage, rn).

    Three age tiers with their share of the budget, then articles that are still linked, then the most overdue ones;
    what a stage does not use is left to the next, and only a URL that was really taken is closed to later stages.  Stage by stage:
    what it offers without what was taken, ranked along the order, up to its share and what is left.  Any budget; nothing is gathered.
    """
    sources = active_ids(t) if sources is None else sources
    ago = lambda h: as_ts(now) - F.expr(f"INTERVAL {h} HOURS")
    tiers = [*tiers[:-1], (horizon_days * 24, *tiers[-1][1:])]
    stages = [(f"tier{k + 1}", rescan_tier(t, now, low, high, due, sources), math.ceil(budget * w)) for k, (high, low, due, w) in enumerate(tiers) if high > low]
    stages.append(("linked", linked_stale(t, sources, ago(LINKED_SEEN_H), ago(LINKED_DUE_H)), budget))
    stages.append(("overdue", overdue(t, sources, as_ts(now) - F.expr(f"INTERVAL {horizon_days} DAYS")), budget))
    taken, left = None, budget
    for name, offers, share in stages:
        if taken is not None:
            offers = offers.join(taken.select("url"), "url", "left_anti")
        # a URL is offered by its most overdue row
        once = offers.groupBy("url").agg(F.min(F.struct("last_seen", "id", "source_id")).alias("x")).select("url", "x.*")
        got = global_rank(once, [F.asc("last_seen"), F.asc("id")]).filter(F.col("rn") <= min(share, left))
        got = written(got.select("url", "source_id", F.lit(name).alias("stage"), F.col("rn").cast("bigint").alias("rn")), "rescans")
        taken = got if taken is None else taken.unionByName(got)
        left = budget - taken.count()
        if left <= 0:
            break
    return taken


def drop_gone(queue: DataFrame, pages: DataFrame, now) -> DataFrame:
    """Queue without articles whose link is gone: seen again after discovery once, and silent beyond the tolerance of
    their source.  URLs without a page stay."""
    p = pages.select("url", F.col("last_seen").alias("__last"), resighted(F.col("first_seen"), F.col("last_seen")).alias("__again"))
    gone = F.col("__again") & (seconds_between(F.col("__last"), as_ts(now)) > tolerance_hours(F.col("source_id")) * 3600)
    return queue.join(p, "url", "left").filter(~F.coalesce(gone, F.lit(False))).drop("__last", "__again")


def fill_queue(queue: DataFrame, open_pages: DataFrame, budget: int) -> DataFrame:
    """Queue filled up to the budget with the newest open pages that are not in it."""
    room = F.greatest(F.lit(0), F.lit(budget) - queue.agg(F.count("*").alias("k")).select("k").scalar())
    free = open_pages.join(queue.select("url"), "url", "left_anti").orderBy(F.desc("id")).limit(budget)
    top = free.withColumn("__rn", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("id")))).filter(F.col("__rn") <= room)
    return queue.select("url", "source_id", F.lit("queued").alias("origin")).unionByName(top.select("url", "source_id", F.lit("backlog").alias("origin")))


def select_enrich(t: Tables, budget: int, least: int = 10) -> DataFrame:
    """Articles without title, then without date, newest first; each source gets its share of the budget by backlog."""
    gaps = t.articles.filter(F.col("title").isNull() | F.col("published_at").isNull()).select("id", "url", "source_id", "title", "first_seen")
    per = gaps.groupBy("source_id").agg(F.count("*").alias("backlog"))
    tot = F.greatest(F.lit(1), per.agg(F.sum("backlog").alias("t")).select("t").scalar())
    quota = per.withColumn("quota", F.greatest(F.lit(least), half_up(F.col("backlog") / tot * budget)))
    d = gaps.withColumn("dated", F.col("title").isNotNull())
    ranked = top_per_group(d, ["source_id"], [F.asc("dated"), F.desc("first_seen"), F.asc("id")], max(least, budget), spread=["id"])
    return ranked.join(small(quota), "source_id").filter(F.col("rn") <= F.col("quota")).select("id", "url", "source_id")
