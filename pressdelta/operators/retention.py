"""Retention: what may be dropped, and the tables without it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pressdelta import constants as K
from pressdelta.functions.timeutil import as_ts
from pressdelta.plans.patterns import DEFAULT_SALTS, written
from pressdelta.sources.sinks import delete_articles
from pressdelta.sources.tables import Tables


def stale_articles(t: Tables, now, days: int = K.ARTICLE_MAX_AGE_DAYS) -> DataFrame:
    """Articles that never changed and were not scanned for a while: (article_id)."""
    old = t.articles.filter(F.col("last_seen") < as_ts(now) - F.expr(f"INTERVAL {days} DAYS"))
    return old.join(t.snapshots.select(F.col("article_id").alias("id")), "id", "left_anti").select(F.col("id").alias("article_id"))


def cap_extensions(snapshots: DataFrame, keep: int = K.EXTENSION_KEEP) -> DataFrame:
    """Only the newest extensions of each article stay; edits all stay.  Extensions are ranked in two rounds, so a live
    report with millions of them is not sorted in one task.  Snapshots are read once: edits pass both rounds unranked, spread by their salt."""
    ext, salt = F.coalesce(F.col("change_kind") == "extension", F.lit(False)), F.pmod(F.xxhash64("id"), F.lit(DEFAULT_SALTS))
    d, order = snapshots.withColumns({"__ext": ext, "__salt": salt}), [F.desc("captured_at"), F.desc("id")]
    for last in (False, True):
        part = F.when(F.col("__ext"), F.lit(-1)).otherwise(F.col("__salt")) if last else F.col("__salt")
        rank = F.row_number().over(W.partitionBy("article_id", "__ext", part).orderBy(*order))
        d = d.withColumn("__rn", rank).filter(~F.col("__ext") | (F.col("__rn") <= keep)).drop("__rn")
    return d.select(*snapshots.columns)


def trim_payload(snapshots: DataFrame, now, days: int = K.SNAPSHOT_PAYLOAD_DAYS) -> DataFrame:
    """Texts of old snapshots are dropped, the rows stay."""
    old = F.col("captured_at") < as_ts(now) - F.expr(f"INTERVAL {days} DAYS")
    return snapshots.withColumns({c: F.when(~old, F.col(c)) for c in ("added", "changes") if c in snapshots.columns})


def drop_dormant_paras(t: Tables, now, days: int = K.ARTICLE_MAX_AGE_DAYS) -> DataFrame:
    """Stored paragraphs of articles that are not scanned any more go; a later scan starts from a new baseline."""
    dormant = t.articles.filter(F.col("last_seen") < as_ts(now) - F.expr(f"INTERVAL {days} DAYS")).select(F.col("id").alias("article_id"))
    return t.article_paras.join(dormant, "article_id", "left_anti").select(*t.article_paras.columns)


def drop_old_sightings(sightings: DataFrame, now, days: int = K.SIGHTING_DAYS) -> DataFrame:
    return sightings.filter(F.col("minute") >= as_ts(now) - F.expr(f"INTERVAL {days} DAYS"))


def prune(t: Tables, now, keep: int = K.EXTENSION_KEEP) -> Tables:
    """All retention rules; running it twice changes nothing more."""
    # found once, for all tables that lose them
    t = delete_articles(t, written(stale_articles(t, now).distinct(), "stale-articles"))
    t = t.with_(snapshots=trim_payload(cap_extensions(t.snapshots, keep), now))
    if t.article_paras is not None:
        t = t.with_(article_paras=drop_dormant_paras(t, now))
    if t.sightings is not None:
        t = t.with_(sightings=drop_old_sightings(t.sightings, now))
    return t
