"""Time series: rates per bucket, days, cumulative days, link sightings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressdelta.functions.timeutil import as_ts, axis_time, berlin_day, bucket, bucket_spine, to_utc, berlin_local
from pressdelta.operators.dashboards import topic_or_rest
from pressdelta.operators.filters import FilterParams, filter_corpus
from pressdelta.plans.patterns import first_rows


def _key(by: str) -> Column:
    """Series key as text: source id, topic, or one series for all."""
    return {"source": F.col("source_id").cast("string"), "topic": topic_or_rest(), "total": F.lit("total")}[by]


def _fill(counts: DataFrame, keys: DataFrame, start, end, unit: str) -> DataFrame:
    spine = keys.withColumn("bucket", F.explode(bucket_spine(as_ts(start), as_ts(end), unit)))
    return spine.join(counts, ["series", "bucket"], "left").select("series", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def _source_keys(sources: DataFrame, p: FilterParams) -> DataFrame:
    rows = sources.filter(F.col("id").isin(*p.sources)) if p.sources else sources.filter(F.col("active"))
    return rows.select(F.col("id").cast("string").alias("series"))


def rate_series(corpus: DataFrame, p: FilterParams, start, end, unit: str, by: str = "source", sources: DataFrame | None = None, top: int | None = None,
                ids: DataFrame | None = None) -> DataFrame:
    """Articles per bucket, zero-filled: (series, bucket, n).

    By source every active source has a series, by topic every topic, or the `top` largest.  Rows are counted per bucket
    with map-side combining first; only the counts are joined to the bucket spine.
    """
    rows = filter_corpus(corpus, p.with_(range_from=start, range_to=end), ids)
    counts = rows.groupBy(_key(by).alias("series"), bucket(axis_time(p.axis), unit).alias("bucket")).agg(F.count("*").alias("n"))
    if by == "topic":
        keys = first_rows(counts.groupBy("series").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "series"), top).select("series")
    elif by == "source" and sources is not None:
        keys = _source_keys(sources, p)
    elif by == "total":
        keys = counts.sparkSession.range(1).select(F.lit("total").alias("series"))
    else:
        keys = counts.select("series").distinct()
    return _fill(counts, keys, start, end, unit)


def day_series(corpus: DataFrame, p: FilterParams, first_day, last_day, by: str = "source", sources: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """Articles per Berlin day between two days, all filters but time: (series, day, n)."""
    rows = filter_corpus(corpus, p, skip_time=True).select(_key(by).alias("series"), berlin_day(axis_time(p.axis)).alias("day"))
    rows = rows.filter(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    counts = rows.groupBy("series", "day").agg(F.count("*").alias("n"))
    if by == "topic":
        keys = first_rows(counts.groupBy("series").agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "series"), top).select("series")
    else:
        keys = _source_keys(sources, p) if sources is not None else counts.select("series").distinct()
    spine = keys.withColumn("day", F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))))
    return spine.join(counts, ["series", "day"], "left").select("series", "day", F.coalesce("n", F.lit(0)).alias("n"))


def stacked_totals(series: DataFrame, step: str = "day") -> DataFrame:
    return series.groupBy(step).agg(F.sum("n").alias("n"))


def cumulative_by_day(series: DataFrame) -> DataFrame:
    """Running total that starts again at each Berlin midnight.  A window holds the buckets of one series and day."""
    day = berlin_day(F.col("bucket"))
    w = W.partitionBy("series", "day").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    return series.withColumn("day", day).withColumn("running", F.sum("n").over(w))


def until_now(series: DataFrame, now) -> DataFrame:
    """Buckets that have begun."""
    return series.filter(F.col("bucket") <= as_ts(now))


def bucket_window(series_bucket, unit: str, cumulative: bool = False) -> tuple[Column, Column]:
    """Window of one chart point: its bucket, or from the start of its day when the chart is cumulative."""
    start = as_ts(series_bucket)
    end = start + F.expr({"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY"}[unit]) - F.expr("INTERVAL 1 SECOND")
    return (to_utc(F.date_trunc("day", berlin_local(start)).cast("timestamp_ntz")) if cumulative else start), end


def sighting_buckets(sightings: DataFrame, start=None, end=None, grain: str = "hour") -> DataFrame:
    """Link sightings per source and minute, hour or Berlin day."""
    rows = sightings
    if start is not None:
        rows = rows.filter(F.col("minute") >= as_ts(start))
    if end is not None:
        rows = rows.filter(F.col("minute") <= as_ts(end))
    return rows.groupBy("source_id", bucket(F.col("minute"), grain if grain in ("minute", "day") else "hour").alias("bucket")).agg(F.sum("n").alias("n"))


def sighting_series(sightings: DataFrame, corpus: DataFrame, sources: DataFrame, p: FilterParams, start, end, unit: str, by: str = "source") -> DataFrame:
    """Series of the 'seen' axis per source: link sightings when there are any, else the articles' last scans.
    Topic charts and the state 'gone' always show the articles."""
    articles = rate_series(corpus, p.with_(axis="seen"), start, end, unit, by, sources)
    if by != "source" or p.link_state == "gone":
        return articles
    grain = "minute" if unit == "minute" else "hour"
    rows = sighting_buckets(sightings, start, end, grain).select(F.col("source_id").cast("string").alias("series"), bucket(F.col("bucket"), unit).alias("bucket"), "n")
    counts = rows.groupBy("series", "bucket").agg(F.sum("n").alias("n"))
    seen = _fill(counts, _source_keys(sources, p), start, end, unit)
    some = counts.agg(F.count("*").alias("k")).select("k").scalar()
    return seen.filter(some > 0).unionByName(articles.filter(some == 0))
