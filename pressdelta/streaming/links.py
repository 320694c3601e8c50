"""Link observations: sighting counts, references, link state - the same functions for tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pressdelta import constants as K
from pressdelta.functions.timeutil import seconds_between


def ref_priority(kind: Column) -> Column:
    out = None
    for name, p in K.REF_PRIORITY.items():
        out = F.when(kind == name, p) if out is None else out.when(kind == name, p)
    return out.otherwise(len(K.REF_PRIORITY))


def sighting_counts(links: DataFrame) -> DataFrame:
    """Sightings per source and minute; a URL counts once per run, at the minute it was first seen."""
    first = links.groupBy("run_id", "source_id", "article_url").agg(F.min("seen_at").alias("t"))
    return first.groupBy("source_id", F.date_trunc("minute", "t").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))


def link_refs(links: DataFrame, keep: int | None = K.MAX_REFS) -> DataFrame:
    """Where each article is linked, per run: (run_id, url, refs[u, k, t]).  The first sight of a reference counts;
    home pages come before sections, feeds and sitemaps.  The list is a short one by definition, its first `keep`; None gives all."""
    first = links.groupBy("run_id", "article_url", "ref_url").agg(F.min(F.struct("seen_at", "ref_kind")).alias("x"))
    rows = first.select("run_id", "article_url", F.col("ref_url").alias("u"), F.col("x.ref_kind").alias("k"), F.col("x.seen_at").alias("t"))
    order = W.partitionBy("run_id", "article_url").orderBy(ref_priority(F.col("k")), "t", "u")
    ranked = rows.withColumn("rn", F.row_number().over(order))
    best = ranked if keep is None else ranked.filter(F.col("rn") <= keep)
    lists = best.groupBy("run_id", "article_url").agg(F.array_sort(F.collect_list(F.struct("rn", "u", "k", "t"))).alias("refs"))
    return lists.select("run_id", F.col("article_url").alias("url"), F.transform("refs", lambda x: F.struct(x["u"].alias("u"), x["k"].alias("k"), x["t"].alias("t"))).alias("refs"))


def latest_refs(refs: DataFrame) -> DataFrame:
    """The list of the newest run replaces older ones."""
    return refs.groupBy("url").agg(F.max_by("refs", "run_id").alias("refs"))


def cap_refs(refs: Column, keep: int = K.MAX_REFS) -> Column:
    """Priority order and cut of a list of references."""
    rank = lambda x: F.struct(ref_priority(x["k"]).alias("p"), x["t"].alias("t"), x["u"].alias("u"), x["k"].alias("k"))
    return F.transform(F.slice(F.array_sort(F.transform(refs, rank)), 1, keep), lambda x: F.struct(x["u"].alias("u"), x["k"].alias("k"), x["t"].alias("t")))


def link_state(links: DataFrame) -> DataFrame:
    """Per URL: first and last sighting, runs, and whether it was seen again more than two hours later."""
    s = links.groupBy("article_url").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("sightings"))
    return s.withColumn("link_resighted", seconds_between(F.col("first_seen"), F.col("last_seen")) > K.RESIGHT_HOURS * 3600)


# --- streams -------------------------------------------------------------------------------------------------------------------
WATERMARK = "2 hours"


def sightings_stream(links: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Stream of sighting counts: (run_id, source_id, minute, n), appended when a run is complete; added up over runs they are
    `sighting_counts`, for any order of arrival within a run.

    Two aggregations under one watermark, on the start of the runs: the earliest sighting of a URL in a run, then counts per minute.  The first is
    keyed by run and URL, so no source is a hot key; counts combine before they are shuffled.  Rows of runs older than the watermark drop."""
    # event time has to be of type TIMESTAMP
    d = links.select(F.col("run_id").cast("timestamp").alias("run_id"), "source_id", "article_url", "seen_at").withWatermark("run_id", watermark)
    first = d.groupBy("run_id", "source_id", "article_url").agg(F.min("seen_at").alias("t"))
    per = first.groupBy("run_id", "source_id", F.date_trunc("minute", "t").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("n"))
    return per.select(F.col("run_id").cast("timestamp_ntz").alias("run_id"), "source_id", "minute", "n")


REFS_OUT = "run_id timestamp, url string, refs array<struct<u:string,k:string,t:timestamp>>"


class RefKeeper(StatefulProcessor):
    """The references of a URL in its newest run, one map entry each; a newer run starts anew, rows of older ones change nothing."""

    def __init__(self, keep: int | None) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "run bigint")
        self.refs = handle.getMapState("refs", "u string", "t bigint, k string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.run.get()[0] if self.run.exists() else None
        pdf = pd.concat(list(rows))
        newest = int(pdf.run_us.max())
        if known is not None and newest < known:
            return
        if known is None or newest > known:
            self.refs.clear()
            self.run.update((newest,))
        moved = newest != known
        for u, t, k in pdf.loc[pdf.run_us == newest, ["ref_url", "seen_us", "ref_kind"]].sort_values(["seen_us", "ref_kind"]).itertuples(index=False):
            before = self.refs.getValue((u,)) if self.refs.containsKey((u,)) else None
            if before is None or (int(t), k) < tuple(before):
                self.refs.updateValue((u,), (int(t), k))
                moved = True
        if moved:
            order = sorted((K.REF_PRIORITY.get(k, len(K.REF_PRIORITY)), t, u[0], k) for u, (t, k) in self.refs.iterator())
            told = [{"u": u, "k": k, "t": pd.Timestamp(t, unit="us")} for _, t, u, k in order[: self.keep]]
            yield pd.DataFrame({"run_id": [pd.Timestamp(newest, unit="us")], "url": [key[0]], "refs": [told]})

    def close(self) -> None:
        pass


def link_refs_stream(links: DataFrame, keep: int | None = K.MAX_REFS) -> DataFrame:
    """Stream of reference lists (run_id, url, refs), one whenever the list of a URL changes; the last one of a URL is `latest_refs` of
    `link_refs`, for any order of arrival.  Needs the RocksDB state store."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    d = links.select("article_url", "ref_url", F.coalesce("ref_kind", F.lit("")).alias("ref_kind"), micros("run_id").alias("run_us"), micros("seen_at").alias("seen_us"))
    return d.groupBy("article_url").transformWithStateInPandas(RefKeeper(keep), outputStructType=REFS_OUT, outputMode="Update", timeMode="None")


def merge_refs(stored: DataFrame, links: DataFrame, keep: int = K.MAX_REFS) -> DataFrame:
    """Reference lists (run_id, url, refs) after one more batch of observations of the same or later runs."""
    old = stored.select("run_id", F.col("url").alias("article_url"), F.explode("refs").alias("r")).select(
        "run_id", "article_url", F.col("r.u").alias("ref_url"), F.col("r.k").alias("ref_kind"), F.col("r.t").alias("seen_at"))
    return link_refs(old.unionByName(links.select("run_id", "article_url", "ref_url", "ref_kind", "seen_at")), keep)


def link_state_stream(links: DataFrame) -> DataFrame:
    """Stream of link states in update mode: the same aggregation, kept as state per URL."""
    return link_state(links)


def merge_link_state(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored link states and those of one more batch."""
    both = stored.select("article_url", "first_seen", "last_seen", "sightings").unionByName(batch.select("article_url", "first_seen", "last_seen", "sightings"))
    s = both.groupBy("article_url").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("sightings").alias("sightings"))
    return s.withColumn("link_resighted", seconds_between(F.col("first_seen"), F.col("last_seen")) > K.RESIGHT_HOURS * 3600)
