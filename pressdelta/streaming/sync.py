"""Incremental corpus: load what was scanned since the last state, merge, check for drift.

Two forms with the same result: `sync_corpus` over any two tables, and `FileSync` over a source that lies in Parquet files, which opens only the files
that can hold new scans and takes its counts from a small table of figures per file.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressdelta import constants as K
from pressdelta.functions.timeutil import as_ts
from pressdelta.plans.patterns import written
from pressdelta.sources.tables import in_corpus_window

OVERLAP = "INTERVAL 2 MINUTES"


def high_water_mark(cached: DataFrame) -> Column:
    """Scan time from which rows have to be loaded again, as an expression."""
    return cached.agg((F.max("last_seen") - F.expr(OVERLAP)).alias("m")).select("m").scalar()


def delta_rows(overview: DataFrame, cached: DataFrame) -> DataFrame:
    return overview.filter(F.col("last_seen") >= high_water_mark(cached))


def merge_corpus(cached: DataFrame, delta: DataFrame, now, days: int = K.CORPUS_DAYS) -> DataFrame:
    """Loaded rows replace cached ones of the same id; rows that left the window drop."""
    new = delta.select(*cached.columns).dropDuplicates(["id"])
    return cached.join(new.select("id"), "id", "left_anti").select(*cached.columns).unionByName(new).filter(in_corpus_window(now, days))


def needs_reload(merged: DataFrame, full: DataFrame) -> DataFrame:
    """One row: does the merged state differ by more than max(40, 1 %) rows from the source?"""
    n = full.agg(F.count("*").alias("full_n"))
    d = merged.agg(F.count("*").alias("merged_n")).withColumn("full_n", n.select("full_n").scalar())
    return d.withColumn("reload", drifted(F.col("full_n"), F.col("merged_n")))


def drifted(full: Column, merged: Column) -> Column:
    return F.abs(full - merged) > F.greatest(F.lit(40), F.floor(full * 0.01 + F.lit(0.5)))


def sync_corpus(cached: DataFrame, overview: DataFrame, now, days: int = K.CORPUS_DAYS) -> DataFrame:
    """The next corpus state: the merge when it is close to the source, else the source itself."""
    current = overview.filter(in_corpus_window(now, days)).select(*cached.columns)
    merged = merge_corpus(cached, delta_rows(overview, cached), now, days)
    reload = needs_reload(merged, current).select("reload").scalar()
    return merged.filter(~reload).unionByName(current.filter(reload))


def sync_writer(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], now: Callable[[], object]) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that merges a stream of scanned rows into the stored corpus."""
    def run(batch: DataFrame, number: int) -> None:
        write(merge_corpus(read(), batch, now()), number)
    return run


# --- a source in files --------------------------------------------------------------------------------------------------------
def leaves_window() -> Column:
    """The time whose age decides how long a row stays in the corpus window."""
    return F.greatest(F.coalesce("published_at", "discovered_at"), F.col("last_seen"))


FIGURES = "file string, day date, n bigint, oldest timestamp_ntz, newest timestamp_ntz"


def plain_name(file: Column) -> Column:
    """One form for local files, which Spark names with one slash or with three."""
    return F.regexp_replace(file, "^file:/+", "file:/")


class FileSync:
    """Sync against a source of Parquet files, one row per id over all files that are there.

    The manifest holds, per file and day of `leaves_window`, the rows and the first and last scan.  Files never change: an update writes new
    files and removes old ones, so only files the manifest does not know are opened to bring it up to date.  A sync opens files whose last scan is
    not before the high-water mark; the size of the source in the window is a sum over the manifest, for which only files with rows on the
    window's first day are opened.  Rows without any of the three times are never in the window; files without rows are opened once.
    What comes to the driver are names of files: those listed, as in any scan, and those a step opens.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: DataFrame | None = None) -> None:
        self.spark, self.path = spark, path
        self.schema = spark.read.parquet(path).schema
        self.manifest = spark.createDataFrame([], FIGURES) if manifest is None else manifest
        self.opened: list[str] = []

    def _open(self, files: list[str]) -> DataFrame:
        self.opened = files
        # names are told in URL form, paths are opened in plain form
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*map(unquote, files)) if files else self.spark.createDataFrame([], self.schema)

    def _listed(self) -> DataFrame:
        """Files that are there, named as `_metadata.file_path` names them."""
        found = self.spark.read.schema(self.schema).parquet(self.path).inputFiles()
        return self.spark.createDataFrame([(f,) for f in found], "file string").select(plain_name(F.col("file")).alias("file"))

    def refresh(self) -> list[str]:
        """Bring the manifest up to date with the files that are there; returns the files opened for it."""
        listed = self._listed()
        there = self.manifest.join(listed, "file", "left_semi")
        new = [r.file for r in listed.join(self.manifest.select("file").distinct(), "file", "left_anti").collect()]
        rows = self._open(new)
        if new:
            by_day = rows.groupBy(plain_name(F.col("_metadata.file_path")).alias("file"), F.to_date(leaves_window()).alias("day"))
            figures = by_day.agg(F.count("*").alias("n"), F.min("last_seen").alias("oldest"), F.max("last_seen").alias("newest"))
            empty = self.spark.createDataFrame([(f,) for f in new], "file string").join(figures.select("file").distinct(), "file", "left_anti")
            there = there.unionByName(figures).unionByName(empty.select("file", F.lit(None).cast("date").alias("day"), F.lit(0).cast("bigint").alias("n"), *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("oldest", "newest")]))
        self.manifest = written(there, "manifest")
        return new

    def _files(self, wanted: Column) -> list[str]:
        return sorted(r.file for r in self.manifest.filter(wanted).select("file").distinct().collect())

    def newer(self, cached: DataFrame) -> DataFrame:
        """Rows scanned at or after the high-water mark of `cached`; only files that can hold them are opened."""
        mark = cached.agg((F.max("last_seen") - F.expr(OVERLAP)).alias("m")).first()["m"]
        if mark is None:
            return self._open([])
        return self._open(self._files(F.col("newest") >= F.lit(mark))).filter(F.col("last_seen") >= F.lit(mark))

    def size(self, now, days: int = K.CORPUS_DAYS) -> int:
        """Rows of the source inside the window."""
        first = F.to_date(as_ts(now) - F.expr(f"INTERVAL {days} DAYS"))
        whole = self.manifest.filter(F.col("day") > first).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        edge = self._open(self._files(F.col("day") == first))
        return whole + edge.filter((F.to_date(leaves_window()) == first) & in_corpus_window(now, days)).count()

    def sync(self, cached: DataFrame, now, days: int = K.CORPUS_DAYS) -> DataFrame:
        """The next corpus state, as `sync_corpus`.  The merge is written once: its rows are counted where they lie."""
        self.refresh()
        merged = written(merge_corpus(cached, self.newer(cached), now, days), "corpus")
        far = self.spark.range(1).select(drifted(F.lit(self.size(now, days)), F.lit(merged.count())).alias("far")).first()["far"]
        return self.spark.read.schema(self.schema).parquet(self.path).filter(in_corpus_window(now, days)).select(*cached.columns) if far else merged
