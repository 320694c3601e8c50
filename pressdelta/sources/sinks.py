"""Writing back: upserts, updates, cascades, CSV."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressdelta.plans.patterns import global_rank, scratch_path, written
from pressdelta.sources.tables import Tables


def latest(updates: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the newest by `order`, else any."""
    if order is None:
        return updates.dropDuplicates([key])
    row = F.struct(*[F.col(c) for c in updates.columns])
    return updates.groupBy(key).agg(F.max_by(row, order).alias("__r")).select("__r.*")


def upsert(target: DataFrame, updates: DataFrame, key: str, mode: str = "update", order: str | None = None) -> DataFrame:
    """Rows of `updates` replace rows of the same key ('update') or are added only for new keys ('ignore')."""
    new = latest(updates, key, order).select(*target.columns)
    if mode == "ignore":
        return target.unionByName(new.join(target.select(key), key, "left_anti").select(*target.columns))
    if mode != "update":
        raise ValueError(f"unknown mode {mode!r}")
    return target.join(new.select(key), key, "left_anti").select(*target.columns).unionByName(new)


def update_existing(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """New values for known keys; keys that the target does not have are ignored."""
    cols = [c for c in updates.columns if c != key]
    u = updates.dropDuplicates([key]).select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in cols])
    j = target.join(u, key, "left")
    return j.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in cols}).select(*target.columns)


# --- tables that are merged bucket by bucket ----------------------------------------------------------------------------------
class BucketedTable:
    """A stored table, cut into parts by its key and in each part into buckets sorted by it.

    A merge reads only the parts the updates touch and meets the target as it lies, without a shuffle of it, and rewrites only those parts
    (dynamic partition overwrite): files of other parts stay as they are.  Parts are folders; buckets join storage-side.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, path: str, parts: int = 16, buckets: int = 8) -> None:
        self.spark, self.name, self.key, self.path, self.parts, self.buckets = spark, name, key, path, parts, buckets

    @classmethod
    def create(cls, df: DataFrame, name: str, key: str, path: str | None = None, parts: int = 16, buckets: int = 8) -> BucketedTable:
        """Store `df` as a new table; keys are unique in it."""
        t = cls(df.sparkSession, name, key, path or scratch_path(df.sparkSession, name), parts, buckets)
        rows = t._dealt(df)
        rows.repartition(buckets, F.col(key)).write.partitionBy("__part").bucketBy(buckets, key).sortBy(key).option("path", t.path).saveAsTable(name)
        t.columns = df.columns
        return t

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__part", F.pmod(F.xxhash64(self.key, F.lit(41)), F.lit(self.parts)).cast("int"))

    def read(self, parts: Sequence[int] | None = None) -> DataFrame:
        d = self.spark.table(self.name)
        return d if parts is None else d.filter(F.col("__part").isin(*parts))

    def rows(self) -> DataFrame:
        return self.read().select(*self.columns)

    def merged(self, updates: DataFrame, mode: str = "update", order: str | None = None) -> tuple[DataFrame, list[int]]:
        """The rows of the touched parts after the merge, and those parts.  Modes: 'update' replaces rows of the same key and adds new ones, 'ignore' only adds,
        'existing' sets the given columns of known keys, 'delete' removes keys."""
        if mode not in ("update", "ignore", "existing", "delete"):
            raise ValueError(f"unknown mode {mode!r}")
        given = [c for c in updates.columns if c != self.key]
        news = latest(updates, self.key, order)
        u = self._dealt(news).select(self.key, "__part", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in given])
        # at most `parts` numbers
        touched = sorted(r[0] for r in u.select("__part").distinct().collect())
        target = self.read(touched)
        j = target.join(u.withColumnRenamed("__part", "__upart"), self.key, "full" if mode in ("update", "ignore") else "left")
        there, hit = F.col("__part").isNotNull(), F.coalesce(F.col("__hit"), F.lit(False))
        if mode == "delete":
            j = j.filter(~hit)
        take = {"update": hit, "existing": hit, "ignore": hit & ~there, "delete": F.lit(False)}[mode]
        cols = [F.when(take, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in given and mode != "delete" else F.col(c) for c in self.columns]
        return j.select(*cols, F.coalesce("__part", "__upart").alias("__part")), touched

    def merge(self, updates: DataFrame, mode: str = "update", order: str | None = None) -> list[int]:
        """Merge and rewrite the touched parts; returns them."""
        rows, touched = self.merged(updates, mode, order)
        if not touched:
            return touched
        if mode == "delete":
            # a part that loses its last row is not rewritten by anything: it is dropped
            rows = written(rows, "merged-parts")
            left = {r[0] for r in rows.select("__part").distinct().collect()}
            for part in sorted(set(touched) - left):
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (`__part` = {part})")
                self._remove(part)
        stored = self.spark.table(self.name).columns
        # buckets lie as they are, so nothing is moved ahead of the write
        conf, name = self.spark.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(name)
        conf.set(name, "dynamic")
        try:
            rows.select(*stored).write.mode("overwrite").insertInto(self.name)
        finally:
            conf.set(name, before)
        return touched

    def _remove(self, part: int) -> None:
        store, inner = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        folder = f"{inner}/__part={part}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


CHILDREN = ("snapshots", "article_paras", "article_keywords", "article_categories", "article_authors")


def delete_articles(t: Tables, ids: DataFrame) -> Tables:
    """Remove articles (article_id) and everything that belongs to them."""
    gone = ids.select("article_id").distinct()
    a = t.articles.join(gone, t.articles["id"] == gone["article_id"], "left_anti")
    kids = {n: getattr(t, n).join(gone, "article_id", "left_anti").select(*getattr(t, n).columns) for n in CHILDREN if getattr(t, n) is not None}
    return t.with_(articles=a, **kids)


def upsert_writer(read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], key: str, mode: str = "update", order: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function for an upsert: `read` gives the stored table, `write` stores a new version of it under the
    batch number.  Writing the same batch again gives the same version, so a retried batch does no harm."""
    def run(batch: DataFrame, number: int) -> None:
        write(upsert(read(), batch, key, mode, order), number)
    return run


def export_csv(df: DataFrame, path: str, header: dict[str, str] | None = None) -> None:
    """CSV of a view in its order: semicolons, quoted where needed with doubled quotes, byte order mark in front."""
    out = df.select(*[F.col(c).cast("string").alias((header or {}).get(c, c)) for c in df.columns])
    first = out.columns[0]
    # the mark belongs to the first header cell of each file
    out.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("sep", ";").option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", False).option("nullValue", "").option("emptyValue", "").csv(path)


def numbered(df: DataFrame, order: list) -> DataFrame:
    """Row number of the exported view as first column '#'."""
    return global_rank(df, order, "#").select("#", *df.columns).orderBy("#")
