"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without white space at both ends, A-Z in lower case; keys of fewer than `least` code points never
count.  Runs are tables of (128-bit key hash, owner), the document that keeps the line, dealt by key into as many buckets as a shuffle has partitions, each
one sorted file: a batch meets them by merge joins that neither move nor sort a run, and two runs are merged the same way.  Each batch of documents is joined
once with each run: keys the runs hold belong to their owner, the others (the anti-join) belong to the smallest id in the batch and form a new
run, written by that join where they lie.  When a level has `fanout` runs they are merged into one run of the next level before the next batch comes, so a batch meets few runs, and no
run is merged that no batch will meet.  Batches come in ascending id order, so the owner is the smallest document id of all.  Each batch reads all runs, so the
number of batches grows with the logarithm of the rows: two up to 3 x BATCH_ROWS, then one more for about each fourfold.

Only hashes are shuffled until the last step, in which the places to drop meet the texts.  A line found more often than in one of HOT rows of a batch (so fewer than HOT
lines) is looked up by broadcast; no other key is a larger share of a join.

Defined cases: a null or empty text is one empty line; a line that repeats inside its owner stays; rows with the same id are one
document; rows without an id are one document that comes last; an empty table gives an empty result; extra columns pass through, whatever their names (those of
the result that clash are replaced).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pressdelta.llm.common import LAST_ID, SPACE, pieces, remove, scratch, store, text_of

LEAST = 10
BATCH_ROWS = 8192
FANOUT = 2
HOT = 1024
KEYS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("own", T.LongType())])
KEPT = T.StructType([T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def _long_enough(key: bytes, least: int) -> bool:
    """At least `least` code points; a code point has one to four bytes."""
    return len(key) >= 4 * least or len(key) >= least and sum(b & 0xC0 != 0x80 for b in key) >= least


def line_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST) -> DataFrame:
    """(doc, h1, h2, line, own): one row per line whose key is long enough; `own` tells apart the texts of rows with the same id."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            docs_, owns, lines, found = [], [], [], []
            for doc, own, raw in zip(batch.column("doc").to_pylist(), batch.column("own").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                for i, line in enumerate((raw or b"").lower().split(b"\n")):
                    key = line.strip(SPACE)
                    if _long_enough(key, least):
                        docs_.append(doc)
                        owns.append(own)
                        lines.append(i)
                        found.append(xxhash.xxh3_128_digest(key))
            both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(lines, pa.int32()), pa.array(owns, pa.int64())], names=KEYS.names)
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("own"), F.col(text).alias("text")).mapInArrow(keys, KEYS)


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Plans made inside trust the order of buckets that are one sorted file each."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class LineRuns:
    """The runs of all lines seen so far: bucketed tables, each a folder of the shared checkpoint folder.

    `levels` names the runs of each level.  All have the same number of buckets, that of the session's shuffles when the first is written.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels, self.paths = spark, fanout, [], {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def known(self) -> DataFrame:
        """(h1, h2, owner) of every line seen."""
        runs = [self._run(name) for level in self.levels for name in level]
        return reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], "h1 long, h2 long, owner long")

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("fresh").select("h1", "h2", "owner")

    def _table(self, rows: DataFrame, name: str) -> str:
        """Write (h1, h2, owner, last, fresh), dealt by (h1, h2) already, as buckets of one sorted file each."""
        path = scratch(self.spark, name)
        table = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
        rows.write.partitionBy("fresh").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(table)
        self.paths[table] = path
        return table

    def _write(self, table: str, level: int) -> None:
        """A table's fresh rows are a run of this level."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def _remove(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.paths.pop(table))

    def _merged(self, tables: list[str]) -> DataFrame:
        """Runs hold different keys: a full join of sorted buckets is their merge."""
        out = self._run(tables[0])
        for table in tables[1:]:
            other = self._run(table).withColumnRenamed("owner", "__owner")
            out = out.join(other.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce("owner", "__owner").alias("owner"))
        return out.select("*", F.lit(None).cast("long").alias("last"), F.lit(True).alias("fresh"))

    def _compact(self) -> None:
        """Merge the runs of full levels; a level that fills up by it comes next."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged, self.levels[level] = self.levels[level], []
                # two by two: a full join is not dealt by key any more
                while len(merged) > 1:
                    two, merged = merged[:2], merged[2:]
                    with sorted_buckets(self.spark):
                        merged.append(self._table(self._merged(two), f"line-run-{level + 1}"))
                    for table in two:
                        self._remove(table)
                self._write(merged[0], level + 1)
            level += 1

    def meet(self, keys: DataFrame) -> DataFrame:
        """(h1, h2, owner, last, n, fresh) of every key of a batch: the plan moves the batch once, and no run."""
        met = keys.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).withColumn("owner", F.lit(None).cast("long"))
        for name in (name for level in self.levels for name in level):
            run = self._run(name).withColumnRenamed("owner", "__owner")
            met = met.join(run.hint("merge"), ["h1", "h2"], "left").withColumn("owner", F.coalesce("owner", "__owner")).drop("__owner")
        return met.select("h1", "h2", F.coalesce("owner", "first").alias("owner"), "last", "n", F.col("owner").isNull().alias("fresh"))

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in a batch (doc, h1, h2, line, own) whose documents come after all before.  Returns (doc, own, line) of what to drop from it."""
        self._compact()
        with sorted_buckets(self.spark):
            table = self._table(self.meet(keys), "line-batch")
        self._write(table, 0)
        # written again, for a run may be merged and removed before the result is read
        shared = store(self.spark.table(table).filter(F.col("last") != F.col("owner")).select("h1", "h2", "owner", "n"), "line-shared")
        rows = self.spark.table(table).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        often = F.col("n") * HOT > rows
        hot, rest = (shared.filter(c).select("h1", "h2", "owner") for c in (often, ~often))
        # fewer than HOT rows
        looked = keys.join(F.broadcast(hot.withColumnRenamed("owner", "__owner")), ["h1", "h2"], "left")
        cold = looked.filter(F.col("__owner").isNull()).drop("__owner").join(rest, ["h1", "h2"])
        found = looked.filter(F.col("__owner").isNotNull()).withColumnRenamed("__owner", "owner").select(*cold.columns).unionByName(cold)
        return found.filter(F.col("doc") != F.col("owner")).select("doc", "own", "line")

    def drop(self) -> None:
        for table in list(self.paths):
            self._remove(table)
        self.levels = []


def without(text: Column, places: Column) -> Column:
    """struct<kept, n_lines, n_dropped>: the text without the lines at the given places."""
    @F.pandas_udf(KEPT)
    def cut(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        kept, lines, dropped = [], [], []
        for t, d in zip(texts, drops):
            own = (t or "").split("\n")
            lines.append(len(own))
            gone = set(d) if d is not None else ()
            dropped.append(len(gone))
            kept.append("\n".join(x for i, x in enumerate(own) if i not in gone) if gone else t or "")
        return pd.DataFrame({"kept": kept, "n_lines": lines, "n_dropped": dropped})
    return cut(text, places)


def batches_for(rows: int, batch_rows: int = BATCH_ROWS) -> int:
    """Batches for so many documents: 1 + log4(1 + rows / batch_rows), rounded up."""
    return 1 + math.ceil(math.log(1 + rows / batch_rows, 4))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, batches: int | None = None) -> DataFrame:
    """The documents with kept, n_lines and n_dropped.  `batches` follows the number of documents unless given."""
    spark = docs.sparkSession
    batches = batches or batches_for(docs.count())
    cuts = sorted(set(docs.approxQuantile(doc_id, [i / batches for i in range(1, batches)], 0.01)))
    number = sum((F.when(F.col("doc") > F.lit(int(c)), 1).otherwise(0) for c in cuts), F.lit(0))
    staged, places = scratch(spark, "line-keys"), scratch(spark, "line-drops")
    line_keys(docs, text, doc_id, least).withColumn("batch", number).write.partitionBy("batch").parquet(staged)
    keys = spark.read.schema(T.StructType([*KEYS, T.StructField("batch", T.IntegerType())])).parquet(staged)
    runs = LineRuns(spark)
    for b in range(len(cuts) + 1):
        runs.add(keys.filter(F.col("batch") == b).drop("batch")).write.mode("append").parquet(places)
    runs.drop()
    drops = spark.read.schema("doc long, own long, line int").parquet(places)
    # a text's own lines: no longer than the text; equal rows name a line twice
    per_doc = drops.groupBy(F.col("doc").alias("__doc"), F.col("own").alias("__own")).agg(F.collect_set("line").alias("__lines"))
    keyed = docs.withColumns({"__key": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)), "__text": F.xxhash64(text)})
    joined = keyed.join(per_doc, (F.col("__key") == F.col("__doc")) & (F.col("__text") == F.col("__own")), "left")
    cut = joined.withColumn("__cut", without(F.col(text), F.col("__lines")))
    plain = [c for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")]
    return cut.select(*plain, "__cut.kept", "__cut.n_lines", "__cut.n_dropped")
