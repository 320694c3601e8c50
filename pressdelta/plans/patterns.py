"""Reusable physical patterns: how the operators stay inside memory when one key holds much of the data.

* `top_per_group`    top-k per key in two rounds, so that no task sorts a whole hot key
* `group_quantiles`  exact quantiles per key from value histograms, never from collected values
* `previous_row`     previous row per key by time chunk, so that a hot key is spread over many tasks
* `carry_forward`    latest non-null value per key, in the same way
* `spread_scan`      more tasks for a scan of few splits
* `small`            broadcast hint behind a measured size
* `global_rank`      row numbers along an order, without one task that sees all rows
* `written`          a table written once to the shared folder and read with only the columns a reader needs
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from pressdelta.session import checkpoint_dir

DEFAULT_SALTS = 64
# Largest table that is offered for broadcast, after its size was checked.
BROADCAST_BYTES = 64 * 1024 * 1024


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rn",
                  spread: Sequence[str] | None = None, salts: int = DEFAULT_SALTS) -> DataFrame:
    """First k rows per key, with their rank.

    Round one ranks inside (key, salt) and keeps k rows of each; round two ranks the at most salts*k survivors of a
    key.  `order` must be total (end with a unique column), `spread` names the columns the salt is made of.
    """
    spread = list(spread or [c for c in df.columns if c not in keys][:1])
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*_cols(spread)), F.lit(salts)))
    first = W.partitionBy(*keys, "__salt").orderBy(*order)
    kept = salted.withColumn("__rn", F.row_number().over(first)).filter(F.col("__rn") <= k).drop("__rn", "__salt")
    return kept.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, k: int | None) -> DataFrame:
    """The first k rows of a sorted table, or all of them."""
    return df if k is None else df.limit(k)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, step: float, q: float | Column = 0.5,
                    out: str = "quantile", count: str = "n") -> DataFrame:
    """Exact interpolated quantile of `value` per key: (keys, n, quantile).

    Radix selection in two aggregations: histogram over buckets of width `step`, then over the values inside the one
    or two buckets that hold the wanted ranks.  Both are combined on the map side, so a hot key costs no more than a
    cold one and no task holds the values of a key.
    """
    keys = list(keys)
    d = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    d = d.withColumn("__b", F.floor(F.col("__v") / F.lit(float(step))))
    hist = d.groupBy(*keys, "__b").agg(F.count("*").alias("__c"))
    w = W.partitionBy(*keys)
    cum = w.orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = (hist.withColumn("__upto", F.sum("__c").over(cum)).withColumn(count, F.sum("__c").over(w))
              .withColumn("__pos", F.round((F.col(count) - 1) * (q if isinstance(q, Column) else F.lit(float(q))), 6))
              .withColumn("__lo", F.floor("__pos")).withColumn("__hi", F.ceil("__pos")))
    before = F.col("__upto") - F.col("__c")
    # ranks are 0-based; a bucket holds [before, upto)
    picked = ranked.filter((F.col("__lo") < F.col("__upto")) & (F.col("__hi") >= before)).select(
        *keys, "__b", count, "__pos", "__lo", "__hi", before.alias("__before"))
    inside = d.join(picked, keys + ["__b"]).groupBy(*keys, "__b", "__v", count, "__pos", "__lo", "__hi", "__before").agg(F.count("*").alias("__c"))
    inner = W.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.col("__before") + F.sum("__c").over(inner)
    located = inside.withColumn("__end", end).withColumn("__start", F.col("__end") - F.col("__c"))
    has = lambda r: (F.col(r) >= F.col("__start")) & (F.col(r) < F.col("__end"))
    return (located.groupBy(*keys, count, "__pos", "__lo")
            .agg(F.max(F.when(has("__lo"), F.col("__v"))).alias("__vlo"), F.max(F.when(has("__hi"), F.col("__v"))).alias("__vhi"))
            .select(*keys, count, (F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * (F.col("__pos") - F.col("__lo"))).alias(out)))


def previous_row(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], chunk: Column, prefix: str = "prev_") -> DataFrame:
    """Previous row of the same key as `prefix` columns.

    `chunk` is a value that never decreases along `order` (for example the day of the timestamp).  Rows are compared
    inside (key, chunk); the first row of a chunk takes the last row of the chunk before from a table with one row
    per (key, chunk), so that a key with very many rows is worked on by many tasks.
    """
    order, cols = list(order), list(cols)
    item = F.struct(*[F.col(c).alias(c) for c in cols])
    d = df.withColumn("__chunk", chunk)
    w = W.partitionBy(key, "__chunk").orderBy(*order)
    local = d.withColumn("__item", item).withColumn("__local", F.lag("__item").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    tails = d.groupBy(key, "__chunk").agg(F.max_by(item, F.struct(*order)).alias("__tail"))
    carried = tails.withColumn("__carry", F.lag("__tail").over(W.partitionBy(key).orderBy("__chunk"))).select(key, "__chunk", "__carry")
    joined = local.join(carried, [key, "__chunk"], "left")
    prev = F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__local"))
    out = joined.withColumn("__prev", prev)
    return out.select(*df.columns, *[F.col(f"__prev.{c}").alias(prefix + c) for c in cols])


def carry_forward(df: DataFrame, key: str, order: Sequence[str], value: str, out: str, chunk: Column) -> DataFrame:
    """Latest non-null `value` of the key up to and including the row.  As `previous_row`, chunk by chunk."""
    d = df.withColumn("__chunk", chunk)
    run = W.partitionBy(key, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = d.withColumn("__local", F.last(value, ignorenulls=True).over(run))
    tails = d.groupBy(key, "__chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("__tail"))
    before = W.partitionBy(key).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.withColumn("__carry", F.last("__tail", ignorenulls=True).over(before)).select(key, "__chunk", "__carry")
    return local.join(carried, [key, "__chunk"], "left").select(*df.columns, F.coalesce("__local", "__carry").alias(out))


def spread_scan(df: DataFrame) -> DataFrame:
    """A file scan with fewer splits than there are cores is spread over the cores, for work that is heavy per row.
    Large tables have more splits than cores and stay as they are: no shuffle is added."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if splits < cores else df


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when Spark's own size estimate of the plan is under the limit; otherwise the plan as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder for checkpoints."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the folder for checkpoints: lineage ends here, and several readers do not compute them again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rn") -> DataFrame:
    """Row number along `order`, from 1.  Rows are sorted in ranges and fixed by a checkpoint; ranges are counted, and each adds the rows
    before it to its own row numbers, so no task sees all rows."""
    checkpoint_dir(df.sparkSession)
    fixed = df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__m", 33)
    sizes = fixed.groupBy(part.alias("__p")).agg(F.count("*").alias("c"))
    # one row per range
    before = sizes.withColumn("__before", F.sum("c").over(W.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(W.unboundedPreceding, -1))).drop("c")
    j = fixed.withColumn("__p", part).join(before, "__p")
    return j.select(*df.columns, (F.coalesce("__before", F.lit(0)) + F.col("__m") - F.shiftleft(F.col("__p").cast("bigint"), 33) + 1).alias(rank))
