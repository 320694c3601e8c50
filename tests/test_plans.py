"""The physical patterns against brute force, with one key that holds a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pressdelta.plans.patterns import carry_forward, group_quantiles, previous_row, small, top_per_group


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame({"key": key, "id": np.arange(n), "v": rng.integers(0, 500, n), "t": rng.permutation(n)})
    pdf["maybe"] = np.where(rng.random(n) < 0.3, pdf.v, np.nan)
    return pdf, spark.createDataFrame(pdf).withColumn("maybe", F.when(~F.isnan("maybe"), F.col("maybe")))


def test_top_per_group(skewed):
    pdf, df = skewed
    got = top_per_group(df, ["key"], [F.desc("v"), F.asc("id")], 7, spread=["id"]).toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).groupby("key").head(7)
    assert sorted(got.id) == sorted(want.id)
    assert got.groupby("key").rn.apply(lambda r: sorted(r) == list(range(1, len(r) + 1))).all()


@pytest.mark.parametrize("q", [0.25, 0.5, 0.9])
def test_group_quantiles(skewed, q):
    pdf, df = skewed
    got = group_quantiles(df, ["key"], "v", 16.0, q).toPandas().set_index("key")["quantile"]
    want = pdf.groupby("key").v.quantile(q)
    assert np.allclose(got.sort_index(), want.sort_index())


def test_previous_row_across_chunks(skewed):
    pdf, df = skewed
    got = previous_row(df, "key", ["t"], ["v"], F.floor(F.col("t") / 100)).toPandas().set_index("id").prev_v
    want = pdf.sort_values("t").groupby("key").v.shift().rename("w")
    both = pd.concat([got, want], axis=1)
    assert ((both.prev_v == both.w) | (both.prev_v.isna() & both.w.isna())).all()


def test_carry_forward_across_chunks(skewed):
    pdf, df = skewed
    got = carry_forward(df, "key", ["t"], "maybe", "last", F.floor(F.col("t") / 100)).toPandas().set_index("id")["last"]
    want = pdf.sort_values("t").groupby("key").maybe.ffill().rename("w")
    both = pd.concat([got, want], axis=1)
    assert ((both["last"] == both.w) | (both["last"].isna() & both.w.isna())).all()


def test_small_is_checked(spark):
    assert "broadcast" in small(spark.range(10).toDF("a"))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(spark.range(10).toDF("a"), limit=1)._jdf.queryExecution().logical().toString().lower()
