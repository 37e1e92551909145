"""Exact order statistics against numpy, with every large-group path forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.frames import attach, top_per_key
from riskframe.ordered import exact_quantiles, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, and a third of its values are the same number."""
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(30_000) < 0.34, 500.0, np.round(rng.lognormal(5, 2, 30_000), 2))
    rows = pd.DataFrame({"k": ["hot"] * 30_000 + ["cold"] * 37, "x": np.concatenate([hot, rng.normal(size=37)])})
    return rows, spark.createDataFrame(rows).repartition(6)


@pytest.mark.parametrize("whole", [10, 100_000])
@pytest.mark.parametrize("accuracy", [200, 10_000])
def test_quantiles(skewed, whole, accuracy):
    rows, df = skewed
    wanted = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    if whole == 10:
        rows, df = rows[rows.k == "hot"], df.where("k = 'hot'")
    got = exact_quantiles(df, ["k"], "x", wanted, accuracy, whole).toPandas().set_index("k")
    for key, part in rows.groupby("k"):
        for name, p in wanted.items():
            assert got.loc[key, name] == pytest.approx(part.x.quantile(p), abs=1e-9)


def test_quantiles_whole_table(skewed):
    rows, df = skewed
    got = exact_quantiles(df, [], "x", {"m": 0.5}).first()["m"]
    assert got == pytest.approx(rows.x.median())


@pytest.mark.parametrize("slice_rows", [40, 1_000_000])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, slice_rows, descending):
    rows, df = skewed
    counts = df.groupBy("k", "x").agg(F.count(F.lit(1)).alias("c"))
    got = running_totals(counts, ["k"], "x", {"upto": "c"}, descending, slice_rows).toPandas()
    want = rows.groupby(["k", "x"]).size().rename("c").reset_index().sort_values("x", ascending=not descending)
    want["upto"] = want.groupby("k").c.cumsum()
    merged = got.merge(want, on=["k", "x"])
    assert len(merged) == len(want) == len(got)
    assert (merged.upto_x == merged.upto_y).all()


def test_attach_and_top(skewed):
    rows, df = skewed
    total = attach(df, ["k"], s=F.count(F.lit(1))).groupBy("k").agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("n"))
    assert all(r.s == r.n for r in total.collect())
    assert attach(df, [], n=F.count(F.lit(1))).first()["n"] == len(rows)
    top = top_per_key(df, ["k"], [F.desc("x")], 3)
    assert top.count() == 6
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # map tasks are cut before the shuffle


def test_a_hot_key_is_split(spark):
    """With broadcasts off and nine tenths of all rows in one key, no task holds more than a fair share."""
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        df = spark.range(200_000).repartition(8).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("v"))
        out = attach(df, ["k"], total=F.count(F.lit(1))).withColumn("task", F.spark_partition_id())
        tasks = out.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("v"), F.max("total")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["n"] for r in tasks) == 200_000 and max(r["n"] for r in tasks) < 90_000


def test_statistics_without_keys_need_no_cross_join(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plan = exact_quantiles(df, [], "x", {"m": 0.5})
    text = plan._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert plan.first()["m"] == 499.5
