"""Binning of continuous values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.frames import with_scalars
from riskframe.ordered import exact_quantiles

EPSILON = 1e-6
# Whole numbers that a double can hold: bins beyond could not be told apart.
MAX_BINS = 2**53


def bin_plan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Freedman-Diaconis plan of each column: one row per column, name in ``feature``.

    Columns are stacked and treated as groups, so all are fitted in the same passes.
    """
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
        ).alias("s")
    ).select("s.*")
    quartiles = exact_quantiles(stacked, ["feature"], "x", {"q1": 0.25, "q3": 0.75})
    ranges = stacked.where(F.col("x").isNotNull()).groupBy("feature").agg(
        F.count("x").alias("n"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
        F.max(F.when(~F.col("x").isin(0.0, 1.0), 1).otherwise(0)).alias("_other"),
    )
    width = 2 * (F.col("q3") - F.col("q1")) / F.pow(F.col("n"), F.lit(1 / 3))
    bins = F.ceil((F.col("high") - F.col("low") + EPSILON) / (width + EPSILON)) + 1
    return ranges.join(quartiles, "feature").select(
        "feature",
        "n",
        "low",
        "high",
        ((F.col("_other") == 0) & (F.col("high") > F.col("low"))).alias("binary"),
        F.least(bins, F.lit(MAX_BINS)).cast("long").alias("bins"),
    )


def bin_index(x: Column, low: Column, high: Column, bins: Column, binary: Column) -> Column:
    """Right-closed equal-width bin, lowest value included; constant columns give 0."""
    width = (high - low) / bins
    index = F.greatest(F.lit(0).cast("long"), F.ceil((x - low) / width).cast("long") - 1)
    return (
        F.when(x.isNull(), None)
        .when(high == low, F.lit(0).cast("long"))
        .when(binary, x.cast("long"))
        .otherwise(F.least(index, bins - 1))
    )


def discretize(df: DataFrame, columns: Sequence[str], suffix: str = "_bin") -> DataFrame:
    """Add the bin of each column.  Boolean columns become 0/1."""
    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    plan = bin_plan(numbers, columns)
    # One row per column: a map with a handful of entries, read as a scalar.
    packed = plan.agg(
        F.map_from_entries(
            F.collect_list(F.struct("feature", F.struct("low", "high", "bins", "binary")))
        ).alias("_plan")
    )
    rows = with_scalars(df, packed)

    def index(c: str) -> Column:
        p = F.col("_plan")[c]
        return bin_index(F.col(f"`{c}`").cast("double"), p["low"], p["high"], p["bins"], p["binary"])

    return rows.select(*df.columns, *[index(c).alias(f"{c}{suffix}") for c in columns])
