"""Inter-quartile-range outliers and range scaling per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.frames import attach, with_scalars
from riskframe.ordered import quantiles_of_counts
from riskframe.session import durable


def with_iqr_outliers(
    df: DataFrame, groups: Sequence[str], value: str, output: str = "iqr", confidence: bool = False
) -> DataFrame:
    """IQR outlier flag (0/1) or confidence (distance from the mean) of each row.

    Values are first made absolute, divided by the group's maximum and rounded to
    four places, so a group has at most 10 001 levels: its quartiles come exactly
    from their counts.  The flag compares strictly, the confidence does not.
    """
    x = F.abs(F.col(value).cast("double"))
    keys = list(groups)
    scaled = attach(df.withColumn("_x", x), keys, _max=F.max("_x"))
    scaled = scaled.withColumn("_x", F.when(F.col("_max") > 0, F.round(F.col("_x") / F.col("_max"), 4)))
    # Kept: quartiles and mean read it several times, and it has few rows.
    levels = durable(scaled.where(F.col("_x").isNotNull()).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")))
    quartiles = quantiles_of_counts(levels, keys, "_x", "_c", {"_q1": 0.25, "_q3": 0.75})
    mean = levels.groupBy(*keys).agg((F.sum(F.col("_x") * F.col("_c")) / F.sum("_c")).alias("_mean"))
    if keys:
        joined = scaled.join(durable(quartiles.join(mean, keys)), keys, "left")
    else:
        joined = with_scalars(with_scalars(scaled, quartiles), mean)
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    low, high = F.col("_q1") - reach, F.col("_q3") + reach
    if confidence:
        outside = (F.col("_x") <= low) | (F.col("_x") >= high)
        score = F.when(outside, F.abs(F.col("_mean") - F.col("_x"))).otherwise(0.0)
    else:
        score = F.when((F.col("_x") < low) | (F.col("_x") > high), 1).otherwise(0)
    return joined.select(*df.columns, score.alias(output))


def with_zero_one_scale(df: DataFrame, groups: Sequence[str], value: str, output: str) -> DataFrame:
    """Min-max scale per group; unchanged where the range is 0."""
    ranged = attach(df, groups, _lo=F.min(value), _hi=F.max(value))
    span = F.col("_hi") - F.col("_lo")
    scaled = F.when(span > 0, (F.col(value) - F.col("_lo")) / span).otherwise(F.col(value).cast("double"))
    return ranged.select(*df.columns, scaled.alias(output))


def scale_between(value: str, low: float, high: float):
    """Min-max scale with given bounds."""
    return (F.col(value) - low) / (high - low)
