"""Imputation: rare labels, dates, nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.frames import with_scalars
from riskframe.functions.text import category
from riskframe.functions.values import parse_date
from riskframe.ml.neighbours import nearest
from riskframe.ordered import exact_quantiles

# Fixed value: the unknown category.
UNKNOWN = "<||unknown||>"
RARE_SHARE = 0.01


def rare_labels(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(column_name, label): share below 1 % and never in the positive class.

    Columns are stacked, so one aggregation serves all of them.
    """
    stacked = df.select(
        F.coalesce(F.col(target), F.lit(0)).alias("_t"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), category(F.col(f"`{c}`")).alias("label")) for c in columns])
        ).alias("s"),
    ).select("_t", "s.*")
    counts = stacked.groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("_c"), F.max("_t").alias("_p"))
    totals = counts.groupBy("column_name").agg(F.sum("_c").alias("_n"))
    rare = counts.join(totals, "column_name").where((F.col("_c") / F.col("_n") < RARE_SHARE) & (F.col("_p") < 1))
    return rare.where(F.col("label").isNotNull()).select("column_name", "label")


def impute_rare_labels(df: DataFrame, rare: DataFrame, columns: Sequence[str], unknown: str = UNKNOWN) -> DataFrame:
    """Replace rare labels by the unknown category.

    A column may have as many rare labels as rows, so they are joined, not listed.
    """
    out = df
    for c in columns:
        labels = rare.where(F.col("column_name") == c).select(F.col("label").alias("_l"), F.lit(True).alias("_rare"))
        joined = out.withColumn("_l", category(F.col(f"`{c}`"))).join(labels, "_l", "left")
        value = F.when(F.col("_rare"), F.lit(unknown)).otherwise(F.col(f"`{c}`"))
        out = joined.select(*[value.alias(x) if x == c else F.col(f"`{x}`") for x in out.columns])
    return out


def impute_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing (or unreadable) dates become the column's exact median."""
    parsed = df.select(*[parse_date(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])
    stacked = parsed.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.unix_micros(c).cast("double").alias("v")) for c in columns])).alias("s")
    ).select("s.*")
    medians = exact_quantiles(stacked, ["k"], "v", {"m": 0.5})
    packed = medians.agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("_medians"))
    rows = with_scalars(parsed, packed)

    def filled(c: str):
        return F.coalesce(F.col(c), F.timestamp_micros(F.col("_medians")[c].cast("long"))).alias(c)

    return rows.select(*[filled(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def knn_impute(df: DataFrame, key: str, target: str, features: Sequence[str], k: int = 5) -> DataFrame:
    """Missing values of one column become the mean of their ``k`` nearest complete rows; ties go to the lower key."""
    vector = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])
    rows = df.select(F.col(key), vector.alias("_v"), F.col(f"`{target}`").cast("double").alias("_y"))
    known, gaps = rows.where(F.col("_y").isNotNull()), rows.where(F.col("_y").isNull())
    found = nearest(gaps, known, key, "_v", k)
    values = known.select(F.col(key).alias("neighbour"), "_y")
    means = found.join(values, "neighbour").groupBy(key).agg(F.avg("_y").alias("_fill"))
    out = df.join(means, key, "left")
    return out.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), "_fill").alias(c) if c == target else F.col(f"`{c}`") for c in df.columns])
