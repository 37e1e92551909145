"""Column profiling: what to drop, what is categorical, datetime or numeric.

Each check reads all columns in one aggregation; only per-column numbers reach the
driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.frames import unpivot
from riskframe.functions.values import sniff_types

# Limits of the column checks.
MISSING_LIMIT = 0.80
DISTINCT_LIMIT = 0.5
TOP_SHARE_LIMIT = 0.01
WORD_LIMIT = 5
MODEL_STD_LIMIT = 0.1
MODEL_MISSING_LIMIT = 0.997


def _text(c: str):
    return F.trim(F.col(f"`{c}`").cast("string"))


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: rows, present, distinct, deviation and longest word count."""
    names = list(columns or df.columns)
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    stats = []
    for i, c in enumerate(names):
        col = F.col(f"`{c}`")
        words = F.size(F.filter(F.split(_text(c), r"\s+"), lambda w: w != ""))
        stats += [
            F.count(col).alias(f"present{i}"),
            (F.stddev_samp(col) if c in numeric else F.lit(None).cast("double")).alias(f"std{i}"),
            F.max(words).alias(f"words{i}"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *stats)
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col("rows"), F.col(f"present{i}").alias("present"),
            F.col(f"std{i}").alias("std"), F.coalesce(F.col(f"words{i}"), F.lit(0)).alias("most_words"), F.lit(c in numeric).alias("numeric"),
        )
        for i, c in enumerate(names)
    ]
    facts = wide.select(F.inline(F.array(*rows))).join(distinct_values(df, names), "column_name", "left")
    return facts.select(
        "column_name", "rows", "present", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "std", "most_words", "numeric"
    )


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_name, distinct_values)`` of columns with any present value.

    Values are stacked as two hashes, 96 bits together, and combined before they are
    shuffled: no row is copied per column and no text leaves its task.
    """
    parts = [
        F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c).alias("c"), F.xxhash64(f"`{c}`").alias("h"), F.hash(f"`{c}`").alias("g")))
        for c in columns
    ]
    stacked = df.select(F.explode(F.array_compact(F.array(*parts))).alias("s")).select("s.*").distinct()
    return stacked.groupBy(F.col("c").alias("column_name")).agg(F.count(F.lit(1)).alias("distinct_values"))


def top_value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of each column's most frequent present value, all columns in one pass."""
    rows = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])).alias("s")
    ).select("s.*").where(F.col("v").isNotNull())
    counts = rows.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("column_name").agg((F.max("c") / F.sum("c")).alias("top_share"))


def missing_columns(prof: DataFrame, exclude: Sequence[str] = (), limit: float = MISSING_LIMIT) -> DataFrame:
    hit = (F.col("rows") - F.col("present")) / F.col("rows") > limit
    return prof.where(hit & ~F.col("column_name").isin(list(exclude))).select("column_name")


def near_unique_columns(prof: DataFrame, limit: float = DISTINCT_LIMIT) -> DataFrame:
    return prof.where(F.col("distinct_values") / F.col("rows") > limit).select("column_name")


def free_text_columns(prof: DataFrame, limit: int = WORD_LIMIT) -> DataFrame:
    return prof.where(F.col("most_words") > limit).select("column_name")


def constant_columns(prof: DataFrame) -> DataFrame:
    return prof.where(F.col("distinct_values") == 1).select("column_name")


def modelling_removals(prof: DataFrame, name_parts: Sequence[str]) -> DataFrame:
    """Columns unfit by name, constant, or near-unique and not numeric."""
    named = F.lit(False)
    for part in name_parts:
        named = named | F.lower("column_name").contains(part.lower())
    unique = (F.col("distinct_values") / F.col("rows") >= DISTINCT_LIMIT) & ~F.col("numeric")
    return prof.where(named | (F.col("distinct_values") <= 1) | unique).select("column_name")


def profile_removals(prof: DataFrame) -> DataFrame:
    """Numeric columns of almost no spread, and columns almost always missing."""
    flat = F.col("std") < MODEL_STD_LIMIT
    empty = (F.col("rows") - F.col("present")) / F.col("rows") > MODEL_MISSING_LIMIT
    return prof.where(flat | empty).select("column_name")


def names(found: DataFrame) -> list[str]:
    """Column names of a check (as many as the schema has, never data)."""
    return sorted(r["column_name"] for r in found.collect())


def drop(df: DataFrame, found: DataFrame) -> DataFrame:
    gone = set(names(found))
    return df.select(*[c for c in df.columns if c not in gone])


def assign_roles(df: DataFrame, amounts: Sequence[str], key: str) -> DataFrame:
    """(column_name, role): numeric for amounts, datetime, categorical, or dropped.

    Text and boolean columns are categorical if they pass the near-unique, rare-top
    and free-text checks.
    """
    rest = [c for c in df.columns if c != key and c not in amounts]
    kinds = {r["column_name"]: r["kind"] for r in sniff_types(df.select(*rest)).collect()}
    labels = [c for c in rest if kinds[c] in ("STRING", "BOOLEAN")]
    checked = profile(df, labels) if labels else None
    if checked is not None:
        shares = top_value_shares(df, labels)
        ok = (
            checked.join(shares, "column_name", "left")
            .where(F.col("distinct_values") / F.col("rows") <= DISTINCT_LIMIT)
            .where(F.coalesce("top_share", F.lit(1.0)) >= TOP_SHARE_LIMIT)
            .where(F.col("most_words") <= WORD_LIMIT)
        )
        kept = set(names(ok))
    else:
        kept = set()

    def role(c: str) -> str:
        if c in amounts:
            return "numeric"
        if kinds[c] == "DATETIME":
            return "datetime"
        return "categorical" if c in kept else "dropped"

    rows = [(c, role(c)) for c in df.columns if c != key]
    return df.sparkSession.createDataFrame(rows, "column_name STRING, role STRING")


def key_audit(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Null, duplicate and unmatched keys of both sides and whether counts agree: one row."""
    from riskframe.frames import with_scalars

    def side(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
        present = F.col(key).isNotNull()
        return counts.agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias(f"{name}_rows"),
            F.coalesce(F.sum(F.when(~present, F.col("c"))), F.lit(0)).alias(f"{name}_null_keys"),
            F.count_if(present & (F.col("c") > 1)).alias(f"{name}_duplicate_keys"),
        )

    def unmatched(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        return a.join(b.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias(f"{name}_unmatched"))

    out = side(features, "features")
    for part in (side(labels, "labels"), unmatched(features, labels, "features"), unmatched(labels, features, "labels")):
        out = with_scalars(out, part)
    return out.withColumn("equal_rows", F.col("features_rows") == F.col("labels_rows"))


def positives_per_feature(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Sum of the target where each 0/1 feature is set, all features in one pass."""
    sums = df.agg(*[F.coalesce(F.sum(F.when(F.col(f"`{c}`") == 1, F.col(target))), F.lit(0)).alias(c) for c in features])
    return unpivot(sums, [], features, "feature", "positives").orderBy(F.desc("positives"), "feature")
