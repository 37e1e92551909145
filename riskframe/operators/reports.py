"""Reports on patterns, amounts, predictions and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.frames import unpivot
from riskframe.prep.columns import distinct_values

# Smallest training set, per class and in all.
MIN_PER_CLASS = 2
MIN_FOR_TRAINING = 60


def enabled_patterns(patterns: DataFrame, module: str, submodule: str) -> DataFrame:
    """Enabled patterns of a submodule, heaviest first."""
    wanted = (F.col("is_enabled") == 1) & (F.col("module") == module) & (F.col("submodule") == submodule)
    return patterns.where(wanted).orderBy(F.desc("weight"), "pattern_id")


def question_list(questions: DataFrame, render_type: str, template: str, template_id: object) -> DataFrame:
    """Radio-button or check-box questions, or those of one template."""
    return questions.where(F.col(render_type).isin(4, 6) | (F.col(template) == template_id))


def amount_and_count(df: DataFrame, group: Sequence[str], amount: str, prediction: str) -> DataFrame:
    """Rows, total amount, concern rows and concern amount, in one aggregation."""
    concern = F.col(prediction) == 1
    value = F.coalesce(F.col(amount).cast("double"), F.lit(0.0))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.sum(value).alias("total_amount"),
        F.count_if(concern).alias("concern_count"),
        F.coalesce(F.sum(F.when(concern, value)), F.lit(0.0)).alias("concern_amount"),
    )


def top_risk_patterns(patterns: DataFrame) -> DataFrame:
    """Enabled patterns that were tested and failed, with the failed share."""
    hit = (F.col("TestedCount") > 0) & (F.col("FailedCount") > 0) & (F.col("IsEnabled") == 1)
    share = F.round(F.col("FailedCount") * 100.0 / F.col("TestedCount"), 2)
    return patterns.where(hit).select(
        "Module", "SubModule", "PatternID", "PatternDescriptionLong", "KRI", "TestedCount", "FailedCount",
        share.alias("FailedCount_Percent"),
    )


def alert_counts(answers: DataFrame, group: Sequence[str], alert: str, row: str) -> DataFrame:
    """Distinct alerts and distinct transactions per group.

    Pre-aggregated per (group, alert) and (group, row) by Spark's distinct
    aggregation, so a hot group is spread over its members.
    """
    return answers.groupBy(*group).agg(
        F.count_distinct(alert).alias("alerts"), F.count_distinct(row).alias("transactions")
    )


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Absolute and relative frequency of each present value."""
    from riskframe.frames import attach

    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    total = attach(counts, [], _total=F.sum("count"))
    return total.select(column, "count", (F.col("count") / F.col("_total")).alias("share"))


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count and share per column that has any, most missing first."""
    names = df.columns
    missing = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names])
    long = unpivot(missing, ["_n"], names, "column_name", "missing")
    rows = long.where(F.col("missing") > 0)
    share = F.col("missing") / F.col("_n")
    return rows.select("column_name", "missing", share.alias("share")).orderBy(F.desc("missing"), "column_name")


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column with the row count, all columns in one pass."""
    if approximate:
        wide = df.agg(F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in columns])
        return unpivot(wide, ["rows"], columns, "column_name", "distinct_values")
    named = df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"))
    counted = named.join(distinct_values(df, columns), "column_name", "left")
    return counted.select("rows", "column_name", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))


def describe(df: DataFrame, groups: Sequence[str], column: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, per group."""
    from riskframe.ordered import exact_quantiles

    x = F.col(column).cast("double")
    basic = df.groupBy(*groups).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    quartiles = exact_quantiles(df, groups, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    if groups:
        return basic.join(quartiles, list(groups), "left")
    from riskframe.frames import with_scalars

    return with_scalars(basic, quartiles)


def correlation_pairs(df: DataFrame, columns: Sequence[str], chunk: int = 300) -> DataFrame:
    """Pearson correlation of every column pair (a before b), pairwise complete.

    All pairs of a chunk come from one aggregation over the rows.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = None
    for start in range(0, len(pairs), chunk):
        part = pairs[start : start + chunk]
        r = df.agg(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("feature1"), F.lit(b).alias("feature2"),
                        F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias("correlation"),
                    )
                    for a, b in part
                ]
            ).alias("p")
        ).select(F.inline("p"))
        out = r if out is None else out.unionByName(r)
    return out


def correlation_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both triangles and the diagonal of a pair table, one row per ordered pair."""
    flipped = pairs.select(F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), "correlation")
    own = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], pairs.schema)
    return pairs.unionByName(flipped).unionByName(own)


def high_correlations(pairs: DataFrame, target: str, threshold: float = 0.8) -> DataFrame:
    """Strongly correlated feature pairs with each side's correlation to the target."""
    with_target = pairs.where((F.col("feature1") == target) | (F.col("feature2") == target)).select(
        F.when(F.col("feature1") == target, F.col("feature2")).otherwise(F.col("feature1")).alias("_f"),
        F.col("correlation").alias("_r"),
    )
    rest = pairs.where((F.col("feature1") != target) & (F.col("feature2") != target))
    rest = rest.where(F.abs("correlation") > threshold)
    first = with_target.select(F.col("_f").alias("feature1"), F.col("_r").alias("target_correlation1"))
    second = with_target.select(F.col("_f").alias("feature2"), F.col("_r").alias("target_correlation2"))
    return rest.join(first, "feature1", "left").join(second, "feature2", "left").select(
        "feature1", "feature2", "correlation", "target_correlation1", "target_correlation2"
    )


def correlation_histogram(pairs: DataFrame) -> DataFrame:
    """Pairs per tenth of absolute correlation, right-closed, 0 in the first."""
    size = F.abs("correlation")
    tenth = F.greatest(F.lit(0), F.ceil(F.round(size * 10, 9)).cast("int") - 1)
    present = pairs.where(F.col("correlation").isNotNull() & ~F.isnan("correlation"))
    return present.groupBy(tenth.alias("tenth")).agg(F.count(F.lit(1)).alias("pairs"))


def redundancy_ratio(pairs: DataFrame, target: str) -> DataFrame:
    """Sum of a feature's absolute correlations (its own 1 included) over that with the target."""
    both = pairs.select("feature1", "feature2", "correlation").unionByName(
        pairs.select(F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), "correlation")
    )
    r = F.abs("correlation")
    sums = both.where(F.col("feature1") != target).groupBy(F.col("feature1").alias("feature")).agg(
        (1 + F.sum(F.when(F.col("feature2") != target, r).otherwise(0.0))).alias("sum_correlation"),
        F.max(F.when(F.col("feature2") == target, r)).alias("target_correlation"),
    )
    return sums.withColumn("ratio", F.col("sum_correlation") / F.col("target_correlation"))


def score_sum_label(df: DataFrame, columns: Sequence[str], cut: float, total: str = "total", label: str = "label") -> DataFrame:
    """Row-wise sum of score columns (missing as 0) and whether it exceeds a cut."""
    added = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))
    return df.withColumn(total, added).withColumn(label, (F.col(total) > cut).cast("int"))


def last_prediction(predictions: DataFrame) -> DataFrame:
    """Each scored run with its number of predicted concerns."""
    return predictions.groupBy("Model_Name", "Prediction_DateTime").agg(
        F.count_if(F.col("ML_Prediction") == 1).alias("concerns")
    )


def reconcile_predictions(predictions: DataFrame, base: DataFrame, column: str = "ML_Prediction") -> DataFrame:
    """Whether the base table shows as many concerns as the predictions: one row."""
    from riskframe.frames import with_scalars

    a = predictions.agg(F.count_if(F.col(column) == 1).alias("predicted_concerns"))
    b = base.agg(F.count_if(F.col(column) == 1).alias("base_concerns"))
    return with_scalars(a, b).withColumn("is_updated", F.col("predicted_concerns") == F.col("base_concerns"))


def class_balance(labels: DataFrame, target: str = "target") -> DataFrame:
    """Class counts and whether they suffice for training: one row."""
    counts = labels.agg(
        F.count_if(F.col(target) == 1).alias("concern"), F.count_if(F.col(target) == 0).alias("no_concern")
    )
    enough = (F.least("concern", "no_concern") >= MIN_PER_CLASS) & (
        F.col("concern") + F.col("no_concern") >= MIN_FOR_TRAINING
    )
    return counts.withColumn("enough_data", enough)


def leaderboard(runs: DataFrame, modules: DataFrame) -> DataFrame:
    """Run metrics as percentages under their module and submodule names."""
    metrics = ("f1", "precision", "recall", "accuracy", "balanced_accuracy")
    joined = runs.join(modules, "submodule_id")
    return joined.select(
        "module", "submodule", "experiment", "model", *[F.round(F.col(m) * 100, 2).alias(m) for m in metrics]
    )


def named_lookup(df: DataFrame, mapping: DataFrame, pattern: str, columns: Mapping[str, str]) -> DataFrame:
    """Add the mapped names of a pattern id (null where unmapped)."""
    wanted = mapping.select(pattern, *[F.col(src).alias(out) for out, src in columns.items()])
    return df.join(wanted, pattern, "left")
