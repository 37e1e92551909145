"""Classifier metrics as aggregations: confusion, curves, thresholds, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.ordered import SLICE_ROWS, running_totals


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(df: DataFrame, target: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(target) == 1, F.col(prediction) == 1
    return df.groupBy(*groups).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, ROC-AUC on labels, F1, precision, recall, unrounded."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    balanced = (recall + specificity) / 2
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
            "balanced_accuracy": balanced,
            "roc_auc": balanced,
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "precision": _ratio(tp, tp + fp),
            "recall": recall,
        }
    )


METRICS = ("accuracy", "balanced_accuracy", "roc_auc", "f1", "precision", "recall")


def metrics(df: DataFrame, target: str, prediction: str, groups: Sequence[str] = (), places: int = 3) -> DataFrame:
    rates = with_rates(confusion(df, target, prediction, groups))
    return rates.select(*groups, *[F.round(m, places).alias(m) for m in METRICS])


def confusion_shares(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Share of all rows in each (actual, predicted) cell."""
    from riskframe.frames import attach

    cells = df.groupBy(F.col(target).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("_c"))
    return attach(cells, [], _n=F.sum("_c")).select("actual", "predicted", (F.col("_c") / F.col("_n")).alias("share"))


def classification_report(df: DataFrame, target: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    y, p = F.col(target).cast("long"), F.col(prediction).cast("long")
    sides = df.select(F.explode(F.array(F.struct(y.alias("class"), F.lit("y").alias("side"), (y == p).alias("hit")), F.struct(p.alias("class"), F.lit("p").alias("side"), (y == p).alias("hit")))).alias("s")).select("s.*")
    counts = sides.groupBy("class").agg(
        F.count_if((F.col("side") == "y") & F.col("hit")).alias("_tp"),
        F.count_if(F.col("side") == "y").alias("support"), F.count_if(F.col("side") == "p").alias("_predicted"),
    )
    tp = F.col("_tp")
    return counts.select(
        "class", _ratio(tp, F.col("_predicted")).alias("precision"), _ratio(tp, F.col("support")).alias("recall"),
        _ratio(2 * tp, F.col("_predicted") + F.col("support")).alias("f1"), "support",
    )


def curve_points(df: DataFrame, target: str, score: str, groups: Sequence[str] = (), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One point per distinct score, highest first: true/false positives at or above it,
    rates, precision and recall."""
    groups = list(groups)
    at = df.where(F.col(score).isNotNull()).groupBy(*groups, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(target) == 1).alias("_p"), F.count_if(F.col(target) != 1).alias("_n")
    )
    ranked = running_totals(at, groups, "threshold", {"tp": "_p", "fp": "_n"}, descending=True, slice_rows=slice_rows)
    totals = at.groupBy(*groups).agg(F.sum("_p").alias("_pos"), F.sum("_n").alias("_neg"))
    if groups:
        placed = ranked.join(totals, groups)
    else:
        from riskframe.frames import with_scalars

        placed = with_scalars(ranked, totals)
    tp, fp = F.col("tp"), F.col("fp")
    return placed.select(
        *groups, "threshold", "tp", "fp", _ratio(fp, F.col("_neg")).alias("fpr"), _ratio(tp, F.col("_pos")).alias("tpr"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, F.col("_pos")).alias("recall"), F.col("_p").alias("_step_p"), F.col("_n").alias("_step_n"),
    )


def roc_auc(df: DataFrame, target: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids (equal scores count half)."""
    points = curve_points(df, target, score, groups)
    area = F.sum(F.col("_step_n") * (F.col("tp") - F.col("_step_p") / 2))
    return points.groupBy(*groups).agg((area / (F.sum("_step_p") * F.sum("_step_n"))).alias("auc"))


def threshold_sweep(df: DataFrame, target: str, score: str, low: float = 0.2, high: float = 0.8, step: float = 0.01) -> DataFrame:
    """Rates and the combined score at each threshold (0.2 up to, not with, 0.8).

    Rows fall into the interval between two thresholds once; sixty cumulative counts
    follow from the interval counts.
    """
    n = round((high - low) / step)
    cuts = [round(low + i * step, 10) for i in range(n)]
    s = F.col(score).cast("double")
    slot = F.lit(-1)
    slot = F.least(F.floor((s - low) / step), F.lit(n - 1)).cast("int")
    # Correct the slot for the representation of the cuts themselves.
    edges = F.array(*[F.lit(c) for c in cuts])
    slot = F.when(s < cuts[0], -1).otherwise(slot)
    slot = F.when((slot >= 0) & (F.get(edges, slot) > s), slot - 1).otherwise(slot)
    slot = F.when((slot < n - 1) & (F.get(edges, slot + 1) <= s), slot + 1).otherwise(slot)
    counts = df.where(s.isNotNull()).groupBy(slot.alias("_slot")).agg(
        F.count_if(F.col(target) == 1).alias("_p"), F.count_if(F.col(target) != 1).alias("_n")
    )
    spread = counts.select("_p", "_n", F.explode(F.transform(edges, lambda c, i: F.struct(c.alias("threshold"), (i <= F.col("_slot")).alias("above")))).alias("t")).select("_p", "_n", "t.*")
    up, p, q = F.col("above"), F.col("_p"), F.col("_n")
    table = spread.groupBy("threshold").agg(
        F.sum(F.when(up, p).otherwise(0)).alias("tp"), F.sum(F.when(up, q).otherwise(0)).alias("fp"),
        F.sum(F.when(up, 0).otherwise(p)).alias("fn"), F.sum(F.when(up, 0).otherwise(q)).alias("tn"),
    )
    rates = with_rates(table)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return rates.select(
        "threshold", "precision", "recall", "f1", _ratio(fp, fp + tn).alias("fpr"), _ratio(fn, fn + tp).alias("fnr"),
        _ratio(tp, tp + fn).alias("tpr"), _ratio(tn, tn + fp).alias("tnr"),
        (F.col("recall") + 0.8 * F.col("f1") + 0.6 * F.col("precision")).alias("score"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The highest threshold among those with the best combined score."""
    return sweep.groupBy().agg(F.max(F.struct(F.round("score", 12).alias("s"), "threshold")).alias("b")).select(
        F.col("b")["threshold"].alias("threshold"), F.col("b")["s"].alias("score")
    )


def threshold_by_precision(df: DataFrame, key: str, target: str, score: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Per fold the threshold of best precision: most true positives, then lowest
    threshold, among equals.  ``decision_threshold`` is their mean."""
    from riskframe.ml.split import hash_unit

    fold = F.floor(hash_unit(key, F.lit(seed)) * folds).cast("int").alias("fold")
    points = curve_points(df.select(fold, target, score), target, score, ["fold"])
    best = points.where(F.col("tp") > 0).groupBy("fold").agg(
        F.max(F.struct("precision", "tp", (-F.col("threshold")).alias("t"))).alias("_b")
    )
    return best.select("fold", (-F.col("_b")["t"]).alias("threshold"), F.col("_b")["precision"].alias("precision"))


def decision_threshold(df: DataFrame, key: str, target: str, score: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """One row: the mean of the folds' thresholds, to three decimals; null without a positive row."""
    found = threshold_by_precision(df, key, target, score, folds, seed)
    return found.groupBy().agg(F.round(F.avg("threshold"), 3).alias("threshold"))
