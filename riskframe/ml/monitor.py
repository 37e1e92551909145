"""Drift of an active model and the monitoring log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.frames import top_per_key
from riskframe.ml.metrics import confusion, with_rates

# Fixed value: change of the F1 score, in percent, that matters.
CHANGE_PERCENT = 5.0


def decision(change: Column) -> Column:
    """A drop beyond 5 % alerts, a rise beyond 5 % is recorded."""
    return F.when(change < -CHANGE_PERCENT, "alert").when(change > CHANGE_PERCENT, "record").otherwise("none")


def drift(scored: DataFrame, labels: DataFrame, key: str, target: str, prediction: str, old_f1: float | Column, groups: Sequence[str] = ()) -> DataFrame:
    """F1 on newly labelled rows against the model's recorded F1 (0..1)."""
    joined = scored.join(labels, key)
    cells = with_rates(confusion(joined, target, prediction, groups))
    old = (old_f1 if isinstance(old_f1, Column) else F.lit(float(old_f1))) * 100
    new = F.col("f1") * 100
    change = F.when(old != 0, (new - old) / old * 100).otherwise(0.0)
    return cells.select(
        *groups, F.round(old, 2).alias("old_f1_score"), F.round(new, 2).alias("new_f1_score"),
        F.round(change, 2).alias("percentage_change"), (F.col("tp") + F.col("fp")).alias("concern_count"),
        (F.col("tn") + F.col("fn")).alias("no_concern_count"), decision(change).alias("decision"),
    )


def upsert(log: DataFrame, new: DataFrame, run_id: str, order: str) -> DataFrame:
    """The log with one row per run: the latest by ``order``, new rows first on a tie."""
    both = log.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return top_per_key(both, [run_id], [F.desc(order), F.desc("_new")]).drop("_new")
