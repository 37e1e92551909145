"""Feature selection: no-impact and constant features, evidence weights, mutual
information, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.frames import attach
from riskframe.ml.persist import SavedStage
from riskframe.operators.scaling import discretize
from riskframe.prep.columns import positives_per_feature
from riskframe.session import durable

EPSILON = 1e-6
CORRELATION_PERCENT = 90
# Values of a block: a Python process holds a few times their size, whatever the number of rows.
BLOCK_VALUES = 1_000_000


def no_impact_patterns(features: Sequence[str], patterns: Sequence[str], separator: str = "=") -> list[str]:
    """One-hot columns for a test pattern that did not fire."""
    gone = {f"{p}{separator}false".lower() for p in patterns}
    return [f for f in features if f.lower() in gone]


def no_impact_features(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features that sum to 0 over the positives, from one aggregation."""
    sums = df.where(F.col(target) == 1).agg(*[F.coalesce(F.sum(F.col(f"`{c}`").cast("double")), F.lit(0.0)).alias(c) for c in features])
    from riskframe.frames import unpivot

    return unpivot(sums, [], features, "feature", "total").where(F.col("total") == 0).select("feature")


def evidence(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Weight of evidence per (feature, bin): ln((no% + 1e-6) / (yes% + 1e-6))."""
    binned = discretize(df.select(target, *[F.col(f"`{c}`") for c in features]), features, "_woebin")
    return evidence_of_bins(_bins_only(binned, features, target), features, target)


def _bins_only(binned: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    return binned.select(target, *[F.col(f"`{c}_woebin`").alias(c) for c in features])


def evidence_of_bins(binned: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    stacked = binned.select(
        F.col(target).alias("_t"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("long").alias("bin")) for c in features])).alias("s"),
    ).select("_t", "s.*").where(F.col("bin").isNotNull())
    counts = stacked.groupBy("feature", "bin").agg(F.count("_t").alias("total"), F.sum("_t").alias("concern"))
    counts = counts.withColumn("no_concern", F.col("total") - F.col("concern"))
    shares = attach(counts, ["feature"], _yes=F.sum("concern"), _no=F.sum("no_concern"))
    woe = F.log((F.col("no_concern") / F.col("_no") + EPSILON) / (F.col("concern") / F.col("_yes") + EPSILON))
    return shares.select("feature", "bin", "total", "concern", "no_concern", woe.alias("woe"))


def with_evidence(df: DataFrame, features: Sequence[str], target: str, suffix: str = "_WoE") -> DataFrame:
    """Add the weight of evidence of each feature's bin."""
    binned = discretize(df, features, "_woebin")
    table = evidence_of_bins(_bins_only(binned, features, target), features, target)
    out = binned
    for c in features:
        one = table.where(F.col("feature") == c).select(F.col("bin").alias(f"{c}_woebin"), F.col("woe").alias(f"{c}{suffix}"))
        out = out.join(one, f"{c}_woebin", "left")
    return out.select(*df.columns, *[f"{c}{suffix}" for c in features])


def joint_counts(df: DataFrame, columns: Sequence[str], block_values: int = BLOCK_VALUES) -> DataFrame:
    """(i, j, x, y, c): rows in which columns i <= j hold the levels x and y; nulls do not count.

    Tasks number the levels of a block of rows per column and count all pairs of
    columns as integers; only cells with a count leave a block, and tasks combine
    theirs before the shuffle.  So what is shuffled grows with tasks and levels, not
    with rows times pairs.  A block holds about ``block_values`` values.
    """
    names = list(columns)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = max(1, block_values // len(names))

        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            levels, codes = [], []
            for column in table.columns:
                gone = column.is_null().to_numpy()
                found, code = np.unique(column.fill_null(0.0).to_numpy() + 0.0, return_inverse=True)
                code = code.astype(np.int64)
                code[gone] = len(found)  # a null is a level of its own, which is never sent
                levels.append(found)
                codes.append(code)
            for i, x in enumerate(levels):
                for j in range(i, len(names)):
                    width = len(levels[j]) + 1
                    cells = codes[i] * width + codes[j]
                    if (len(x) + 1) * width <= 4 * len(cells) + 1024:
                        counts = np.bincount(cells)
                        cells = np.flatnonzero(counts)
                        counts = counts[cells]
                    else:
                        cells, counts = np.unique(cells, return_counts=True)
                    at, other = np.divmod(cells, width)
                    keep = (at < len(x)) & (other < width - 1)
                    at, other, counts = at[keep], other[keep], counts[keep].astype(np.int64)
                    size = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, i, np.int32)), pa.array(np.full(size, j, np.int32)), pa.array(x[at]), pa.array(levels[j][other]), pa.array(counts)],
                        names=["i", "j", "x", "y", "c"],
                    )

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                yield from block(held)
                held, rows = [], 0
        if rows:
            yield from block(held)

    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"_{k}") for k, c in enumerate(names)])
    cells = numbers.mapInArrow(counted, "i int, j int, x double, y double, c long")
    return cells.groupBy("i", "j", "x", "y").agg(F.sum("c").alias("c"))


def mutual_information(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plug-in mutual information of every column pair (a before b, and a with itself).

    Columns hold discrete levels.  With counts c of cells, and of levels of either side,
    it is (sum c ln c - sum cx ln cx - sum cy ln cy) / n + ln n: sums of one small table
    of joint counts, without a join.
    """
    joint = durable(joint_counts(df, columns))

    def part(counts: DataFrame, sign: int) -> DataFrame:
        return counts.select("i", "j", (sign * F.col("c") * F.log("c")).alias("s"), (F.col("c") if sign > 0 else F.lit(0)).alias("n"))

    sides = [joint.groupBy("i", "j", side).agg(F.sum("c").alias("c")) for side in ("x", "y")]
    parts = part(joint, 1).unionByName(part(sides[0], -1)).unionByName(part(sides[1], -1))
    total = F.sum("n")
    out = parts.groupBy("i", "j").agg((F.sum("s") / total + F.log(total)).alias("mutual_information"))
    named = F.lit(list(columns))
    return out.select(F.get(named, "i").alias("feature1"), F.get(named, "j").alias("feature2"), "mutual_information")


def redundant_features(information: DataFrame, features: Sequence[str], target: str, percent: float = CORRELATION_PERCENT) -> list[str]:
    """Features sharing over ``percent`` of an earlier feature's largest information,
    except the one that tells most about the target.

    Works on the (small) feature-by-feature table, already collected once.
    """
    mi = {}
    for r in information.collect():
        mi[r["feature1"], r["feature2"]] = mi[r["feature2"], r["feature1"]] = r["mutual_information"]
    dropped: list[str] = []
    for i, f in enumerate(features):
        if f in dropped:
            continue
        row = {g: mi[f, g] for g in features[i:] if g not in dropped}
        top = max(row.values()) + EPSILON
        close = [g for g, v in row.items() if (v + EPSILON) / top > percent / 100]
        if close:
            keep = max(close, key=lambda g: mi[g, target])
            dropped += [g for g in close if g != keep]
    return dropped


def correlated_features(pairs: DataFrame, threshold: float = 0.8) -> list[str]:
    """Remove the feature with most strong correlations (first side of its pairs, as
    counted there), again and again; correlations are computed once."""
    strong = [(r["feature1"], r["feature2"]) for r in pairs.where(F.abs("correlation") >= threshold).collect()]
    removed = []
    while strong:
        counts: dict[str, int] = {}
        for a, _ in strong:
            counts[a] = counts.get(a, 0) + 1
        worst = max(sorted(counts), key=lambda f: counts[f])
        removed.append(worst)
        strong = [p for p in strong if worst not in p]
    return removed


class FeatureSelection(SavedStage, Estimator):
    """Drop silent patterns, features without positives, constants and redundant ones; vectors of levels stay as they are."""

    FACTS = ("key", "target", "patterns", "separator", "percent")

    def __init__(self, key: str, target: str, patterns: Sequence[str] = (), separator: str = "=", percent: float = CORRELATION_PERCENT):
        super().__init__()
        self.key, self.target, self.patterns = key, target, list(patterns)
        self.separator, self.percent = separator, percent

    def _fit(self, dataset: DataFrame) -> FeatureSelectionModel:
        from riskframe.prep.columns import constant_columns, names, profile

        vectors = [f.name for f in dataset.schema if isinstance(f.dataType, VectorUDT)]
        features = [c for c in dataset.columns if c not in (self.key, self.target, *vectors)]
        silent = set(no_impact_patterns(features, self.patterns, self.separator))
        features = [f for f in features if f not in silent]
        idle = {r["feature"] for r in no_impact_features(dataset, features, self.target).collect()}
        features = [f for f in features if f not in idle]
        if features:
            constant = set(names(constant_columns(profile(dataset, features))))
            features = [f for f in features if f not in constant]
        if len(features) > 1:
            woe = durable(with_evidence(dataset.select(self.target, *[F.col(f"`{f}`") for f in features]), features, self.target))
            named = woe.select(self.target, *[F.col(f"`{f}_WoE`").alias(f) for f in features])
            information = mutual_information(named, [*features, self.target])
            gone = set(redundant_features(information, features, self.target, self.percent))
            features = [f for f in features if f not in gone]
        return FeatureSelectionModel(self.key, self.target, sorted(features + vectors))


class FeatureSelectionModel(SavedStage, Model):
    FACTS = ("key", "target", "features")

    def __init__(self, key: str, target: str, features: list[str]):
        super().__init__()
        self.key, self.target, self.features = key, target, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = [c for c in (self.key, self.target) if c in dataset.columns]
        return dataset.select(*keep, *[F.col(f"`{f}`") for f in self.features])


__all__ = [
    "FeatureSelection", "correlated_features", "evidence", "mutual_information", "no_impact_features",
    "no_impact_patterns", "positives_per_feature", "redundant_features", "with_evidence",
]
