"""Training, tuning and choosing binary risk classifiers with Spark ML."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.ml.metrics import METRICS, confusion, decision_threshold, metrics
from riskframe.ml.persist import SavedStage, load_stage
from riskframe.ml.split import balanced, hash_unit, stratified_split
from riskframe.session import durable

SEED = 42
MAX_TRIALS = 150


class AdaBoostClassifier(SavedStage, Estimator):
    """Weighted one-level trees, boosted (discrete SAMME, two classes)."""

    FACTS = ("rounds", "label", "features", "depth")

    def __init__(self, rounds: int = 10, labelCol: str = "label", featuresCol: str = "features", maxDepth: int = 1):
        super().__init__()
        self.rounds, self.label, self.features, self.depth = rounds, labelCol, featuresCol, maxDepth

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        n = dataset.count()
        rows = dataset.select(self.label, self.features).withColumn("_w", F.lit(1.0 / n))
        stumps, weights = [], []
        for i in range(self.rounds):
            tree = DecisionTreeClassifier(
                labelCol=self.label, featuresCol=self.features, weightCol="_w", maxDepth=self.depth, seed=SEED + i
            ).fit(rows)
            tree.setPredictionCol("_p").setRawPredictionCol("").setProbabilityCol("")
            judged = tree.transform(rows)
            missed = F.col("_p") != F.col(self.label)
            error = judged.agg(F.sum(F.when(missed, F.col("_w")).otherwise(0.0)) / F.sum("_w")).first()[0]
            if error >= 0.5:
                break
            alpha = math.log((1 - error) / error) if error > 0 else 1.0
            stumps.append(tree)
            weights.append(alpha)
            if error == 0:
                break
            rows = durable(judged.select(self.label, self.features, (F.col("_w") * F.when(missed, math.exp(alpha)).otherwise(1.0)).alias("_w")))
        return AdaBoostModel(stumps, weights)


class AdaBoostModel(SavedStage, Model):
    FACTS, PARTS = ("weights",), ("stumps",)

    def __init__(self, stumps: list, weights: list[float]):
        super().__init__()
        self.stumps, self.weights = stumps, weights

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, names = dataset, []
        for i, stump in enumerate(self.stumps):
            name = f"_stump{i}"
            stump.setPredictionCol(name).setRawPredictionCol("").setProbabilityCol("")
            out = stump.transform(out)
            names.append(name)
        total = sum(self.weights) or 1.0
        votes = sum(((2 * F.col(n) - 1) * w for n, w in zip(names, self.weights)), F.lit(0.0)) / total
        out = out.withColumn("_decision", votes)
        p = 1 / (1 + F.exp(-F.col("_decision")))
        scored = out.withColumn("prediction", (F.col("_decision") > 0).cast("double")).withColumn("_p1", p)
        return scored.drop(*names, "_decision")


# The grids searched per algorithm.
GRIDS: dict[str, dict[str, list]] = {
    "Logistic Regression": {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0], "maxIter": [50, 100]},
    "Decision Tree": {"maxDepth": [3, 5, 8, 10], "minInstancesPerNode": [1, 5, 10], "impurity": ["gini", "entropy"]},
    "Random Forest": {"numTrees": [20, 50, 100], "maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 5]},
    "Gradient Boosting": {"maxIter": [10, 20, 50], "maxDepth": [2, 3, 5], "stepSize": [0.05, 0.1, 0.3]},
}


def classifiers(label: str = "label", features: str = "features") -> dict[str, Estimator]:
    common = {"labelCol": label, "featuresCol": features}
    return {
        "Logistic Regression": LogisticRegression(**common, maxIter=50),
        "Decision Tree": DecisionTreeClassifier(**common, seed=SEED),
        "Random Forest": RandomForestClassifier(**common, seed=SEED),
        "Gradient Boosting": GBTClassifier(**common, seed=SEED, maxIter=10),
        "Ada Boost": AdaBoostClassifier(labelCol=label, featuresCol=features),
    }


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    vectors = {f.name for f in df.schema if isinstance(f.dataType, VectorUDT)}
    one = lambda c: F.col(f"`{c}`") if c in vectors else F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0))
    numbers = df.withColumns({f"_f{i}": one(c) for i, c in enumerate(features)})
    inputs = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=inputs, outputCol=output).transform(numbers).drop(*inputs)


def positive_probability(scored: DataFrame):
    if "_p1" in scored.columns:
        return F.col("_p1")
    return vector_to_array("probability")[1]


def score(model: Model, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``ML_Prediction`` and ``ML_Prediction_Probability``."""
    scored = model.transform(df)
    p = positive_probability(scored)
    out = scored.withColumn("ML_Prediction_Probability", p)
    return out.select(*df.columns, (F.col("ML_Prediction_Probability") >= threshold).cast("int").alias("ML_Prediction"), "ML_Prediction_Probability")


def tune(estimator: Estimator, grid: Mapping[str, Sequence], train: DataFrame, label: str = "label", trials: int = 10, folds: int = 3, parallelism: int = 4, key: str | None = None):
    """Random sample of a grid, cross-validated for the positive class's F1.

    With a key, a row's fold is its hash: folds are then the same on every run and
    however the rows are partitioned.
    """
    combos = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    random.Random(SEED).shuffle(combos)
    maps = [{estimator.getParam(k): v for k, v in c.items()} for c in combos[: min(trials, MAX_TRIALS)]]
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0)
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, parallelism=parallelism, seed=SEED
    )
    if key is not None:
        train = train.withColumn("_fold", F.floor(hash_unit(key, F.lit(f"fold{SEED}")) * folds).cast("int"))
        search = search.setFoldCol("_fold")
    return search.fit(train).bestModel


@dataclass
class TrainedModel:
    name: str
    model: Model
    metrics: dict[str, float]
    features: list[str]
    confusion: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5


def better(new: Mapping[str, float], best: Mapping[str, float] | None) -> bool:
    """Higher precision wins, then higher F1."""
    if best is None:
        return True
    return (new["precision"], new["f1"]) >= (best["precision"], best["f1"])


def train(
    df: DataFrame, key: str, target: str, features: Sequence[str], algorithms: Sequence[str] | None = None,
    repeats: int = 1, trials: int = 0, folds: int = 3, balance: bool = False, own_threshold: bool = False,
) -> list[TrainedModel]:
    """Best model of each algorithm over repeated splits.

    ``balance`` makes minority rows and cleans up neighbours before the split, so made
    rows also reach the test part; keys are then text.  ``own_threshold`` sets each model's
    decision threshold by precision over folds of the training rows, else it is 0.5; models
    are judged, stored and applied with it.

    Constant predictions and an F1 of 0 or 1 are rejected.  Data is assembled and
    written once; fitting runs on the cluster.
    """
    data = durable(_balanced(assemble(df.select(key, F.col(target).cast("double").alias("label"), *[F.col(f"`{f}`") for f in features]), features).select(key, "label", "features"), key, balance))
    best: dict[str, TrainedModel] = {}
    for repeat in range(repeats):
        split = durable(stratified_split(data, key, "label", seed=SEED + repeat))
        fit_rows, test_rows = split.where(~F.col("is_test")), split.where("is_test")
        for name, estimator in classifiers().items():
            if algorithms and name not in algorithms:
                continue
            tuned = trials and name in GRIDS
            model = tune(estimator, GRIDS[name], fit_rows, trials=trials, folds=folds, key=key) if tuned else estimator.fit(fit_rows)
            threshold = _threshold(model, fit_rows, key) if own_threshold else 0.5
            judged = score(model, test_rows, threshold).select("label", "ML_Prediction")
            row = metrics(judged, "label", "ML_Prediction").first().asDict()
            cells = confusion(judged, "label", "ML_Prediction").first().asDict()
            predicted, total = cells["tp"] + cells["fp"], sum(cells.values())
            if predicted in (0, total) or row["f1"] in (0, 1):
                continue
            if better(row, best[name].metrics if name in best else None):
                best[name] = TrainedModel(name, model, row, list(features), {k: v / total for k, v in cells.items()}, threshold)
    return list(best.values())


def _balanced(data: DataFrame, key: str, balance: bool) -> DataFrame:
    if not balance:
        return data
    rows = balanced(durable(data.withColumn("features", vector_to_array("features"))), key, "label", "features")
    return rows.select(key, "label", array_to_vector("features").alias("features"))


def _threshold(model: Model, rows: DataFrame, key: str) -> float:
    scored = score(model, rows).select(key, "label", "ML_Prediction_Probability")
    found = decision_threshold(scored, key, "label", "ML_Prediction_Probability").first()["threshold"]
    return 0.5 if found is None else float(found)


def save_trained(trained: TrainedModel, spark: SparkSession, path: str) -> None:
    """Write a model and what scoring needs besides, for another session to load."""
    trained.model.write().overwrite().save(f"{path}/model")
    facts = {k: v for k, v in asdict(replace(trained, model=None)).items() if k != "model"}
    spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")


def load_trained(spark: SparkSession, path: str) -> TrainedModel:
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    return TrainedModel(model=load_stage(f"{path}/model", spark), **facts)


def run_table(spark: SparkSession, models: Sequence[TrainedModel], submodule: str, experiment: str) -> DataFrame:
    """One row per trained model."""
    rows = [(submodule, experiment, m.name, *[float(m.metrics[k]) for k in METRICS], m.threshold) for m in models]
    columns = ", ".join(f"{m} DOUBLE" for m in METRICS)
    return spark.createDataFrame(rows, f"submodule_id STRING, experiment STRING, model STRING, {columns}, decision_threshold DOUBLE")


def choose_models(runs: DataFrame) -> DataFrame:
    """Per submodule the run of highest precision, then F1; unusable F1 rejected."""
    from riskframe.frames import top_per_key

    usable = runs.where((F.col("f1") > 0) & (F.col("f1") < 1))
    return top_per_key(usable, ["submodule_id"], [F.desc("precision"), F.desc("f1"), F.col("model")])


def feature_importance(model: Model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """Absolute coefficient or impurity importance, four decimals, largest first."""
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    if hasattr(model, "coefficients"):
        values = [abs(float(v)) for v in model.coefficients.toArray()]
    elif hasattr(model, "featureImportances"):
        values = [float(v) for v in model.featureImportances.toArray()]
    else:
        total = sum(model.weights) or 1.0
        values = [0.0] * len(features)
        for stump, w in zip(model.stumps, model.weights):
            for i, v in enumerate(stump.featureImportances.toArray()):
                values[i] += float(v) * w / total
    rows = [(f, round(v, 4)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(F.desc("importance"), "feature")


def batch_score(trained: TrainedModel, df: DataFrame, key: str, run_time: str, experiment: str) -> DataFrame:
    """Score any rows: missing features are added as null (read as 0), run columns stamped."""
    from riskframe.sources.files import with_run_columns

    full = df.select("*", *[F.lit(None).cast("double").alias(f) for f in trained.features if f not in df.columns])
    scored = score(trained.model, assemble(full, trained.features), trained.threshold).drop("features")
    return with_run_columns(scored, run_time, trained.name, experiment)


def risk_score(prediction, probability):
    """Probability in percent where a concern is predicted, else 0."""
    return F.when(prediction == 1, probability * 100).otherwise(0.0)


def leakage_ablation(df: DataFrame, key: str, target: str, features: Sequence[str], estimator: Estimator | None = None) -> DataFrame:
    """Train and test F1 without each feature in turn ('' keeps all)."""
    estimator = estimator or RandomForestClassifier(labelCol="label", featuresCol="features", seed=SEED)
    split = durable(stratified_split(df.select(key, F.col(target).cast("double").alias("label"), *[F.col(f"`{f}`") for f in features]), key, "label"))
    rows = []
    for gone in ["", *features]:
        kept = [f for f in features if f != gone]
        data = assemble(split, kept).select("label", "is_test", "features")
        model = estimator.fit(data.where(~F.col("is_test")))
        both = metrics(score(model, data).select("label", "is_test", "ML_Prediction"), "label", "ML_Prediction", ["is_test"]).collect()
        f1 = {r["is_test"]: r["f1"] for r in both}
        rows.append((gone, float(f1[False]), float(f1[True])))
    return df.sparkSession.createDataFrame(rows, "removed STRING, train_f1 DOUBLE, test_f1 DOUBLE")


def forward_selection(df: DataFrame, key: str, target: str, features: Sequence[str], want: int, estimator: Estimator | None = None) -> DataFrame:
    """Greedy forward selection by test F1 (ties: earlier feature)."""
    estimator = estimator or DecisionTreeClassifier(labelCol="label", featuresCol="features", seed=SEED)
    split = durable(stratified_split(df.select(key, F.col(target).cast("double").alias("label"), *[F.col(f"`{f}`") for f in features]), key, "label"))
    chosen: list[str] = []
    rows = []
    while len(chosen) < min(want, len(features)):
        tried = []
        for f in [f for f in features if f not in chosen]:
            data = assemble(split, [*chosen, f]).select("label", "is_test", "features")
            model = estimator.fit(data.where(~F.col("is_test")))
            f1 = metrics(score(model, data.where("is_test")), "label", "ML_Prediction").first()["f1"]
            tried.append((f1, -features.index(f), f))
        f1, _, f = max(tried)
        chosen.append(f)
        rows.append((len(chosen), f, float(f1)))
    return df.sparkSession.createDataFrame(rows, "step INT, feature STRING, f1 DOUBLE")


def individual_dependence(model: Model, df: DataFrame, key: str, features: Sequence[str], feature: str, grid: Sequence[float]) -> DataFrame:
    """Predicted probability of each row with one feature set to each grid value (ICE).

    The grid is short and given; rows times grid is its result.
    """
    column = F.explode(F.array(*[F.lit(float(g)) for g in grid]))
    varied = df.withColumn("_at", column).withColumn(feature, F.col("_at"))
    scored = score(model, assemble(varied, features))
    return scored.select(key, F.col("_at").alias("value"), F.col("ML_Prediction_Probability").alias("probability"))
