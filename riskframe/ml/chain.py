"""One flow from raw transactions to risk scores: column roles, features, selection, the best classifier, scoring.

The fitted flow is a Spark ML model: train in one session, save, and score other rows in another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.ml.persist import SavedStage
from riskframe.ml.training import assemble, better, risk_score, score, train
from riskframe.prep.columns import assign_roles
from riskframe.prep.encode import FeatureBuilder
from riskframe.prep.select import FeatureSelection
from riskframe.session import durable


class RiskPipeline(SavedStage, Estimator):
    """Fits on rows with a key, a 0/1 target and raw columns, of which ``amounts`` are numeric.

    Other columns get their role from the data; what is neither a date nor a usable category is left out.  Of the
    algorithms the one of highest precision, then F1, is kept.
    """

    FACTS = ("key", "target", "amounts", "patterns", "algorithms", "repeats", "trials", "own_threshold")

    def __init__(
        self, key: str, target: str, amounts: Sequence[str], patterns: Sequence[str] = (), algorithms: Sequence[str] | None = None,
        repeats: int = 1, trials: int = 0, own_threshold: bool = False,
    ):
        super().__init__()
        self.key, self.target, self.amounts, self.patterns = key, target, list(amounts), list(patterns)
        self.algorithms, self.repeats, self.trials, self.own_threshold = algorithms, repeats, trials, own_threshold

    def _fit(self, dataset: DataFrame) -> RiskPipelineModel:
        roles = {r["column_name"]: r["role"] for r in assign_roles(dataset.drop(self.target), self.amounts, self.key).collect()}
        of = lambda role: sorted(c for c, r in roles.items() if r == role)
        used = [self.key, self.target, *of("numeric"), *of("datetime"), *of("categorical")]
        rows = durable(dataset.select(*[F.col(f"`{c}`") for c in used]))
        builder = FeatureBuilder(self.key, of("numeric"), of("datetime"), of("categorical"), self.target).fit(rows)
        built = durable(builder.transform(rows))
        selection = FeatureSelection(self.key, self.target, self.patterns).fit(built)
        models = train(
            selection.transform(built), self.key, self.target, selection.features, self.algorithms,
            repeats=self.repeats, trials=self.trials, own_threshold=self.own_threshold,
        )
        best = None
        for one in models:
            if better(one.metrics, best and best.metrics):
                best = one
        if best is None:
            raise ValueError("no algorithm gave a usable model: predictions were constant, or F1 was 0 or 1")
        return RiskPipelineModel(self.key, roles, builder, selection, best)


class RiskPipelineModel(SavedStage, Model):
    """Key, prediction, probability and risk score of every row; raw columns that are absent count as missing."""

    FACTS, PARTS = ("key", "roles", "name", "metrics", "threshold"), ("builder", "selection", "model")

    def __init__(self, key, roles, builder, selection, best):
        super().__init__()
        self.key, self.roles, self.builder, self.selection = key, roles, builder, selection
        self.name, self.model, self.threshold = best.name, best.model, best.threshold
        self.metrics = {k: float(v) for k, v in best.metrics.items()}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        absent = [c for c in self.builder.input_names if c not in dataset.columns]
        kinds = {"numeric": "double", "datetime": "timestamp", "categorical": "string"}
        full = dataset.select("*", *[F.lit(None).cast(kinds[self.roles[c]]).alias(c) for c in absent])
        full = full.select(*[F.col(f"`{c}`") for c in (self.key, *self.builder.input_names)])
        features = self.selection.transform(self.builder.transform(full))
        scored = score(self.model, assemble(features, self.selection.features), self.threshold)
        risk = F.round(risk_score(F.col("ML_Prediction"), F.col("ML_Prediction_Probability")), 4)
        return scored.select(self.key, "ML_Prediction", "ML_Prediction_Probability", risk.alias("ML_Risk_Score"))
