"""Splits, training, scoring, metrics and thresholds."""

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from riskframe.ml import metrics, split, training
from riskframe.operators import reports
from riskframe.plans.catalogue import register
from riskframe.plans.preparation import labelled
from riskframe.session import durable

_HASH = "(('0x' || substr(md5({k} || ':42'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@register(
    "stratified_split",
    f"""
    WITH l AS (SELECT doc_id, toxic, {_HASH.format(k='doc_id::VARCHAR')} AS h FROM labels),
    c AS (SELECT toxic, count(*) AS n, sum(count(*)) OVER () AS total FROM l GROUP BY toxic),
    i AS (SELECT toxic, ceil(total * 0.2) * n / total AS ideal, floor(ceil(total * 0.2) * n / total + 1e-9) AS f, ceil(total * 0.2) AS want FROM c),
    w AS (SELECT toxic, f + (row_number() OVER (ORDER BY ideal - f DESC, toxic) <= want - sum(f) OVER ())::INT AS want FROM i)
    SELECT l.doc_id, l.toxic::BIGINT AS toxic, row_number() OVER (PARTITION BY l.toxic ORDER BY h, doc_id) <= w.want AS is_test FROM l JOIN w ON w.toxic = l.toxic
    """,
)
def stratified_split(t):
    rows = t.labels.select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    return split.stratified_split(rows, "doc_id", "toxic")


def vectors(t, minority=0.03):
    """Embeddings with a rare class: the whole embedding as a vector."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rare = ((F.col("label") == 0) & (split.hash_unit("vec_id", F.lit("rare")) < minority * 10)).cast("int")
    return t.embeddings.select("vec_id", rare.alias("target"), e.alias("v"))


def _unit(*parts):
    """The share of 1 that ``hash_unit`` gives, in SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_VECTORS = f"""
    e AS (SELECT vec_id, CASE WHEN label = 0 AND {_unit('vec_id', "'rare'")} < 0.3 THEN 1 ELSE 0 END AS target,
          list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"""


def _near(asking, answering, k):
    """The ``k`` nearest of every row, by comparing it with all."""
    return f"""
    SELECT a.vec_id, b.vec_id AS neighbour, b.target, b.v, d, row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS place
    FROM {asking} a JOIN {answering} b ON a.vec_id <> b.vec_id, LATERAL (SELECT list_distance(a.v, b.v) AS d) QUALIFY place <= {k}"""


@register(
    "minority_oversampling",
    f"""
    WITH {_VECTORS},
    c AS (SELECT sum(target) AS have, count(*) - sum(target) AS majority FROM e),
    w AS (SELECT have, ceil(round(0.05 * majority * 1e6) / 1e6)::BIGINT - have AS needed FROM c WHERE have <= 0.05 * (have + majority)),
    m AS (SELECT * FROM e WHERE target = 1),
    s AS (SELECT m.*, needed // have + (row_number() OVER (ORDER BY {_unit('vec_id', "'extra42'")}, vec_id) <= needed % have)::INT AS copies FROM m, w WHERE needed > 0),
    i AS (SELECT vec_id, v, unnest(range(1, copies::BIGINT + 1)) AS i FROM s),
    n AS ({_near('m', 'm', 'least(5, (SELECT have - 1 FROM c))')}),
    k AS (SELECT vec_id, count(*) AS near FROM n GROUP BY vec_id),
    made AS (
        SELECT 'synthetic:' || i.vec_id || ':' || i AS vec_id, i.v AS a, n.v AS b, {_unit('i.vec_id', 'i', "'gap42'")} AS gap
        FROM i JOIN k ON k.vec_id = i.vec_id JOIN n ON n.vec_id = i.vec_id AND n.place = 1 + floor({_unit('i.vec_id', 'i', "'pick42'")} * near)
    )
    SELECT vec_id::VARCHAR AS vec_id, target, false AS synthetic, unnest(range(64)) AS place, round(unnest(v), 6) AS number FROM e
    UNION ALL
    SELECT vec_id, 1, true, unnest(range(64)), round(unnest(list_transform(list_zip(a, b), lambda p: p[1] + (p[2] - p[1]) * gap)), 6) FROM made
    """,
)
def minority_oversampling(t):
    """One row for each number of every vector, made ones too."""
    out = split.oversample(vectors(t), "vec_id", "target", "v")
    out = out.select("vec_id", "target", "synthetic", F.posexplode("v").alias("place", "number"))
    return out.withColumns({"place": F.col("place").cast("long"), "number": F.round("number", 6)})


@register(
    "neighbour_clean_up",
    f"""
    WITH {_VECTORS},
    n AS ({_near('e', 'e', 3)}),
    j AS (SELECT vec_id, min(target) AS lo, max(target) AS hi FROM n GROUP BY vec_id)
    SELECT e.vec_id, e.target FROM e LEFT JOIN j ON j.vec_id = e.vec_id WHERE lo IS NULL OR (lo = e.target AND hi = e.target)
    """,
)
def neighbour_clean_up(t):
    """Rows that stay; their vectors are unchanged."""
    return split.clean_by_neighbours(vectors(t), "vec_id", "target", "v").select("vec_id", "target")


def training_rows(t):
    rows = labelled(t).join(
        t.documents.select(
            "doc_id", F.length(F.regexp_replace("text", "[^A-Z]", "")).alias("capitals"), F.size(F.split("text", "\n")).alias("lines")
        ),
        "doc_id",
    )
    # A target the features can learn: quality, which depends on length and lines.
    return rows.select(
        "doc_id", F.col("quality").alias("target"), F.col("n_chars").cast("double").alias("n_chars"), "capitals", "lines",
        (F.col("lang") == "en").cast("int").alias("english"),
    )


FEATURES = ["n_chars", "capitals", "lines", "english"]


@register("trained_classifiers")
def trained_classifiers(t):
    """Run table of every algorithm."""
    models = training.train(training_rows(t), "doc_id", "target", FEATURES)
    return training.run_table(t.spark, models, "documents", "run1")


@register("tuned_classifier")
def tuned_classifier(t):
    models = training.train(training_rows(t), "doc_id", "target", FEATURES, ["Decision Tree"], trials=3, folds=2)
    return training.run_table(t.spark, models, "documents", "tuned")


def fitted(t):
    rows = durable(training_rows(t))
    data = training.assemble(rows.withColumn("label", F.col("target").cast("double")), FEATURES)
    return rows, LogisticRegression(maxIter=20).fit(data)


@register("feature_importance")
def feature_importance(t):
    _, model = fitted(t)
    return training.feature_importance(model, FEATURES, t.spark)


@register("batch_scoring")
def batch_scoring(t):
    rows, model = fitted(t)
    trained = training.TrainedModel("Logistic Regression", model, {}, FEATURES)
    out = training.batch_score(trained, rows.drop("target", "english"), "doc_id", "2024-01-01 00:00:00", "run1")
    return out.withColumn("ML_Risk_Score", F.round(training.risk_score(F.col("ML_Prediction"), F.col("ML_Prediction_Probability")), 4))


@register("leakage_ablation")
def leakage_ablation(t):
    return training.leakage_ablation(
        training_rows(t), "doc_id", "target", FEATURES, LogisticRegression(labelCol="label", featuresCol="features", maxIter=10)
    )


@register("forward_selection")
def forward_selection(t):
    return training.forward_selection(
        training_rows(t), "doc_id", "target", FEATURES, 2, LogisticRegression(labelCol="label", featuresCol="features", maxIter=10)
    )


@register("individual_dependence")
def individual_dependence(t):
    rows, model = fitted(t)
    out = training.individual_dependence(model, rows, "doc_id", FEATURES, "lines", [1, 5, 10, 20])
    return out.withColumn("probability", F.round("probability", 6))


def scores(t):
    """Events as scored rows: value as probability, an error type as the target."""
    return t.events.select(
        "event_id", "event_type", (F.col("value") / (F.col("value") + 20)).alias("score"),
        ((F.col("value") > 15) & (F.col("user_id") % 3 != 0)).cast("int").alias("target"),
    ).withColumn("prediction", (F.col("score") >= 0.5).cast("int"))


_SCORES = "s AS (SELECT event_id, event_type, value / (value + 20) AS score, (value > 15 AND user_id % 3 <> 0)::INT AS target, (value / (value + 20) >= 0.5)::INT AS prediction FROM events)"
_CELLS = "c AS (SELECT {g} count_if(target = 1 AND p) AS tp, count_if(target = 0 AND p) AS fp, count_if(target = 1 AND NOT p) AS fn, count_if(target = 0 AND NOT p) AS tn FROM {f} {by})"


@register(
    "classifier_metrics",
    f"WITH {_SCORES}, x AS (SELECT *, prediction = 1 AS p FROM s), " + _CELLS.format(g="event_type,", f="x", by="GROUP BY event_type")
    + " SELECT event_type, round((tp + tn) / (tp + tn + fp + fn), 3) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 3) AS balanced_accuracy, "
    "round((tp / (tp + fn) + tn / (tn + fp)) / 2, 3) AS roc_auc, round(2 * tp / (2 * tp + fp + fn), 3) AS f1, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall FROM c",
)
def classifier_metrics(t):
    return metrics.metrics(scores(t), "target", "prediction", ["event_type"])


@register(
    "confusion_shares",
    f"WITH {_SCORES} SELECT target::BIGINT AS actual, prediction::BIGINT AS predicted, round(count(*) / (SELECT count(*) FROM s), 6) AS share FROM s GROUP BY ALL",
)
def confusion_shares(t):
    out = metrics.confusion_shares(scores(t), "target", "prediction")
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("actual", "predicted")], F.round("share", 6).alias("share"))


@register(
    "classification_report",
    f"WITH {_SCORES}, k AS (SELECT 0 AS class UNION ALL SELECT 1), r AS (SELECT class, count_if(target = class AND prediction = class) AS tp, "
    "count_if(target = class) AS support, count_if(prediction = class) AS predicted FROM s, k GROUP BY class) "
    "SELECT class::BIGINT AS class, round(tp / predicted, 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (predicted + support), 6) AS f1, support FROM r",
)
def classification_report(t):
    out = metrics.classification_report(scores(t), "target", "prediction")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@register(
    "curve_points",
    f"WITH {_SCORES}, g AS (SELECT score, sum(target) AS p, count(*) - sum(target) AS n FROM s GROUP BY score), "
    "r AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g) "
    "SELECT round(score, 9) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr, round(tp / (tp + fp), 6) AS precision FROM r",
)
def curve_points(t):
    out = metrics.curve_points(scores(t), "target", "score")
    out = out.withColumns({"threshold": F.round("threshold", 9), **{c: F.round(c, 6) for c in ("fpr", "tpr", "precision")}})
    return out.select("threshold", "tp", "fp", "fpr", "tpr", "precision")


@register(
    "roc_auc",
    f"WITH {_SCORES}, g AS (SELECT score, sum(target) AS p, count(*) - sum(target) AS n FROM s GROUP BY score), "
    "r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp FROM g) SELECT round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6) AS auc FROM r",
)
def roc_auc(t):
    return metrics.roc_auc(scores(t), "target", "score").withColumn("auc", F.round("auc", 6))


_SWEEP = f"""
    {_SCORES}, h AS (SELECT round(0.2 + i * 0.01, 10) AS threshold FROM range(60) AS r(i)),
    x AS (SELECT threshold, target, score >= threshold AS p FROM s, h), {_CELLS.format(g='threshold,', f='x', by='GROUP BY threshold')},
    m AS (SELECT threshold, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, fp / (fp + tn) AS fpr, fn / (fn + tp) AS fnr, tn / (tn + fp) AS tnr FROM c)
"""


@register(
    "threshold_sweep",
    f"WITH {_SWEEP} SELECT threshold::DOUBLE AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr, "
    "round(fnr, 6) AS fnr, round(recall, 6) AS tpr, round(tnr, 6) AS tnr, round(recall + 0.8 * f1 + 0.6 * precision, 6) AS score FROM m",
)
def threshold_sweep(t):
    out = metrics.threshold_sweep(scores(t), "target", "score")
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in out.columns if c != "threshold"])


@register(
    "best_threshold",
    f"WITH {_SWEEP} SELECT threshold::DOUBLE AS threshold, round(recall + 0.8 * f1 + 0.6 * precision, 6) AS score FROM m ORDER BY round(recall + 0.8 * f1 + 0.6 * precision, 12) DESC, threshold DESC LIMIT 1",
)
def best_threshold(t):
    return metrics.best_threshold(metrics.threshold_sweep(scores(t), "target", "score")).withColumn("score", F.round("score", 6))


@register(
    "threshold_by_precision",
    f"WITH {_SCORES}, f AS (SELECT floor({_HASH.format(k='event_id::VARCHAR')} * 5)::BIGINT AS fold, score, target FROM s), "
    "g AS (SELECT fold, score, sum(target) AS p, count(*) - sum(target) AS n FROM f GROUP BY ALL), "
    "r AS (SELECT fold, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY tp / (tp + fp) DESC, tp DESC, score) AS rn FROM r WHERE tp > 0) "
    "SELECT fold, round(score, 9) AS threshold, round(tp / (tp + fp), 6) AS precision FROM k WHERE rn = 1",
)
def threshold_by_precision(t):
    out = metrics.threshold_by_precision(scores(t), "event_id", "target", "score")
    return out.select(F.col("fold").cast("long").alias("fold"), F.round("threshold", 9).alias("threshold"), F.round("precision", 6).alias("precision"))


@register(
    "decision_threshold",
    f"WITH {_SCORES}, f AS (SELECT floor({_HASH.format(k='event_id::VARCHAR')} * 5)::BIGINT AS fold, score, target FROM s), "
    "g AS (SELECT fold, score, sum(target) AS p, count(*) - sum(target) AS n FROM f GROUP BY ALL), "
    "r AS (SELECT fold, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY tp / (tp + fp) DESC, tp DESC, score) AS rn FROM r WHERE tp > 0) "
    "SELECT round(avg(score), 3) AS threshold FROM k WHERE rn = 1",
)
def decision_threshold(t):
    return metrics.decision_threshold(scores(t), "event_id", "target", "score")


def runs(t):
    """A run table derived from customers: one run per customer, submodule by nation."""
    share = lambda m: F.round((F.col("c_custkey") * m % 997) / 1000, 3)
    return t.customer.select(
        F.col("c_nationkey").cast("string").alias("submodule_id"), F.col("c_mktsegment").alias("experiment"), F.col("c_name").alias("model"),
        share(7).alias("f1"), share(13).alias("precision"), share(29).alias("recall"), share(31).alias("accuracy"), share(37).alias("balanced_accuracy"),
    )


_RUNS = "r AS (SELECT c_nationkey::VARCHAR AS submodule_id, c_mktsegment AS experiment, c_name AS model, " + ", ".join(
    f"round((c_custkey * {m} % 997) / 1000, 3) AS {n}" for n, m in (("f1", 7), ("precision", 13), ("recall", 29), ("accuracy", 31), ("balanced_accuracy", 37))
) + " FROM customer)"


@register(
    "model_choice",
    f"WITH {_RUNS} SELECT submodule_id, model, precision, f1 FROM (SELECT *, row_number() OVER (PARTITION BY submodule_id ORDER BY precision DESC, f1 DESC, model) AS rn FROM r WHERE f1 > 0 AND f1 < 1) WHERE rn = 1",
)
def model_choice(t):
    return training.choose_models(runs(t)).select("submodule_id", "model", "precision", "f1")


@register(
    "leaderboard",
    f"WITH {_RUNS} SELECT r_name AS module, n_name AS submodule, experiment, model, round(f1 * 100, 2) AS f1, round(precision * 100, 2) AS precision, "
    "round(recall * 100, 2) AS recall, round(accuracy * 100, 2) AS accuracy, round(balanced_accuracy * 100, 2) AS balanced_accuracy "
    "FROM r JOIN nation ON n_nationkey::VARCHAR = submodule_id JOIN region ON r_regionkey = n_regionkey",
)
def leaderboard(t):
    modules = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("string").alias("submodule_id"), F.col("r_name").alias("module"), F.col("n_name").alias("submodule")
    )
    return reports.leaderboard(runs(t), modules)


@register("risk_scores", f"WITH {_SCORES} SELECT event_id, CASE WHEN prediction = 1 THEN round(score * 100, 6) ELSE 0 END AS risk FROM s")
def risk_scores(t):
    return scores(t).select("event_id", F.round(training.risk_score(F.col("prediction"), F.col("score")), 6).alias("risk"))
