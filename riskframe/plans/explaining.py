"""Explanations, evidence and monitoring."""

from pyspark.sql import functions as F

from riskframe.ml import explain, monitor
from riskframe.plans.catalogue import register
from riskframe.plans.learning import FEATURES, _SCORES, fitted, scores

_COEF = {"l_quantity": 0.04, "l_discount": -3.0, "l_tax": 5.0}


@register(
    "linear_contributions",
    """
    WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x FROM lineitem),
    c AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice / 200000 AS p, 0.04 * (l_quantity - q) AS c1, -3.0 * (l_discount - d) AS c2, 5.0 * (l_tax - x) AS c3 FROM lineitem, m),
    u AS (SELECT *, 'l_quantity' AS feature, c1 AS c FROM c UNION ALL SELECT *, 'l_discount', c2 FROM c UNION ALL SELECT *, 'l_tax', c3 FROM c)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, feature, round(c * p * 100 / (abs(c1) + abs(c2) + abs(c3)), 2) AS contribution_percent
    FROM u WHERE round(c * p * 100 / (abs(c1) + abs(c2) + abs(c3)), 2) <> 0
    """,
)
def linear_contributions(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = t.lineitem.withColumn("p", F.col("l_extendedprice") / 200000).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return explain.linear_percent(rows, keys, _COEF, explain.column_means(t.lineitem, list(_COEF)), "p")


@register("sampled_contributions")
def sampled_contributions(t):
    rows, model = fitted(t)
    values = explain.sampled_contributions(model, rows, ["doc_id"], FEATURES, rows, permutations=8)
    return explain.to_percent(values, ["doc_id"], "probability")


@register(
    "positive_contributions",
    "SELECT event_id, value - 10 AS contribution_percent FROM events WHERE value - 10 > 0",
)
def positive_contributions(t):
    return explain.positive_contributions(t.events.select("event_id", (F.col("value") - 10).alias("contribution_percent")))


@register(
    "shown_values",
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN CASE WHEN user_id % 2 = 1 THEN 'True' ELSE 'False' END
      WHEN 1 THEN printf('%.2f%%', (user_id % 2) * 100.0) ELSE round(pow(user_id, 2), 2)::DOUBLE::VARCHAR END AS shown FROM events
    """,
)
def shown_values(t):
    kind = F.col("event_id") % 3
    feature = F.when(kind == 0, "type=click").when(kind == 1, "Anmly_Benford").otherwise("amount^2")
    rows = t.events.select("event_id", feature.alias("f"), (F.col("user_id") % 2).cast("double").alias("v"), F.col("user_id").cast("double").alias("amount"))
    return rows.select("event_id", explain.shown_value(F.col("f"), F.col("v"), F.col("amount"), ["type=click"]).alias("shown"))


@register(
    "failed_tests",
    """
    WITH h AS (SELECT o_orderkey, 'P1' AS "PatternID", CASE WHEN o_totalprice > 400000 THEN 2.0 ELSE 0 END AS score, o_orderpriority AS additional_info FROM orders
      UNION ALL SELECT o_orderkey, 'P2', CASE WHEN o_orderstatus = 'F' THEN 1.5 END, NULL FROM orders),
    w AS (SELECT 'P' || p_partkey AS "PatternID", p_name AS description, p_retailprice AS weight FROM part)
    SELECT o_orderkey, h."PatternID", score::DOUBLE AS score, additional_info, description, weight FROM h JOIN w ON w."PatternID" = h."PatternID" WHERE score > 0
    """,
)
def failed_tests(t):
    wide = t.orders.select(
        "o_orderkey", F.when(F.col("o_totalprice") > 400000, 2.0).otherwise(0.0).alias("P1_Tran_Score"),
        F.when(F.col("o_orderstatus") == "F", 1.5).alias("P2_Tran_Score"), F.col("o_orderpriority").alias("P1_Priority"),
    )
    patterns = t.part.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("PatternID"), F.col("p_name").alias("description"), F.col("p_retailprice").alias("weight")
    )
    return explain.failed_tests(wide, "o_orderkey", patterns)


@register(
    "model_drift",
    f"""
    WITH {_SCORES}, c AS (SELECT event_type, count_if(target = 1 AND prediction = 1) AS tp, count_if(target = 0 AND prediction = 1) AS fp, count_if(target = 1 AND prediction = 0) AS fn, count(*) AS n FROM s GROUP BY 1),
    f AS (SELECT *, 2 * tp / (2 * tp + fp + fn) * 100 AS f1 FROM c)
    SELECT event_type, 70.0 AS old_f1_score, round(f1, 2) AS new_f1_score, round((f1 - 70) / 70 * 100, 2) AS percentage_change, tp + fp AS concern_count, n - tp - fp AS no_concern_count,
      CASE WHEN (f1 - 70) / 70 * 100 < -5 THEN 'alert' WHEN (f1 - 70) / 70 * 100 > 5 THEN 'record' ELSE 'none' END AS decision FROM f
    """,
)
def model_drift(t):
    rows = scores(t)
    scored = rows.select("event_id", "event_type", "prediction")
    return monitor.drift(scored, rows.select("event_id", "target"), "event_id", "target", "prediction", 0.7, ["event_type"])


@register(
    "monitoring_upsert",
    """
    WITH l AS (SELECT user_id AS run, event_id, value, 0 AS fresh FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, value + 1, 1 FROM events WHERE event_type IN ('view', 'click'))
    SELECT run, event_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id DESC, fresh DESC) AS rn FROM l) WHERE rn = 1
    """,
)
def monitoring_upsert(t):
    rows = t.events.select(F.col("user_id").alias("run"), "event_id", "value", "event_type")
    log = rows.where("event_type = 'click'").drop("event_type")
    new = rows.where("event_type IN ('view', 'click')").drop("event_type").withColumn("value", F.col("value") + 1)
    return monitor.upsert(log, new, "run", "event_id").withColumn("value", F.round("value", 4))
