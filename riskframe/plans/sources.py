"""Scans, samples and record output over the standard tables."""

from pyspark.sql import functions as F

from riskframe.plans.catalogue import TABLES, register
from riskframe.sources import files, tables


@register(
    "scan_table",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey, l_extendedprice FROM lineitem",
)
def scan_table(t):
    return t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey", "l_extendedprice"
    )


@register(
    "scan_query",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000",
)
def scan_query(t):
    return t.spark.sql(
        "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice > 300000",
        orders=t.orders,
    )


@register("demo_sample", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 1000")
def demo_sample(t):
    return tables.demo_sample(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")


@register(
    "monitoring_history",
    "SELECT event_id AS task_id, event_type AS instance_id, (user_id % 3)::VARCHAR AS submodule, value "
    "FROM events WHERE event_type = 'click' AND user_id % 3 = 1",
)
def monitoring_history(t):
    log = t.events.select(
        F.col("event_id").alias("task_id"),
        F.col("event_type").alias("instance_id"),
        (F.col("user_id") % 3).cast("string").alias("submodule"),
        "value",
    )
    return files.monitoring_history(log, "click", "1")


@register(
    "word_counts_over_100",
    "SELECT word, count(*) AS count FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) "
    "GROUP BY word HAVING count(*) > 100",
)
def word_counts_over_100(t):
    words = t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 100)


@register(
    "json_items",
    """
    SELECT doc_id, source, u.line_no, length(u.line)::BIGINT AS line_chars FROM (
      SELECT doc_id, source, unnest(list_transform(string_split(text, chr(10)),
             lambda x, i: {'line_no': i::BIGINT, 'line': x})) AS u FROM documents)
    """,
)
def json_items(t):
    """Documents written as nested JSON, parsed back and flattened to one row per line."""
    lines = F.transform(
        F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"))
    )
    nested = t.documents.select(F.to_json(F.struct("doc_id", "source", lines.alias("items"))).alias("json"))
    schema = "doc_id BIGINT, source STRING, items ARRAY<STRUCT<line_no: BIGINT, line: STRING>>"
    parsed = nested.select(files.parse_json("json", schema).alias("d")).select("d.*")
    flat = files.flatten_items(parsed, "items", ["doc_id", "source"])
    return flat.select("doc_id", "source", "line_no", F.length("line").cast("long").alias("line_chars"))


@register(
    "json_properties",
    "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
)
def json_properties(t):
    return t.events.select("event_id", files.parse_json("props", "k BIGINT")["k"].alias("k"))


@register(
    "json_records",
    "SELECT to_json({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus})::VARCHAR AS record FROM orders",
)
def json_records(t):
    return files.json_records(t.orders.select("o_orderkey", "o_orderstatus"))


@register(
    "report_columns",
    "SELECT 'acme' AS \"Client\", 'p2p' AS \"Project\", '7' AS \"Instance\", o_orderpriority, count(*) AS orders "
    "FROM orders GROUP BY o_orderpriority",
)
def report_columns(t):
    report = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))
    return files.with_report_columns(report, "acme", "p2p", "7")


@register(
    "scored_batch_columns",
    "SELECT event_id, value, TIMESTAMP '2024-01-01 00:00:00' AS \"Prediction_DateTime\", 'gbt' AS \"Model_Name\", "
    "'run1' AS \"Experiment_Name\" FROM events",
)
def scored_batch_columns(t):
    return files.with_run_columns(t.events.select("event_id", "value"), "2024-01-01 00:00:00", "gbt", "run1")


@register(
    "row_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES),
)
def row_counts(t):
    counts = [tables.row_count(getattr(t, n), n) for n in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register(
    "probability_sample",
    """
    WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    e AS (SELECT i, lo + (hi - lo) / 9 * i AS a, CASE WHEN i = 8 THEN hi ELSE lo + (hi - lo) / 9 * (i + 1) END AS z
          FROM b, range(9) AS r(i)),
    f AS (SELECT event_id, value, row_number() OVER (PARTITION BY i ORDER BY value, event_id) AS rn
          FROM events JOIN e ON value BETWEEN a AND z)
    SELECT DISTINCT event_id, round(value, 2) AS value FROM f WHERE rn = 1
    """,
)
def probability_sample(t):
    return files.probability_sample(t.events, "event_id", "value")
