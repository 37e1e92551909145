"""Dates, quality flags, JSON and identifier checks, type sniffing."""

from pyspark.sql import functions as F

from riskframe.functions import values
from riskframe.operators import reports
from riskframe.plans.catalogue import register


@register(
    "parse_dates",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderdate END AS parsed FROM orders",
)
def parse_dates(t):
    """Order dates written in three layouts and one that is no date."""
    d = F.col("o_orderdate")
    mixed = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "dd MMM yyyy"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.concat(F.lit("on "), F.date_format(d, "MM.yyyy")))
    )
    return t.orders.select("o_orderkey", values.parse_date(mixed).cast("timestamp_ntz").alias("parsed"))


@register(
    "date_parts",
    "SELECT o_orderkey, quarter(o_orderdate)::BIGINT AS qtr, monthname(o_orderdate) AS month, dayname(o_orderdate) AS wkday, "
    "day(o_orderdate)::BIGINT AS day FROM orders",
)
def date_parts(t):
    return t.orders.select(
        "o_orderkey", values.quarter("o_orderdate").cast("long").alias("qtr"), values.month_name("o_orderdate").alias("month"),
        values.weekday_name("o_orderdate").alias("wkday"), values.day_of_month("o_orderdate").cast("long").alias("day"),
    )


def _mixed(t):
    """Event values as texts of every kind."""
    v = (
        F.when(F.col("event_id") % 6 == 0, F.when(F.col("user_id") % 2 == 0, "TRUE").otherwise("false"))
        .when(F.col("event_id") % 6 == 1, F.floor("value").cast("string"))
        .when(F.col("event_id") % 6 == 2, F.col("value").cast("decimal(18,2)").cast("string"))
        .when(F.col("event_id") % 6 == 3, F.date_format("ts", "yyyy-MM-dd"))
        .when(F.col("event_id") % 6 == 4, F.col("event_type"))
    )
    return t.events.select("event_id", v.alias("v"))


@register(
    "parsed_values",
    """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'boolean' WHEN 1 THEN 'integer' WHEN 2 THEN 'float' WHEN 3 THEN 'date' WHEN 4 THEN 'text' END AS kind,
      CASE WHEN event_id % 6 = 0 THEN user_id % 2 = 0 END AS boolean,
      CASE event_id % 6 WHEN 1 THEN floor(value) WHEN 2 THEN round(value, 2) END AS number,
      CASE WHEN event_id % 6 = 3 THEN date_trunc('day', ts)::TIMESTAMP END AS date FROM events
    """,
)
def parsed_values(t):
    parsed = _mixed(t).select("event_id", values.parsed_value("v").alias("p")).select("event_id", "p.*")
    return parsed.withColumn("date", F.col("date").cast("timestamp_ntz"))


@register(
    "quality_flags",
    """
    SELECT event_id, (event_id % 6 <> 3)::BIGINT AS invalid_date,
      CASE WHEN event_id % 6 IN (1, 2) AND (CASE WHEN event_id % 6 = 1 THEN floor(value) ELSE value END) > 0 THEN 0 ELSE 1 END::BIGINT AS zero_or_negative,
      (event_id % 6 = 5)::BIGINT AS missing,
      CASE event_id % 6 WHEN 5 THEN 0 WHEN 0 THEN (user_id % 2 = 0)::INT WHEN 1 THEN (floor(value) > 0)::INT WHEN 2 THEN (value > 0)::INT ELSE 1 END::BIGINT AS has_value,
      CASE event_id % 6 WHEN 0 THEN (user_id % 2 = 0)::INT WHEN 1 THEN (floor(value) = 1)::INT WHEN 2 THEN (value = 1)::INT ELSE 0 END::BIGINT AS is_true,
      CASE event_id % 6 WHEN 0 THEN (user_id % 2 = 1)::INT WHEN 1 THEN (floor(value) = 0)::INT WHEN 2 THEN (value = 0)::INT ELSE 0 END::BIGINT AS is_false
    FROM events
    """,
)
def quality_flags(t):
    kinds = ["invalid_date", "zero_or_negative", "missing", "has_value", "is_true", "is_false"]
    return _mixed(t).select("event_id", *[values.flag(k, "v").cast("long").alias(k) for k in kinds])


@register(
    "business_quality_flags",
    """
    SELECT 0::BIGINT AS "CreditDebit_", (o_orderstatus <> 'F')::BIGINT AS "CreditDebit", 0::BIGINT AS "ValidPaymentTerms", 0::BIGINT AS "ValidPaymentDate",
      (o_totalprice > 300000)::BIGINT AS "OutlierPayment", 1::BIGINT AS "TestsFailedCount" FROM orders
    """.replace('0::BIGINT AS "CreditDebit_", ', ""),
)
def business_quality_flags(t):
    wide = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "H-Credit").otherwise("S-Debit").alias("InvoiceDebitOrCreditIndicator"),
        F.col("o_orderpriority").alias("PaymentTerms"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("PaymentDate"),
        (F.col("o_totalprice") > 300000).cast("string").alias("FMP2P040"), F.col("o_totalprice").alias("TestsFailedCount"),
    )
    out = values.quality_flags(wide)
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@register(
    "truthy_to_number",
    "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 = 0 AND user_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS flag FROM events",
)
def truthy_to_number(t):
    return _mixed(t).select("event_id", values.as_zero_one("v").cast("long").alias("flag"))


@register(
    "fill_missing",
    "SELECT d.doc_id, coalesce(quality, -1)::BIGINT AS quality, coalesce(toxic, 0)::BIGINT AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def fill_missing(t):
    wide = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    wide = wide.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))
    return values.fill_missing(wide, {"quality": -1, "toxic": 0})


@register(
    "json_validity",
    "SELECT 'event_type' AS column_name, count(*) AS rows, 0::BIGINT AS valid, 0.0::DOUBLE AS share FROM events "
    "UNION ALL SELECT 'props', count(*), count_if(json_valid(props)), count_if(json_valid(props)) / count(*) FROM events "
    "UNION ALL SELECT 'broken', count(*), count_if(event_id % 3 <> 0), round(count_if(event_id % 3 <> 0) / count(*), 6) FROM events",
)
def json_validity(t):
    rows = t.events.select(
        "props", "event_type", F.when(F.col("event_id") % 3 == 0, F.expr("left(props, 5)")).otherwise(F.col("props")).alias("broken")
    )
    out = values.json_validity(rows, ["props", "event_type", "broken"])
    return out.select("column_name", "rows", "valid", F.round("share", 6).alias("share"))


@register(
    "json_single_quotes",
    """SELECT doc_id, md5(replace(text, '"', '''')) AS hash FROM documents""",
)
def json_single_quotes(t):
    document = t.documents.select("doc_id", F.struct("source", F.struct("text").alias("body")).alias("doc"))
    kind = document.schema["doc"].dataType
    clean = document.select("doc_id", values.single_quoted(F.col("doc"), kind).alias("doc"))
    return clean.select("doc_id", F.md5("doc.body.text").alias("hash"))


@register(
    "malformed_identifiers",
    "SELECT event_id, event_id::VARCHAR AS id FROM events WHERE event_id % 5 = 0",
)
def malformed_identifiers(t):
    h = F.md5(F.col("event_id").cast("string"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    ids = t.events.select("event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_id").cast("string")).otherwise(uuid).alias("id"))
    return values.malformed_identifiers(ids, "id")


@register(
    "sniffed_types",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CASE WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'BOOLEAN' WHEN count(try_cast(v AS DOUBLE)) = count(v) THEN 'NUMERIC' "
        f"WHEN count(try_cast(v AS TIMESTAMP)) = count(v) THEN 'DATETIME' ELSE 'STRING' END AS kind FROM (SELECT ({x})::VARCHAR AS v FROM events)"
        for c, x in {"event_id": "event_id", "ts": "ts", "event_type": "event_type", "value": "value", "flag": "user_id > 10"}.items()
    ),
)
def sniffed_types(t):
    return values.sniff_types(_texts(t))


def _texts(t):
    return t.events.select(
        F.col("event_id").cast("string").alias("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type",
        F.col("value").cast("string").alias("value"), (F.col("user_id") > 10).cast("string").alias("flag"),
    )


@register(
    "inferred_types",
    "SELECT event_id::DOUBLE AS event_id, date_trunc('second', ts)::TIMESTAMP AS ts, event_type, value, user_id > 10 AS flag FROM events",
)
def inferred_types(t):
    out = values.infer_types(_texts(t))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register(
    "narrowed_types",
    "SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey::BIGINT AS l_suppkey FROM lineitem",
)
def narrowed_types(t):
    return values.narrow_types(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"))


@register(
    "pattern_lookup",
    "SELECT l.l_orderkey, l.l_linenumber::BIGINT AS l_linenumber, l.l_partkey AS pattern_id, p_name AS feature, p_type AS description "
    "FROM lineitem l LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON p_partkey = l_partkey",
)
def pattern_lookup(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_partkey").alias("pattern_id"))
    mapping = t.part.where("p_size > 10").withColumnRenamed("p_partkey", "pattern_id")
    return reports.named_lookup(rows, mapping, "pattern_id", {"feature": "p_name", "description": "p_type"})
