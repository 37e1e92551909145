"""Aggregation, grouped transforms, reductions and reports."""

from pyspark.sql import functions as F

from riskframe.operators import alerts, reduce, reports
from riskframe.plans.anomalies import INVOICE_PARTS, INVOICE_SQL, indicator, invoice_lines
from riskframe.plans.catalogue import register
from riskframe.plans.joins import ANSWERS_SQL, _answers

_LINE = "l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey"


def lines(t, *columns):
    return t.lineitem.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", *columns
    )


def rounded(df, places=4, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


for _name in ("sum", "mean", "min", "max", "count"):
    _sql = {"mean": "avg"}.get(_name, _name)

    def _transform(t, name=_name):
        out = reduce.grouped_transform(
            lines(t, "l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity", "group_value", name
        )
        out = out.withColumn("group_value", F.round(F.col("group_value").cast("double"), 6))
        return out.drop("l_quantity", "l_suppkey")

    register(
        f"grouped_transform_{_name}",
        f"SELECT {_LINE}, round(({_sql}(l_quantity) OVER (PARTITION BY l_suppkey))::DOUBLE, 6) AS group_value FROM lineitem",
    )(_transform)


@register(
    "po_total_on_every_line",
    f"SELECT {_LINE}, round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 2) AS po_total FROM lineitem",
)
def po_total_on_every_line(t):
    out = reduce.grouped_transform(lines(t, "l_extendedprice"), ["l_orderkey"], "l_extendedprice", "po_total", "sum")
    return rounded(out.drop("l_extendedprice"), 2, "po_total")


@register(
    "grouped_user_function",
    f"SELECT {_LINE}, l_suppkey, l_extendedprice, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS price_rank FROM lineitem",
)
def grouped_user_function(t):
    """Any pandas function per bounded group: rank of each line's price at its supplier."""

    def rank(pdf):
        return pdf.assign(price_rank=pdf["l_extendedprice"].rank(method="min").astype("int64"))

    schema = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, price_rank long"
    return reduce.grouped_apply(lines(t, "l_suppkey", "l_extendedprice"), ["l_suppkey"], rank, schema)


@register(
    "invoice_reduction",
    f"""WITH {INVOICE_SQL} SELECT vendor_level, invoice_level, line, part, round(net_amount, 2) AS net_amount,
      round(total, 2) AS "Total_AmountExcl_RC" FROM tot""",
)
def invoice_reduction(t):
    out = reduce.entity_totals(
        invoice_lines(t), "VendorNumber", INVOICE_PARTS, "AmountExcl_RC", "invoice_level", "DebitCreditIndicator"
    )
    out = out.select("vendor_level", "invoice_level", "line", "part", "net_amount", "Total_AmountExcl_RC")
    return rounded(out, 2, "net_amount", "Total_AmountExcl_RC")


@register(
    "invoice_reduction_deduplicated",
    f"""WITH {INVOICE_SQL} SELECT vendor_level, invoice_level, line, part, round(total, 2) AS "Total_AmountExcl_RC"
      FROM tot WHERE rn = 1""",
)
def invoice_reduction_deduplicated(t):
    out = reduce.entity_first_lines(
        invoice_lines(t), "VendorNumber", INVOICE_PARTS, "AmountExcl_RC", "invoice_level", ["line", "part"],
        "DebitCreditIndicator",
    )
    return rounded(
        out.select("vendor_level", "invoice_level", "line", "part", "Total_AmountExcl_RC"), 2, "Total_AmountExcl_RC"
    )


_PAYMENT_SQL = """
    pay AS (SELECT l_suppkey::VARCHAR AS vendor_level, md5(concat_ws(chr(1), l_returnflag, year(l_shipdate)::VARCHAR, l_partkey::VARCHAR)) AS payment_level,
      l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_extendedprice AS "AmountExcl_RC",
      CASE WHEN l_linestatus = 'F' THEN -abs(l_extendedprice) ELSE l_extendedprice END AS net FROM lineitem)
"""


def _payments(t):
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("VendorNumber"), F.col("l_returnflag").alias("CompanyCode"),
        F.year("l_shipdate").alias("FiscalYear"), F.col("l_partkey").alias("SystemPaymentNo"), "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_extendedprice").alias("AmountExcl_RC"),
        indicator().alias("DebitCreditIndicator"),
    )
    return rows, ["CompanyCode", "FiscalYear", "SystemPaymentNo"]


@register(
    "payment_reduction",
    f"""WITH {_PAYMENT_SQL} SELECT vendor_level, payment_level, l_orderkey, l_linenumber, "AmountExcl_RC",
      round(abs(sum(net) OVER (PARTITION BY vendor_level, payment_level)), 2) AS "Total_AmountExcl_RC" FROM pay""",
)
def payment_reduction(t):
    rows, parts = _payments(t)
    out = reduce.entity_totals(rows, "VendorNumber", parts, "AmountExcl_RC", "payment_level", "DebitCreditIndicator")
    out = out.select("vendor_level", "payment_level", "l_orderkey", "l_linenumber", "AmountExcl_RC", "Total_AmountExcl_RC")
    return rounded(out, 2, "Total_AmountExcl_RC")


_PO_SQL = """
    po AS (SELECT l_suppkey::VARCHAR AS vendor_level, md5(concat_ws(chr(1), l_returnflag, l_orderkey::VARCHAR)) AS po_level,
      l_linenumber::BIGINT AS l_linenumber, l_partkey, sum(l_extendedprice) OVER (PARTITION BY l_suppkey, l_returnflag, l_orderkey) AS total,
      row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem)
"""


@register(
    "po_reduction",
    f'WITH {_PO_SQL} SELECT vendor_level, po_level, l_linenumber, l_partkey, round(total, 2) AS "Total_l_extendedprice" FROM po WHERE rn = 1',
)
def po_reduction(t):
    out = reduce.entity_first_lines(
        lines(t, "l_suppkey", "l_returnflag", "l_extendedprice"), "l_suppkey", ["l_returnflag", "l_orderkey"],
        "l_extendedprice", "po_level", ["l_linenumber", "l_partkey"],
    )
    out = out.select("vendor_level", "po_level", "l_linenumber", "l_partkey", "Total_l_extendedprice")
    return rounded(out, 2, "Total_l_extendedprice")


@register(
    "po_reduction_all_lines",
    f'WITH {_PO_SQL} SELECT vendor_level, po_level, l_linenumber, l_partkey, round(total, 2) AS "Total_l_extendedprice" FROM po',
)
def po_reduction_all_lines(t):
    out = reduce.entity_totals(
        lines(t, "l_suppkey", "l_returnflag", "l_extendedprice"), "l_suppkey", ["l_returnflag", "l_orderkey"],
        "l_extendedprice", "po_level",
    )
    out = out.select("vendor_level", "po_level", "l_linenumber", "l_partkey", "Total_l_extendedprice")
    return rounded(out, 2, "Total_l_extendedprice")


@register(
    "invalid_indicators",
    "SELECT CASE WHEN l_linestatus = 'F' THEN 'S' WHEN l_quantity > 45 THEN 'X' WHEN l_quantity > 5 THEN 'H' END AS code, count(*) AS rows "
    "FROM lineitem GROUP BY 1 HAVING code IS NULL OR code NOT IN ('H', 'S', 'H-Credit', 'S-Debit')",
)
def invalid_indicators(t):
    return reduce.invalid_indicators(t.lineitem.select(indicator().alias("code")), "code")


@register(
    "drop_duplicates_keep_first",
    f"SELECT * EXCLUDE rn FROM (SELECT {_LINE}, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey "
    "ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1",
)
def drop_duplicates_keep_first(t):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]
    return reduce.drop_duplicates_first(lines(t, "l_suppkey", "l_quantity"), ["l_suppkey"], order)


@register("full_row_distinct", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def full_row_distinct(t):
    return t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


@register(
    "key_hash",
    f"SELECT {_LINE}, md5(concat_ws(chr(1), l_returnflag, year(l_shipdate)::VARCHAR, l_orderkey::VARCHAR)) AS key FROM lineitem",
)
def key_hash(t):
    rows = lines(t, "l_returnflag", F.year("l_shipdate").alias("y"))
    out = rows.withColumn("key", reduce.key_hash("l_returnflag", "y", "l_orderkey"))
    return out.drop("l_returnflag", "y")


@register(
    "amount_and_count_report",
    "SELECT o_orderpriority AS submodule, count(*) AS total_count, round(sum(o_totalprice), 2) AS total_amount, "
    "count_if(o_orderstatus = 'F') AS concern_count, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS concern_amount "
    "FROM orders GROUP BY 1",
)
def amount_and_count_report(t):
    rows = t.orders.select(
        F.col("o_orderpriority").alias("submodule"), "o_totalprice",
        (F.col("o_orderstatus") == "F").cast("int").alias("ML_Prediction"),
    )
    out = reports.amount_and_count(rows, ["submodule"], "o_totalprice", "ML_Prediction")
    return rounded(out, 2, "total_amount", "concern_amount")


@register(
    "top_risk_patterns",
    "SELECT p_brand AS \"Module\", p_type AS \"SubModule\", p_partkey AS \"PatternID\", p_name AS \"PatternDescriptionLong\", 'High' AS \"KRI\", "
    "p_size::BIGINT AS \"TestedCount\", (p_size % 7)::BIGINT AS \"FailedCount\", round((p_size % 7) * 100.0 / p_size, 2)::DOUBLE AS \"FailedCount_Percent\" "
    "FROM part WHERE p_size > 0 AND p_size % 7 > 0 AND p_retailprice > 950",
)
def top_risk_patterns(t):
    patterns = t.part.select(
        F.col("p_brand").alias("Module"), F.col("p_type").alias("SubModule"), F.col("p_partkey").alias("PatternID"),
        F.col("p_name").alias("PatternDescriptionLong"), F.lit("High").alias("KRI"),
        F.col("p_size").cast("long").alias("TestedCount"), (F.col("p_size") % 7).cast("long").alias("FailedCount"),
        (F.col("p_retailprice") > 950).cast("int").alias("IsEnabled"),
    )
    out = reports.top_risk_patterns(patterns)
    return out.withColumn("FailedCount_Percent", F.col("FailedCount_Percent").cast("double"))


@register(
    "alert_counts",
    f'SELECT "Module", "SubModule", "ResponseText", count(DISTINCT "AlertId") AS alerts, count(DISTINCT "SPT_RowID") AS transactions FROM ({ANSWERS_SQL}) GROUP BY ALL',
)
def alert_counts(t):
    return reports.alert_counts(_answers(t), ["Module", "SubModule", "ResponseText"], "AlertId", "SPT_RowID")


@register(
    "value_frequencies",
    "SELECT l_quantity, count(*) AS count, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS share FROM lineitem GROUP BY 1",
)
def value_frequencies(t):
    return rounded(reports.value_frequencies(t.lineitem, "l_quantity"), 6, "share")


@register(
    "missing_values_summary",
    """
    WITH w AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    SELECT 'quality' AS column_name, count_if(quality IS NULL) AS missing, round(count_if(quality IS NULL) / count(*), 6) AS share FROM w
    UNION ALL SELECT 'toxic', count_if(toxic IS NULL), round(count_if(toxic IS NULL) / count(*), 6) FROM w
    """,
)
def missing_values_summary(t):
    wide = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return rounded(reports.missing_summary(wide), 6, "share")


@register(
    "column_distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(DISTINCT {c}) AS distinct_values FROM lineitem"
        for c in ("l_returnflag", "l_suppkey", "l_quantity", "l_discount", "l_partkey")
    ),
)
def column_distinct_counts(t):
    return reports.distinct_counts(t.lineitem, ["l_returnflag", "l_suppkey", "l_quantity", "l_discount", "l_partkey"])


@register(
    "describe_by_group",
    "SELECT o_orderstatus, count(o_totalprice) AS count, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, "
    "min(o_totalprice) AS min, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, "
    "round(quantile_cont(o_totalprice, 0.5), 4) AS q50, round(quantile_cont(o_totalprice, 0.75), 4) AS q75 FROM orders GROUP BY 1",
)
def describe_by_group(t):
    return rounded(reports.describe(t.orders, ["o_orderstatus"], "o_totalprice"), 4, "mean", "std", "q25", "q50", "q75")


@register(
    "describe_whole_table",
    "SELECT count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, "
    "min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, "
    "round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75 FROM lineitem",
)
def describe_whole_table(t):
    return rounded(reports.describe(t.lineitem, [], "l_extendedprice"), 4, "mean", "std", "q25", "q50", "q75")


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "target"]


def correlations(t):
    """Line measures and a target that depends on quantity."""
    rows = t.lineitem.select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        ((F.col("l_quantity") > 40) & (F.col("l_returnflag") != "N")).cast("int").alias("target"),
    )
    return reports.correlation_pairs(rows, _NUMERIC)


_CORR_SQL = (
    "WITH l AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, (l_quantity > 40 AND l_returnflag <> 'N')::INT AS target FROM lineitem), "
    "r AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS correlation FROM l"
        for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1 :]
    ) + ")"
)


@register("correlation_pairs", _CORR_SQL + " SELECT feature1, feature2, round(correlation, 6) AS correlation FROM r")
def correlation_pairs(t):
    return rounded(correlations(t), 6, "correlation")


@register(
    "correlation_matrix",
    _CORR_SQL + " SELECT feature1, feature2, round(correlation, 6) AS correlation FROM r UNION ALL SELECT feature2, feature1, round(correlation, 6) FROM r "
    + "".join(f" UNION ALL SELECT '{c}', '{c}', 1.0" for c in _NUMERIC),
)
def correlation_matrix(t):
    return rounded(reports.correlation_matrix(correlations(t), _NUMERIC), 6, "correlation")


@register(
    "high_correlation_pairs",
    _CORR_SQL + " SELECT r.feature1, r.feature2, round(r.correlation, 6) AS correlation, round(a.correlation, 6) AS target_correlation1, "
    "round(b.correlation, 6) AS target_correlation2 FROM r JOIN r a ON a.feature1 = r.feature1 AND a.feature2 = 'target' "
    "JOIN r b ON b.feature1 = r.feature2 AND b.feature2 = 'target' WHERE r.feature2 <> 'target' AND abs(r.correlation) > 0.001",
)
def high_correlation_pairs(t):
    out = reports.high_correlations(correlations(t), "target", 0.001)
    return rounded(out, 6, "correlation", "target_correlation1", "target_correlation2")


@register(
    "correlation_histogram",
    _CORR_SQL + " SELECT greatest(0, ceil(abs(correlation) * 10)::BIGINT - 1) AS tenth, count(*) AS pairs FROM r GROUP BY 1",
)
def correlation_histogram(t):
    out = reports.correlation_histogram(correlations(t))
    return out.withColumn("tenth", F.col("tenth").cast("long"))


@register(
    "redundancy_ratio",
    _CORR_SQL + ", b AS (SELECT feature1, feature2, abs(correlation) AS r FROM r UNION ALL SELECT feature2, feature1, abs(correlation) FROM r) "
    "SELECT feature1 AS feature, round(1 + sum(CASE WHEN feature2 <> 'target' THEN r ELSE 0 END), 4) AS sum_correlation, "
    "round(max(CASE WHEN feature2 = 'target' THEN r END), 4) AS target_correlation, "
    "round((1 + sum(CASE WHEN feature2 <> 'target' THEN r ELSE 0 END)) / max(CASE WHEN feature2 = 'target' THEN r END), 3) AS ratio "
    "FROM b WHERE feature1 <> 'target' GROUP BY 1",
)
def redundancy_ratio(t):
    out = reports.redundancy_ratio(correlations(t), "target")
    return rounded(rounded(out, 4, "sum_correlation", "target_correlation"), 3, "ratio")


@register(
    "score_sum_label",
    f"SELECT {_LINE}, round(l_extendedprice + l_quantity * 1000 + coalesce(CASE WHEN l_tax > 0 THEN l_tax END, 0), 4) AS total, "
    "(l_extendedprice + l_quantity * 1000 + l_tax > 100000)::BIGINT AS label FROM lineitem",
)
def score_sum_label(t):
    rows = lines(
        t, F.col("l_extendedprice").alias("s1"), (F.col("l_quantity") * 1000).alias("s2"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("s3"),
    )
    out = reports.score_sum_label(rows, ["s1", "s2", "s3"], 100000.0).drop("s1", "s2", "s3")
    return rounded(out.withColumn("label", F.col("label").cast("long")), 4, "total")


def predictions(t):
    return t.orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("Model_Name"), F.trunc("o_orderdate", "year").alias("Prediction_DateTime"),
        (F.col("o_totalprice") > 400000).cast("int").alias("ML_Prediction"),
    )


@register(
    "last_prediction",
    "SELECT o_orderpriority AS \"Model_Name\", year(o_orderdate) AS year, count_if(o_totalprice > 400000) AS concerns FROM orders GROUP BY ALL",
)
def last_prediction(t):
    out = reports.last_prediction(predictions(t))
    return out.select("Model_Name", F.year("Prediction_DateTime").cast("long").alias("year"), "concerns")


@register(
    "reconcile_predictions",
    "SELECT count_if(o_totalprice > 400000) AS predicted_concerns, count_if(o_totalprice > 400000 AND o_orderstatus <> 'P') AS base_concerns, false AS is_updated FROM orders",
)
def reconcile_predictions(t):
    base = predictions(t).join(t.orders.where("o_orderstatus <> 'P'").select("o_orderkey"), "o_orderkey", "left_semi")
    return reports.reconcile_predictions(predictions(t), base)


@register(
    "class_balance",
    "SELECT count_if(toxic = 1) AS concern, count_if(toxic = 0) AS no_concern, "
    "least(count_if(toxic = 1), count_if(toxic = 0)) >= 2 AND count(*) >= 60 AS enough_data FROM labels",
)
def class_balance(t):
    return reports.class_balance(t.labels, "toxic")
