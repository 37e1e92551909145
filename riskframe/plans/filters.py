"""Projections, filters and predicates over the standard tables."""

from pyspark.sql import functions as F

from riskframe.functions import predicates as p
from riskframe.plans.catalogue import register

_CUSTOMER = "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE "

# name, column, operator, values, SQL condition
_USER_FILTERS = [
    ("equals", "c_mktsegment", "EQUALS", "BUILDING", "c_mktsegment = 'BUILDING'"),
    ("not_equals", "c_mktsegment", "NOT EQUALS", "BUILDING", "c_mktsegment <> 'BUILDING'"),
    ("greater", "c_acctbal", "GREATER THAN", 5000.0, "c_acctbal > 5000"),
    ("less", "c_acctbal", "LESS THAN", 0.0, "c_acctbal < 0"),
    ("greater_equal", "c_custkey", "GREATER THAN OR EQUAL", 700, "c_custkey >= 700"),
    ("less_equal", "c_custkey", "LESS THAN OR EQUAL", 70, "c_custkey <= 70"),
    ("in", "c_mktsegment", "IN", ["BUILDING", "MACHINERY"], "c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    ("not_in", "c_mktsegment", "NOT IN", ["BUILDING", "MACHINERY"], "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    ("contains", "c_name", "CONTAINS", "0001", "contains(c_name, '0001')"),
    ("not_contains", "c_name", "NOT CONTAINS", "0001", "NOT contains(c_name, '0001')"),
    ("starts_with", "c_mktsegment", "STARTS WITH", "AUTO", "starts_with(c_mktsegment, 'AUTO')"),
    ("ends_with", "c_name", "ENDS WITH", "7", "ends_with(c_name, '7')"),
]


def _user_filter(column, operator, values):
    def run(t):
        rows = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
        return rows.where(p.predicate(column, operator, values))

    return run


for _name, _column, _operator, _values, _condition in _USER_FILTERS:
    register(f"filter_{_name}", _CUSTOMER + _condition)(_user_filter(_column, _operator, _values))

# Missing values arise from an outer join: customers without an order.
_OUTER = (
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey "
    "AND o_orderstatus = 'F' AND o_totalprice > 450000 WHERE "
)


def _missing_filter(operator):
    def run(t):
        big = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 450000")
        rows = t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left")
        return rows.select("c_custkey", "o_orderkey").where(p.predicate("o_orderkey", operator))

    return run


register("filter_is_missing", _OUTER + "o_orderkey IS NULL")(_missing_filter("IS MISSING"))
register("filter_is_not_missing", _OUTER + "o_orderkey IS NOT NULL")(_missing_filter("IS NOT MISSING"))


@register(
    "filter_group_and_or",
    "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 400000) "
    "OR o_orderpriority IN ('1-URGENT')",
)
def filter_group_and_or(t):
    big = p.filter_group(
        [p.predicate("o_orderstatus", "EQUALS", "F"), p.predicate("o_totalprice", "GREATER THAN", 400000.0)], "AND"
    )
    urgent = p.predicate("o_orderpriority", "IN", ["1-URGENT"])
    return t.orders.where(p.filter_group([big, urgent], "OR")).select("o_orderkey")


@register("filter_options", "SELECT DISTINCT p_size::VARCHAR AS option FROM part ORDER BY p_size LIMIT 100")
def filter_options(t):
    return p.filter_options(t.part, "p_size")


_TERMS = ["license", "@example", "THE ENTHER", "password"]


@register(
    "substring_list_filter",
    "SELECT doc_id FROM documents WHERE "
    + " OR ".join(f"contains(lower(text), '{x.lower()}')" for x in _TERMS),
)
def substring_list_filter(t):
    return t.documents.where(p.contains_any("text", _TERMS)).select("doc_id")


@register(
    "substring_table_filter",
    "WITH t AS (SELECT DISTINCT lower(p_name) AS term FROM part UNION SELECT DISTINCT lower(s) FROM (SELECT unnest(string_split(text, '.')) AS s FROM benchmark) WHERE trim(s) <> '') "
    "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM t WHERE contains(lower(text), term))",
)
def substring_table_filter(t):
    sentences = t.benchmark.select(F.explode(F.split("text", r"\.")).alias("term"))
    terms = t.part.select(F.col("p_name").alias("term")).union(sentences)
    return p.with_any_term(t.documents, "doc_id", "text", terms, "term").select("doc_id")


@register("distinct_modules", "SELECT DISTINCT r_name AS module FROM region JOIN nation ON n_regionkey = r_regionkey")
def distinct_modules(t):
    meta = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return meta.select(F.col("r_name").alias("module")).distinct()


@register(
    "distinct_submodules",
    "SELECT DISTINCT n_name AS submodule FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
def distinct_submodules(t):
    meta = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return meta.where(p.predicate("r_name", "EQUALS", "ASIA")).select(F.col("n_name").alias("submodule")).distinct()


@register(
    "drop_helper_columns",
    "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders",
)
def drop_helper_columns(t):
    wide = t.orders.select(
        "o_orderkey",
        "o_orderstatus",
        "o_orderpriority",
        F.col("o_totalprice").alias("P1_Tran_Score"),
        F.col("o_custkey").alias("SPT_Source"),
        F.lower("o_orderpriority").alias("LineDescription"),
    )
    return p.without_helper_columns(wide)


@register(
    "blank_to_null",
    r"SELECT doc_id, line, count(*) AS copies FROM (SELECT doc_id, CASE WHEN regexp_full_match(l, '\s*') THEN NULL ELSE l END AS line "
    "FROM (SELECT doc_id, unnest(string_split(text, '.')) AS l FROM documents)) WHERE line IS NULL GROUP BY ALL",
)
def blank_to_null(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", r"\.")).alias("line"))
    blank = p.blank_to_null(lines).where(F.col("line").isNull())
    return blank.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("copies"))


@register(
    "enabled_patterns",
    "SELECT p_partkey AS pattern_id, p_brand AS module, p_retailprice AS weight FROM part "
    "WHERE p_size > 25 AND p_brand = 'Brand#7' AND p_type = 'PROMO' ORDER BY weight DESC, pattern_id",
)
def enabled_patterns(t):
    from riskframe.operators.reports import enabled_patterns as run

    patterns = t.part.select(
        F.col("p_partkey").alias("pattern_id"),
        F.col("p_brand").alias("module"),
        F.col("p_type").alias("submodule"),
        (F.col("p_size") > 25).cast("int").alias("is_enabled"),
        F.col("p_retailprice").alias("weight"),
    )
    return run(patterns, "Brand#7", "PROMO").select("pattern_id", "module", "weight")


@register(
    "answered_alerts",
    "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey "
    "WHERE o_orderstatus = 'F' AND ((o_orderpriority = '1-URGENT' AND c_mktsegment IN ('BUILDING', 'MACHINERY')) "
    "OR (o_orderpriority = '5-LOW' AND c_mktsegment IN ('FURNITURE')))",
)
def answered_alerts(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    wanted = [("1-URGENT", ["BUILDING", "MACHINERY"]), ("5-LOW", ["FURNITURE"])]
    closed = rows.where(F.col("o_orderstatus") == "F")
    return closed.where(p.answered("o_orderpriority", "c_mktsegment", wanted)).select("o_orderkey")


@register(
    "question_list",
    "SELECT p_partkey, p_size::BIGINT AS render_type FROM part WHERE p_size = 4 OR p_size = 6 OR p_brand = 'Brand#3'",
)
def question_list(t):
    from riskframe.operators.reports import question_list as run

    questions = t.part.select(
        "p_partkey", F.col("p_size").cast("long").alias("render_type"), F.col("p_brand").alias("template")
    )
    return run(questions, "render_type", "template", "Brand#3").select("p_partkey", "render_type")


@register(
    "exclude_intercompany",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem WHERE l_returnflag <> 'R'",
)
def exclude_intercompany(t):
    flag = F.when(F.col("l_returnflag") == "R", "True").when(F.col("l_returnflag") == "A", "False")
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), flag.alias("ic"))
    return rows.where(p.not_flagged("ic")).select("l_orderkey", "l_linenumber")


@register(
    "target_from_lists",
    "SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48) THEN 1 "
    "WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45) THEN 0 END::BIGINT AS target FROM orders",
)
def target_from_lists(t):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    concern = lines.where("l_returnflag = 'R' AND l_quantity > 48")
    other = lines.where("l_returnflag = 'A' AND l_quantity > 45")
    out = p.target_from_lists(t.orders.select("o_orderkey"), "o_orderkey", concern, other)
    return out.withColumn("target", F.col("target").cast("long"))
