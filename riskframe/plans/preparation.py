"""Column checks, imputation, encoders and feature building."""

from pyspark.sql import functions as F

from riskframe import features as ft
from riskframe.functions.predicates import REMOVABLE_NAME_PARTS
from riskframe.operators import alerts
from riskframe.plans.catalogue import register
from riskframe.plans.joins import _answers
from riskframe.prep import columns, encode, impute


def labelled(t):
    """Documents with their label: the labelled set of the checks."""
    labels = t.labels.select("doc_id", F.col("toxic").cast("int").alias("target"), "quality")
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id")


_LABELLED = "(SELECT d.doc_id, lang, source, n_chars, toxic AS target, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _facts_sql(table, texts=(), numbers=(), others=(), **made):
    """One row of facts per column, computed from the data; ``made`` columns are expressions."""
    parts = []
    for name in (*texts, *numbers, *others):
        c = made.get(name, name)
        deviation = f"stddev_samp({c})" if name in numbers else "NULL::DOUBLE"
        parts.append(
            f"SELECT '{name}' AS column_name, count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS levels, {deviation} AS std, "
            f"coalesce(max(len(regexp_extract_all(({c})::VARCHAR, '\\S+'))), 0) AS words, {name in numbers} AS numeric, "
            f"(SELECT max(n) / sum(n) FROM (SELECT count(*) AS n FROM (SELECT {c} AS v FROM {table}) WHERE v IS NOT NULL GROUP BY v)) AS top, "
            f"count(try_cast(({c})::VARCHAR AS DOUBLE)) = count({c}) AS is_number, count(try_cast(({c})::VARCHAR AS TIMESTAMP)) = count({c}) AS is_date FROM {table}"
        )
    return "(" + " UNION ALL ".join(parts) + ")"


_ORDER_FACTS = _facts_sql("orders", ("o_orderstatus", "o_orderpriority"), ("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderdate",))


@register(
    "column_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS distinct_values FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    ),
)
def column_profile(t):
    out = columns.profile(t.orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    return out.select("column_name", "rows", "present", "distinct_values")


@register("near_unique_columns", f"SELECT column_name FROM {_ORDER_FACTS} WHERE levels / rows > 0.5")
def near_unique_columns(t):
    return columns.near_unique_columns(columns.profile(t.orders))


@register("top_value_shares", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(max(n) / sum(n), 6) AS top_share FROM (SELECT count(*) AS n FROM orders GROUP BY {c})"
    for c in ("o_custkey", "o_orderstatus", "o_orderpriority")
))
def top_value_shares(t):
    out = columns.top_value_shares(t.orders, ["o_custkey", "o_orderstatus", "o_orderpriority"])
    return out.withColumn("top_share", F.round("top_share", 6))


@register("free_text_columns", f"SELECT column_name FROM {_facts_sql('documents', ('text', 'lang', 'source'), ('doc_id', 'n_chars'))} WHERE words > 5")
def free_text_columns(t):
    return columns.free_text_columns(columns.profile(t.documents))


@register(
    "missing_columns",
    "SELECT column_name FROM " + _facts_sql("orders", ("o_orderstatus",), ("o_orderkey", "flag"), flag="CASE WHEN o_custkey = 1 THEN 1 END") + " WHERE (rows - present) / rows > 0.8",
)
def missing_columns(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_custkey") == 1, 1).alias("flag"), "o_orderstatus")
    return columns.missing_columns(columns.profile(rows))


@register("constant_columns", f"SELECT column_name FROM {_facts_sql('part', ('p_brand',), ('same', 'p_size'), same='1')} WHERE levels = 1")
def constant_columns(t):
    return columns.constant_columns(columns.profile(t.part.select("p_brand", F.lit(1).alias("same"), "p_size")))


_REMOVABLE = " OR ".join(f"contains(lower(column_name), '{p.lower()}')" for p in REMOVABLE_NAME_PARTS)
_MODELLED = _facts_sql(
    "orders", ("clerk", "same", "o_orderpriority"), ("SPT_Source", "o_totalprice"), SPT_Source="o_custkey", clerk="'Clerk' || o_orderkey", same="'x'"
)


@register("modelling_removals", f"SELECT column_name FROM {_MODELLED} WHERE {_REMOVABLE} OR levels <= 1 OR (levels / rows >= 0.5 AND NOT numeric)")
def modelling_removals(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("SPT_Source"), F.concat(F.lit("Clerk"), "o_orderkey").alias("clerk"),
        F.lit("x").alias("same"), "o_orderpriority", "o_totalprice",
    )
    return columns.modelling_removals(columns.profile(rows), REMOVABLE_NAME_PARTS)


@register(
    "profile_removals",
    f"SELECT column_name FROM {_facts_sql('lineitem', (), ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'))} WHERE std < 0.1 OR (rows - present) / rows > 0.997",
)
def profile_removals(t):
    return columns.profile_removals(columns.profile(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@register(
    "column_roles",
    "SELECT column_name, CASE WHEN column_name = 'o_totalprice' THEN 'numeric' WHEN is_date AND NOT is_number THEN 'datetime' "
    f"WHEN NOT is_number AND levels / rows <= 0.5 AND top >= 0.01 AND words <= 5 THEN 'categorical' ELSE 'dropped' END AS role FROM {_ORDER_FACTS} WHERE column_name <> 'o_orderkey'",
)
def column_roles(t):
    return columns.assign_roles(t.orders, ["o_totalprice"], "o_orderkey")


_RARE = f"""
    n AS (SELECT source, count(*) AS c, max(target) AS p, sum(count(*)) OVER () AS n FROM {_LABELLED} GROUP BY source),
    rare AS (SELECT source FROM n WHERE c / n < 0.01 AND p = 0)
"""


@register("rare_labels", f"WITH {_RARE} SELECT 'source' AS column_name, source AS label FROM rare")
def rare_labels(t):
    return impute.rare_labels(labelled(t), ["source"], "target")


@register(
    "rare_labels_replaced",
    f"WITH {_RARE} SELECT doc_id, CASE WHEN source IN (SELECT source FROM rare) THEN '<||unknown||>' ELSE source END AS source FROM documents",
)
def rare_labels_replaced(t):
    rare = impute.rare_labels(labelled(t), ["source"], "target")
    return impute.impute_rare_labels(t.documents.select("doc_id", "source"), rare, ["source"])


_BANDED = "(SELECT doc_id, 'band ' || (n_chars // 20)::VARCHAR AS band FROM documents)"
_RARE_BANDS = f"""
    n AS (SELECT band, count(*) AS c, max(toxic) AS p, sum(count(*)) OVER () AS n FROM {_BANDED} AS b JOIN labels AS l ON l.doc_id = b.doc_id GROUP BY band),
    rare AS (SELECT band FROM n WHERE c / n < 0.01 AND p = 0)
"""


def _banded(t):
    """Documents with a category of many levels, some of them rare: bands of length."""
    return t.documents.select("doc_id", F.concat(F.lit("band "), F.floor(F.col("n_chars") / 20).cast("string")).alias("band"))


@register("rare_length_bands", f"WITH {_RARE_BANDS} SELECT 'band' AS column_name, band AS label FROM rare")
def rare_length_bands(t):
    known = _banded(t).join(t.labels.select("doc_id", F.col("toxic").cast("int").alias("target")), "doc_id")
    return impute.rare_labels(known, ["band"], "target")


@register(
    "rare_length_bands_replaced",
    f"WITH {_RARE_BANDS} SELECT doc_id, CASE WHEN band IN (SELECT band FROM rare) THEN '<||unknown||>' ELSE band END AS band FROM {_BANDED}",
)
def rare_length_bands_replaced(t):
    return impute.impute_rare_labels(_banded(t), rare_length_bands(t), ["band"])


@register(
    "date_median_imputation",
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders) "
    "SELECT o_orderkey, coalesce(epoch_us(d), (SELECT quantile_cont(epoch_us(d), 0.5) FROM o)::BIGINT) AS micros FROM o",
)
def date_median_imputation(t):
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("d"))
    return impute.impute_dates(rows, ["d"]).select("o_orderkey", F.unix_micros("d").alias("micros"))


@register(
    "knn_imputation",
    """
    WITH r AS (SELECT p_partkey, p_size::DOUBLE AS p_size, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS y FROM part),
    n AS (
        SELECT g.p_partkey, b.y, row_number() OVER (PARTITION BY g.p_partkey ORDER BY abs(g.p_size - b.p_size), b.p_partkey) AS place
        FROM r g JOIN r b ON b.y IS NOT NULL WHERE g.y IS NULL
    ),
    f AS (SELECT p_partkey, avg(y) AS fill FROM n WHERE place <= 5 GROUP BY p_partkey)
    SELECT r.p_partkey, r.p_size, round(coalesce(r.y, f.fill)::DOUBLE, 6) AS p_retailprice FROM r LEFT JOIN f ON f.p_partkey = r.p_partkey
    """,
)
def knn_imputation(t):
    rows = t.part.select(
        "p_partkey", F.col("p_size").cast("double").alias("p_size"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("p_retailprice"),
    )
    out = impute.knn_impute(rows, "p_partkey", "p_retailprice", ["p_size"], 5)
    return out.withColumn("p_retailprice", F.round("p_retailprice", 6))


_SCALE = "(SELECT quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS s FROM orders)"


@register(
    "robust_scale",
    f"SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS scaled, round(o_totalprice, 4) AS restored FROM orders, {_SCALE}",
)
def robust_scale(t):
    median, spread = encode.robust_parameters(t.orders, ["o_totalprice"])["o_totalprice"]
    out = t.orders.withColumn("scaled", encode.robust_scale("o_totalprice", median, spread))
    restored = F.round(encode.robust_unscale("scaled", median, spread), 4).alias("restored")
    return out.select("o_orderkey", F.round("scaled", 6).alias("scaled"), restored)


def _bin_sql(x):
    e = f"greatest(0, ceil(log10({x})) - 1)"
    hi = f"(ceil({x} / pow(10, {e})) * pow(10, {e}))"
    return f"CASE WHEN {x} = 0 THEN '0-1' WHEN {x} > 0 THEN ({hi} - pow(10, {e}))::BIGINT || '-' || {hi}::BIGINT END"


@register("decade_bins", f"SELECT event_id, {_bin_sql('(value * 1.0)')} AS bin, {_bin_sql('(event_id * 1.0)')} AS id_bin FROM events")
def decade_bins(t):
    return t.events.select(
        "event_id", encode.decade_bin(F.col("value")).alias("bin"), encode.decade_bin(F.col("event_id").cast("double")).alias("id_bin")
    )


@register(
    "polynomial_features",
    "SELECT o_orderkey, round(pow(o_totalprice / 7000, 1), 6) AS \"p^1\", round(pow(o_totalprice / 7000, 2), 6) AS \"p^2\" FROM orders",
)
def polynomial_features(t):
    out = t.orders.select("o_orderkey", *encode.powers("p", F.col("o_totalprice") / 7000))
    return out.select("o_orderkey", F.round("`p^1`", 6).alias("p^1"), F.round("`p^2`", 6).alias("p^2"))


@register(
    "numeric_encoder",
    f"SELECT o_orderkey, {_bin_sql('o_totalprice')} AS \"o_totalprice_Range\", round((o_totalprice - m) / s, 6) AS \"o_totalprice^1\", "
    f"round(pow((o_totalprice - m) / s, 2), 6) AS \"o_totalprice^2\" FROM orders, {_SCALE}",
)
def numeric_encoder(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    out = encode.NumericEncoder(["o_totalprice"]).fit(rows).transform(rows)
    return out.withColumns({c: F.round(f"`{c}`", 6) for c in ("o_totalprice^1", "o_totalprice^2")})


@register(
    "datetime_encoder",
    "SELECT o_orderkey, quarter(o_orderdate)::VARCHAR AS \"o_orderdate_Qtr\", monthname(o_orderdate) AS \"o_orderdate_Month\", "
    "day(o_orderdate)::BIGINT AS \"o_orderdate_DayOfMonth\", dayname(o_orderdate) AS \"o_orderdate_WkDay\" FROM orders",
)
def datetime_encoder(t):
    out = encode.DateTimeEncoder(["o_orderdate"]).transform(t.orders.select("o_orderkey", "o_orderdate"))
    return out.withColumn("o_orderdate_DayOfMonth", F.col("o_orderdate_DayOfMonth").cast("long"))


@register(
    "one_hot_encoder",
    "SELECT l_orderkey, l_partkey, " + ", ".join(
        f"(lower(l_returnflag) = '{v}')::BIGINT AS \"l_returnflag={v}\"" for v in "anr"
    ) + ", " + ", ".join(f"(lower(l_linestatus) = '{v}')::BIGINT AS \"l_linestatus={v}\"" for v in "fo") + " FROM lineitem",
)
def one_hot_encoder(t):
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    out = encode.OneHotEncoder(["l_returnflag", "l_linestatus"]).fit(rows).transform(rows)
    return out.select(*[F.col(f"`{c}`").cast("long").alias(c) for c in out.columns])


@register("feature_builder")
def feature_builder(t):
    rows = labelled(t).join(t.documents.select("doc_id", F.length("text").cast("double").alias("size")), "doc_id").drop("quality")
    dated = rows.withColumn("seen", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")))
    builder = encode.FeatureBuilder("doc_id", ["n_chars", "size"], ["seen"], ["lang", "source"], "target")
    return builder.fit(dated).transform(dated)


@register(
    "key_audit",
    """
    SELECT count(*) AS features_rows, 0::BIGINT AS features_null_keys, 0::BIGINT AS features_duplicate_keys,
      (SELECT count(*) FROM labels) AS labels_rows, 0::BIGINT AS labels_null_keys, 0::BIGINT AS labels_duplicate_keys,
      count_if(doc_id NOT IN (SELECT doc_id FROM labels)) AS features_unmatched, 0::BIGINT AS labels_unmatched,
      count(*) = (SELECT count(*) FROM labels) AS equal_rows FROM documents
    """,
)
def key_audit(t):
    return columns.key_audit(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@register(
    "training_labels",
    """
    SELECT l_orderkey * 10 + l_linenumber AS "SPT_RowID", max((o_orderpriority = '1-URGENT')::INT)::BIGINT AS target
    FROM orders o JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = o_orderkey % 25 JOIN supplier ON s_suppkey = n_nationkey
    WHERE o_totalprice <= 400000 AND o_orderkey % 7 <> 0 AND n_nationkey % 6 <> 0 AND s_acctbal > 0 AND s_suppkey % 4 IN (0, 2)
      AND o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1
    """,
)
def training_labels(t):
    answers = _answers(t).withColumn("q", F.lit("risk?"))
    out = alerts.training_labels(
        answers, "SPT_RowID", "q", "ResponseText", [("risk?", ["1-URGENT"])], [("risk?", ["5-LOW", "1-URGENT"])]
    )
    return out.withColumn("target", F.col("target").cast("long"))


@register(
    "target_from_question",
    "SELECT o_orderkey, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::BIGINT AS target FROM orders WHERE o_orderstatus = 'F'",
)
def target_from_question(t):
    closed = t.orders.where("o_orderstatus = 'F'")
    return closed.select("o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("long").alias("target"))


def _features():
    def order_lines(df):
        return df.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("copies"))

    return [
        ft.Feature("Large", ["o_totalprice"], ["flag"], column=lambda: {"flag": (F.col("o_totalprice") > 300000).cast("long")}),
        ft.Feature("Copies", ["o_custkey"], ["copies"], run=order_lines, fill={"copies": 0}),
        ft.Feature("Absent", ["no_such_column"], ["x"], run=lambda df: df),
    ]


@register(
    "custom_features",
    "SELECT o_orderkey, (o_totalprice > 300000)::BIGINT AS \"Anmly_Large_flag\", 1::BIGINT AS \"Anmly_Copies_copies\" FROM orders",
)
def custom_features(t):
    out = ft.with_features(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", _features())
    return out.select("o_orderkey", "Anmly_Large_flag", "Anmly_Copies_copies")


@register(
    "feature_key_check",
    "SELECT count(*) AS before_rows, count(*) AS before_keys, min(o_orderkey) AS before_min, max(o_orderkey) AS before_max, "
    "count_if(o_totalprice > 1500) AS after_rows, count_if(o_totalprice > 1500) AS after_keys, min(o_orderkey) FILTER (o_totalprice > 1500) AS after_min, "
    "max(o_orderkey) FILTER (o_totalprice > 1500) AS after_max, false AS same_keys FROM orders",
)
def feature_key_check(t):
    return ft.key_check(t.orders, t.orders.where("o_totalprice > 1500"), "o_orderkey")


@register("by_column", "SELECT upper(o_orderstatus) AS o_orderstatus, upper(o_orderpriority) AS o_orderpriority FROM orders")
def by_column(t):
    return ft.by_column(t.orders.select("o_orderstatus", "o_orderpriority"), F.upper)
