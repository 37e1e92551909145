"""Joins: alerts, metadata, reports, updates, similarity and matching."""

from pyspark.sql import functions as F

from riskframe.operators import alerts, matching, reports, similarity
from riskframe.plans.catalogue import register


def alert_tables(t):
    """The standard tables in the shape of the alert schema."""
    a = t.orders.select(
        F.col("o_orderkey").alias("AlertId"), F.col("o_custkey").alias("EntityID"),
        F.col("o_orderpriority").alias("Module"), F.col("o_orderstatus").alias("SubModule"),
        (F.col("o_custkey") % 5).cast("int").alias("AlertState"),
        (F.col("o_totalprice") > 400000).cast("int").alias("IsSoftDelete"),
    )
    status = t.region.select(F.col("r_regionkey").alias("StatuslookupId"), F.col("r_name").alias("StatusDescription"))
    details = t.lineitem.select(
        F.col("l_orderkey").alias("AlertId"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("SPT_RowID"),
        F.lit("lineitem").alias("UDMTable"),
    )
    responses = t.orders.select(
        F.col("o_orderkey").alias("AlertId"), (F.col("o_orderkey") % 25).cast("int").alias("QuestionnaireAssID"),
        F.col("o_orderpriority").alias("ResponseText"), (F.col("o_orderkey") % 7 != 0).cast("int").alias("IsActive"),
    )
    associations = t.nation.select(
        F.col("n_nationkey").alias("QuestionnaireTemplateAssociationID"), F.col("n_regionkey").alias("QuestionnaireTemplateID"),
        F.col("n_nationkey").cast("long").alias("QuestionnaireID"), (F.col("n_nationkey") % 6 != 0).cast("int").alias("IsActive"),
    )
    questions = t.supplier.select(
        F.col("s_suppkey").alias("QuestionnaireID"), F.col("s_name").alias("QuestionnaireText"), F.lit("Yes|No").alias("Options"),
        (F.col("s_suppkey") % 4 + 4).cast("int").alias("RenderTypeID"), (F.col("s_acctbal") > 0).cast("int").alias("IsActive"),
    )
    return a, status, details, responses, associations, questions


ANSWERS_SQL = """
    SELECT o.o_orderkey AS "AlertId", o_custkey AS "EntityID", o_orderpriority AS "Module", o_orderstatus AS "SubModule",
      r_name AS "StatusDescription", l_orderkey * 10 + l_linenumber AS "SPT_RowID", o_orderpriority AS "ResponseText",
      s_name AS "QuestionnaireText", (s_suppkey % 4 + 4)::BIGINT AS "RenderTypeID"
    FROM orders o JOIN region ON r_regionkey = o_custkey % 5 JOIN lineitem ON l_orderkey = o.o_orderkey
    JOIN nation ON n_nationkey = o.o_orderkey % 25 JOIN supplier ON s_suppkey = n_nationkey
    WHERE o_totalprice <= 400000 AND o.o_orderkey % 7 <> 0 AND n_nationkey % 6 <> 0 AND s_acctbal > 0 AND s_suppkey % 4 IN (0, 2)
"""


def _answers(t):
    return alerts.alert_answers(*alert_tables(t))


@register("alert_answers", ANSWERS_SQL)
def alert_answers(t):
    out = _answers(t).withColumn("RenderTypeID", F.col("RenderTypeID").cast("long"))
    return out.drop("QTAID", "UDMTable", "Options")


@register(
    "question_templates",
    'SELECT s_suppkey AS "QuestionnaireID", s_name AS "QuestionnaireText", n_regionkey::BIGINT AS "QuestionnaireTemplateID" '
    "FROM supplier JOIN nation ON n_nationkey = s_suppkey WHERE s_acctbal > 0",
)
def question_templates(t):
    *_, associations, questions = alert_tables(t)
    out = alerts.question_templates(questions, associations)
    return out.select(
        "QuestionnaireID", "QuestionnaireText", F.col("QuestionnaireTemplateID").cast("long").alias("QuestionnaireTemplateID")
    )


def _metadata(t):
    modules = t.nation.select(
        F.col("n_nationkey").alias("ModuleId"), F.col("n_name").alias("ModuleName"), F.col("n_regionkey").alias("RiskId"),
        F.lit(1).alias("IsActive"),
    )
    clients = t.region.select(
        F.col("r_regionkey").alias("ClientId"), F.col("r_name").alias("ClientUID"), F.lit(1).alias("IsActive")
    )
    projects = t.region.select(
        F.col("r_regionkey").alias("ProjectId"), F.concat(F.lit("P"), F.col("r_regionkey").cast("string")).alias("ProjectUID"),
        F.col("r_regionkey").alias("RiskId"), F.col("r_regionkey").alias("ClientId"), F.lit(1).alias("IsActive"),
    )
    submodules = t.customer.select(
        F.col("c_custkey").alias("SubModuleId"), F.col("c_name").alias("SubModuleName"), F.col("c_nationkey").alias("ModuleId"),
        (F.col("c_acctbal") > 0).cast("int").alias("IsActive"),
    )
    return modules, clients, projects, submodules


@register(
    "module_metadata",
    'SELECT n_nationkey::BIGINT AS "ModuleId", n_name AS "ModuleName", r_name AS "ClientUID", \'P\' || r_regionkey AS "ProjectUID" '
    "FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
def module_metadata(t):
    modules, clients, projects, _ = _metadata(t)
    out = alerts.module_metadata(modules, clients, projects, "ASIA", "P2")
    return out.select(F.col("ModuleId").cast("long").alias("ModuleId"), "ModuleName", "ClientUID", "ProjectUID")


@register(
    "submodule_metadata",
    'SELECT c_custkey AS "SubModuleId", c_name AS "SubModuleName", n_name AS "ModuleName" '
    "FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey "
    "WHERE r_name = 'ASIA' AND c_acctbal > 0",
)
def submodule_metadata(t):
    modules, clients, projects, submodules = _metadata(t)
    out = alerts.submodule_metadata(submodules, modules, clients, projects, "ASIA", "P2")
    return out.select("SubModuleId", "SubModuleName", "ModuleName")


@register(
    "child_lookup",
    "SELECT n_regionkey::BIGINT AS \"ParentID\", 100 + n_nationkey::BIGINT AS \"LookupID\" FROM nation JOIN region "
    "ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_name = 'NATION_7'",
)
def child_lookup(t):
    parents = t.region.select(
        F.col("r_regionkey").cast("long").alias("LookupID"), F.col("r_name").alias("Name"), F.lit(None).cast("long").alias("ParentID")
    )
    children = t.nation.select(
        (F.lit(100) + F.col("n_nationkey")).cast("long").alias("LookupID"), F.col("n_name").alias("Name"),
        F.col("n_regionkey").cast("long").alias("ParentID"),
    )
    return alerts.child_id(parents.unionByName(children), "ASIA", "NATION_7")


@register(
    "concern_report",
    f"""
    WITH a AS (SELECT DISTINCT "SPT_RowID", "Module", "SubModule", "ResponseText", "QuestionnaireText" FROM ({ANSWERS_SQL}))
    SELECT a.*, 'Concern' AS "ClosedAs", amount AS "Total_Concern_Amount", failed AS "Tests_Failed_Count"
    FROM a JOIN (SELECT l_orderkey * 10 + l_linenumber AS k, max(l_extendedprice) AS amount, max(l_quantity::BIGINT % 4) AS failed
      FROM lineitem GROUP BY 1) ON k = "SPT_RowID" WHERE failed > 0
    """,
)
def concern_report(t):
    rows = _answers(t).select("SPT_RowID", "Module", "SubModule", "ResponseText", "QuestionnaireText")
    base = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("SPT_RowID")).agg(
        F.max("l_extendedprice").alias("amount"), F.max(F.col("l_quantity").cast("long") % 4).alias("Tests_Failed_Count")
    )
    return alerts.concern_report(rows, base, "SPT_RowID", "Tests_Failed_Count", "amount")


@register(
    "features_with_labels",
    "SELECT d.doc_id, n_chars, toxic::BIGINT AS target FROM documents d JOIN labels l ON l.doc_id = d.doc_id",
)
def features_with_labels(t):
    labels = t.labels.select("doc_id", F.col("toxic").cast("long").alias("target"))
    return alerts.training_set(labels, t.documents.select("doc_id", "n_chars"), "doc_id")


@register(
    "merge_feature_output",
    "SELECT o_orderkey, o_totalprice, n AS line_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey",
)
def merge_feature_output(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("line_count"))
    return t.orders.select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left")


@register(
    "merge_on_different_keys",
    "SELECT o_orderkey, c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey",
)
def merge_on_different_keys(t):
    out = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return out.select("o_orderkey", "c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"))


@register(
    "semi_join_concerns",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000)",
)
def semi_join_concerns(t):
    ids = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(ids, "c_custkey", "left_semi").select("c_custkey", "c_name")


@register(
    "anti_join_missing_keys",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
)
def anti_join_missing_keys(t):
    data = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return alerts.labels_without_data(t.customer.select("c_custkey", "c_name"), data, "c_custkey")


@register(
    "dictionary_descriptions",
    """
    SELECT p.p_partkey::VARCHAR AS "COLUMN_NAME", coalesce(k.d, p.p_type) AS "DESCRIPTION", coalesce(k.e, 0)::BIGINT AS "EXCLUDE"
    FROM part p LEFT JOIN (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_name END AS d, (p_size % 2)::BIGINT AS e FROM part WHERE p_size < 20) k ON k.p_partkey = p.p_partkey
    """,
)
def dictionary_descriptions(t):
    name = F.col("p_partkey").cast("string").alias("COLUMN_NAME")
    fresh = t.part.select(name, F.col("p_type").alias("DESCRIPTION"), F.lit(0).cast("long").alias("EXCLUDE"))
    known = t.part.where("p_size < 20").select(
        name, F.when(F.col("p_size") > 5, F.col("p_name")).alias("DESCRIPTION"), (F.col("p_size") % 2).cast("long").alias("EXCLUDE")
    )
    return alerts.described_columns(fresh, known)


@register(
    "update_by_join",
    "SELECT o_orderkey, coalesce(p, 0)::BIGINT AS \"ML_Prediction\", coalesce(s, 0) AS \"ML_Risk_Score\" FROM orders LEFT JOIN "
    "(SELECT c_custkey, 1 AS p, round(c_acctbal / 100, 4) AS s FROM customer WHERE c_acctbal > 5000) ON c_custkey = o_orderkey",
)
def update_by_join(t):
    base = t.orders.select("o_orderkey", F.lit(0).cast("long").alias("ML_Prediction"), F.lit(0.0).alias("ML_Risk_Score"))
    scored = t.customer.where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("o_orderkey"), F.lit(1).cast("long").alias("ML_Prediction"),
        F.round(F.col("c_acctbal") / 100, 4).alias("ML_Risk_Score"),
    )
    return alerts.updated_predictions(base, scored, "o_orderkey", ["ML_Prediction", "ML_Risk_Score"])


# Descriptions: the word sets of the documents' first lines would be short; whole
# texts are used.
_WORDS = r"list_filter(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g')), '\s+'), lambda x: x <> '')"

_PAIRS_SQL = f"""
    WITH raw AS (SELECT doc_id::VARCHAR AS k, {_WORDS} AS w FROM documents),
    sig AS (SELECT list_sort(list_distinct(w)) AS tokens, len(w) AS wc, max(k) AS sid FROM raw GROUP BY ALL),
    tok AS (SELECT sid, len(tokens) AS n, unnest(tokens) AS token FROM sig),
    com AS (SELECT a.sid AS a, b.sid AS b, a.n AS na, b.n AS nb, count(*) AS c FROM tok a JOIN tok b ON a.token = b.token AND a.sid > b.sid GROUP BY ALL)
    SELECT a, b, round(c / (na + nb - c), 6) AS similarity FROM com WHERE c / (na + nb - c) >= 0.75
"""


@register("similar_text_pairs", _PAIRS_SQL)
def similar_text_pairs(t):
    out = similarity.similar_pairs(t.documents, "doc_id", "text", 0.75)
    return out.withColumn("similarity", F.round("similarity", 6))


def _groups_sql(limit):
    """The greedy rule one key after another, by recursion over the keys that may claim any; ``limit`` is the least similarity taken."""
    return f"""
    WITH RECURSIVE raw AS (SELECT doc_id::VARCHAR AS k, {_WORDS} AS w FROM documents),
    sig AS (SELECT list_sort(list_distinct(w)) AS tokens, len(w) AS wc, max(k) AS sid, list(k) AS ks FROM raw GROUP BY ALL),
    tok AS (SELECT sid, len(tokens) AS n, wc, unnest(tokens) AS token FROM sig),
    com AS (SELECT a.sid AS a, b.sid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, any_value(a.wc) AS ca, any_value(b.wc) AS cb, count(*) AS c
            FROM tok a JOIN tok b ON a.token = b.token GROUP BY a.sid, b.sid),
    near AS (SELECT a, b, c / (na + nb - c) AS s FROM com WHERE c / (na + nb - c) >= 0.75 AND cb >= ceil(round(ca * 0.75, 9))),
    e AS (SELECT x.k AS a, y.k AS b, s FROM near JOIN (SELECT sid, unnest(ks) AS k FROM sig) x ON x.sid = near.a
          JOIN (SELECT sid, unnest(ks) AS k FROM sig) y ON y.sid = near.b WHERE x.k <> y.k),
    v AS MATERIALIZED (SELECT a AS k, list({{'b': b, 's': s}}) AS found, row_number() OVER (ORDER BY a DESC) AS i FROM e GROUP BY a),
    g AS (
        SELECT 0::BIGINT AS i, NULL::VARCHAR AS k, []::VARCHAR[] AS got, []::VARCHAR[] AS claimed
        UNION ALL
        SELECT i, k, got, list_concat(claimed, got) FROM (
            SELECT i, k, claimed, CASE WHEN len(free) > 0 THEN list_concat([k], list_transform(list_filter(free, lambda f: f.s >= {limit} - 1e-12), lambda f: f.b)) ELSE []::VARCHAR[] END AS got
            FROM (SELECT v.i, v.k, g.claimed, CASE WHEN list_contains(g.claimed, v.k) THEN [] ELSE list_filter(v.found, lambda f: NOT list_contains(g.claimed, f.b)) END AS free
                  FROM g JOIN v ON v.i = g.i + 1))
    ),
    m AS (SELECT k AS similar_key, unnest(got) AS doc_id FROM g)
    SELECT raw.k AS doc_id, m.similar_key FROM raw LEFT JOIN m ON m.doc_id = raw.k
    """


@register("similar_text_groups", _groups_sql("0.75"))
def similar_text_groups(t):
    return similarity.similar_groups(t.documents.select("doc_id", "text"), "doc_id", "text", 0.75)


@register("similar_text_groups_closest", _groups_sql("greatest(0.75, list_max(list_transform(free, lambda x: x.s)))"))
def similar_text_groups_closest(t):
    return similarity.similar_groups(t.documents.select("doc_id", "text"), "doc_id", "text", 0.75, only_max=True)


@register(
    "best_catalogue_title",
    r"""
    WITH term AS (SELECT DISTINCT s AS term FROM (SELECT unnest(string_split_regex(lower(text), '[.,\n]\s*')) AS s FROM benchmark) WHERE s <> ''),
    title AS (SELECT DISTINCT s AS title FROM (SELECT unnest(string_split_regex(lower(text), '[.\n]\s*')) AS s FROM documents) WHERE s <> ''),
    tw AS (SELECT DISTINCT term, unnest(string_split_regex(term, '[^\p{L}\p{N}_]+')) AS w FROM term),
    iw AS (SELECT DISTINCT title, unnest(string_split_regex(title, '[^\p{L}\p{N}_]+')) AS w FROM title),
    c AS (SELECT DISTINCT term, title FROM tw JOIN iw ON tw.w = iw.w WHERE tw.w <> ''),
    tc AS (SELECT term, list_distinct(string_split(term, '')) AS cs FROM term),
    ic AS (SELECT title, list_distinct(string_split(title, '')) AS cs FROM title),
    s AS (SELECT c.term, c.title, len(list_intersect(tc.cs, ic.cs)) AS k, len(tc.cs) + len(ic.cs) AS n, length(c.title) AS l
          FROM c JOIN tc ON tc.term = c.term JOIN ic ON ic.title = c.title)
    SELECT term, round(max(k / (n - k) * l), 2) AS score FROM s GROUP BY term HAVING max(k / (n - k) * l) > 30
    """,
)
def best_catalogue_title(t):
    terms = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[.,\n]\s*")).alias("term")).where("term <> ''")
    titles = t.documents.select(F.explode(F.split(F.lower("text"), r"[.\n]\s*")).alias("title")).where("title <> ''")
    return similarity.best_titles(terms, "term", titles, "title").select("term", "score")


def match_lines(t):
    named = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    item = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("item_id")
    orders = named.select(
        F.col("l_orderkey").alias("po_id"), item, F.col("p_name").alias("item_description"),
        F.col("l_extendedprice").alias("item_amount"), F.col("l_quantity").alias("item_quantity"),
    )
    invoices = named.where("l_returnflag <> 'N'").select(
        (F.col("l_orderkey") + 1000000).alias("invoice_id"), F.col("l_orderkey").alias("po_id"), item,
        F.concat("p_name", F.lit(" "), F.col("p_brand")).alias("item_description"),
        F.round(F.col("l_extendedprice") - F.col("l_discount") * 1000, 2).alias("item_amount"), F.col("l_quantity").alias("item_quantity"),
    )
    return invoices, orders


MATCH_SQL = """
    p AS (SELECT l_orderkey AS po_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS item, p_name AS d, l_extendedprice AS a, l_quantity AS q
      FROM lineitem JOIN part ON p_partkey = l_partkey),
    i AS (SELECT l_orderkey AS po_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS item, p_name || ' ' || p_brand AS d,
      round(l_extendedprice - l_discount * 1000, 2) AS a, l_quantity AS q FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'N'),
    x AS (SELECT i.po_id + 1000000 AS invoice_id, i.po_id, i.item AS item_id_invoice, p.item AS item_id_po,
      round(round((p.a - i.a) / i.a * 100, 10)::DECIMAL(30,10), 2)::DOUBLE AS amount_diff, round(round((p.q - i.q) / i.q * 100, 10)::DECIMAL(30,10), 2)::DOUBLE AS quantity_diff,
      100 - round(100 * (1 - levenshtein(i.d, p.d) / greatest(length(i.d), length(p.d))))::BIGINT AS description_diff
      FROM i JOIN p ON p.po_id = i.po_id)
"""


@register(
    "two_way_scores",
    f"WITH {MATCH_SQL} SELECT *, round(round(abs(amount_diff) * 100) * 0.25::DOUBLE + round(abs(quantity_diff) * 100) * 0.25::DOUBLE + abs(description_diff) * 50.0::DOUBLE) / 100 AS weighted_diff FROM x",
)
def two_way_scores(t):
    out = matching.scored_pairs(*match_lines(t))
    return out.withColumn("description_diff", F.col("description_diff").cast("long"))


@register(
    "two_way_match",
    f"""
    WITH RECURSIVE {MATCH_SQL},
    s AS (SELECT *, round(round(abs(amount_diff) * 100) * 0.25::DOUBLE + round(abs(quantity_diff) * 100) * 0.25::DOUBLE + abs(description_diff) * 50.0::DOUBLE) / 100 AS w FROM x),
    r AS (SELECT *, row_number() OVER (PARTITION BY invoice_id, po_id ORDER BY w, item_id_invoice, item_id_po) AS k FROM s),
    g AS (
        SELECT invoice_id, po_id, k, item_id_invoice, item_id_po, w, [item_id_invoice] AS a, [item_id_po] AS b, true AS hit FROM r WHERE k = 1
        UNION ALL
        SELECT invoice_id, po_id, k, item_id_invoice, item_id_po, w, CASE WHEN free THEN list_append(a, item_id_invoice) ELSE a END,
               CASE WHEN free THEN list_append(b, item_id_po) ELSE b END, free
        FROM (SELECT r.invoice_id, r.po_id, r.k, r.item_id_invoice, r.item_id_po, r.w, g.a, g.b,
                     NOT list_contains(g.a, r.item_id_invoice) AND NOT list_contains(g.b, r.item_id_po) AS free
              FROM g JOIN r ON r.invoice_id = g.invoice_id AND r.po_id = g.po_id AND r.k = g.k + 1)
    )
    SELECT invoice_id, po_id, item_id_invoice, item_id_po, w AS weighted_diff FROM g WHERE hit
    """,
)
def two_way_match(t):
    return matching.two_way_match(*match_lines(t))


@register(
    "line_count_comparison",
    "SELECT l_orderkey + 1000000 AS invoice_id, l_orderkey AS po_id, count_if(l_returnflag <> 'N') AS invoice_lines, count(*) AS po_lines, "
    "count_if(l_returnflag <> 'N') = count(*) AS same_count FROM lineitem GROUP BY l_orderkey HAVING count_if(l_returnflag <> 'N') > 0",
)
def line_count_comparison(t):
    return matching.line_count_comparison(*match_lines(t))


@register(
    "schema_changes",
    """
    WITH o AS (SELECT column_name FROM (DESCRIBE SELECT * FROM documents)), n AS (SELECT column_name FROM (DESCRIBE SELECT * FROM labels))
    SELECT column_name, 'deleted' AS change FROM o WHERE column_name NOT IN (SELECT column_name FROM n)
    UNION ALL SELECT column_name, 'new' FROM n WHERE column_name NOT IN (SELECT column_name FROM o)
    """,
)
def schema_changes(t):
    """Columns that one of two tables has only."""
    return alerts.schema_changes(t.documents, t.labels)
