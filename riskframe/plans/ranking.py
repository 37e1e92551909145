"""Sort, top-k and set operations."""

from pyspark.sql import functions as F

from riskframe.frames import top_per_key
from riskframe.functions.vectors import cosine, search_dictionary, semantic_search
from riskframe.operators import alerts
from riskframe.plans.catalogue import register


@register(
    "sort_by_score",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
)
def sort_by_score(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@register(
    "cosine_similarity",
    f"SELECT a.vec_id, round({_COSINE}, 5) AS similarity FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b",
)
def cosine_similarity(t):
    """Every vector against the first one."""
    first = t.embeddings.orderBy("vec_id").limit(1).select("embedding").scalar()
    rows = t.embeddings.withColumn("_q", first)
    return rows.select("vec_id", F.round(cosine("embedding", "_q"), 5).alias("similarity"))


@register(
    "top_columns_by_similarity",
    f"""
    SELECT query, vec_id, round(s, 5) AS score FROM (
      SELECT b.query, a.vec_id, {_COSINE} AS s, row_number() OVER (PARTITION BY b.query ORDER BY {_COSINE} DESC, a.vec_id) AS rn
      FROM embeddings a, (SELECT label::BIGINT AS query, embedding FROM
        (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k = 1) b)
    WHERE rn <= 5
    """,
)
def top_columns_by_similarity(t):
    """One question per label (its first vector); the five most similar columns of each."""
    questions = top_per_key(t.embeddings, ["label"], [F.col("vec_id")]).select(
        F.col("label").cast("long").alias("query"), F.col("embedding").alias("question")
    )
    out = semantic_search(questions, "query", "question", t.embeddings, "vec_id", "embedding", 5)
    return out.withColumn("score", F.round("score", 5))


@register(
    "dictionary_search",
    f"""
    SELECT query, COLUMN_NAME, round(s, 5) AS score FROM (
      SELECT b.query, a.vec_id AS COLUMN_NAME, {_COSINE} AS s, row_number() OVER (PARTITION BY b.query ORDER BY {_COSINE} DESC, a.vec_id) AS rn
      FROM (SELECT * FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0) a, (SELECT label::BIGINT AS query, embedding FROM
        (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k = 1) b)
    WHERE rn <= 5
    """,
)
def dictionary_search(t):
    """As above over a dictionary, where every seventh column is excluded and every fifth has a blank description."""
    questions = top_per_key(t.embeddings, ["label"], [F.col("vec_id")]).select(
        F.col("label").cast("long").alias("query"), F.col("embedding").alias("question")
    )
    dictionary = t.embeddings.select(
        F.col("vec_id").alias("COLUMN_NAME"), "embedding", F.when(F.col("vec_id") % 7 == 0, 1).alias("EXCLUDE"),
        F.when(F.col("vec_id") % 5 == 0, " ").otherwise("described").alias("DESCRIPTION"),
    )
    out = search_dictionary(questions, "query", "question", dictionary, "embedding", 5)
    return out.withColumn("score", F.round("score", 5))


@register(
    "best_match_per_group",
    "SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1",
)
def best_match_per_group(t):
    rows = t.part.select("p_brand", "p_partkey", "p_retailprice")
    return top_per_key(rows, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")])


@register(
    "live_and_archived",
    "SELECT DISTINCT o_orderkey, o_custkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT * FROM orders WHERE o_totalprice > 100000)",
)
def live_and_archived(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    live = rows.where("o_orderstatus <> 'F'").drop("o_totalprice")
    return alerts.live_and_archived(live, rows.where("o_totalprice > 100000").drop("o_totalprice"))


@register(
    "union_on_common_columns",
    "SELECT o_orderkey AS key, o_totalprice AS amount FROM orders UNION ALL SELECT l_orderkey, l_extendedprice FROM lineitem",
)
def union_on_common_columns(t):
    a = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"), "o_orderstatus")
    b = t.lineitem.select(F.col("l_orderkey").alias("key"), F.col("l_extendedprice").alias("amount"), "l_tax")
    return alerts.union_on_common_columns(a, b)
