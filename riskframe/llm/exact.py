"""Exact deduplication by content, safe when one text holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import ascii_lower, source_key
from riskframe.session import durable


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty.  The largest key of a group
    stays.  A null key never wins against another; a group of null keys only keeps null.  Repeated rows of one key are
    one document: they count in ``group_size`` and are all marked alike (``distinct_documents`` keeps one of them).

    Copies are combined three times, by their whole content each time: within a map task, within a salt, which is the
    map task's number modulo ``salts``, and over the salts.  So a text that a third of all rows share leaves each map task
    once, and reaches the last task once per salt.  Results do not depend on the salts.  Rows then find
    their group by digest, length and a second hash, in a join that adaptive execution splits where a group is large.
    """
    rows = docs.select(F.col(key).alias("_key"), ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_text"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2("_text", 256)))
    salted = rows.withColumn("_salt", F.spark_partition_id() % salts)
    merged = salted.groupBy("_digest", "_text", "_salt").agg(F.max("_key").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = merged.groupBy("_digest", "_text").agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    by = ["_digest", "_length", "_check"]
    identity = [F.col("_digest"), F.octet_length("_text").alias("_length"), F.xxhash64("_text").alias("_check")]
    groups = durable(groups.select(*identity, "keep_id", "group_size"))
    found = rows.select("_key", *identity).join(groups, by)
    return found.select(
        F.col("_key").alias(key), "keep_id", "group_size", F.col("_key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns unchanged; of repeated rows of one key, one stays."""
    stay = exact_groups(docs, key, text, salts).where("kept")
    stay = durable(stay.select(source_key(key).alias("_key"), F.col("text_sha256").alias("_sha")).distinct())
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), 256)
    # Whole rows travel as one column, so no name of theirs can clash.
    named = docs.select(source_key(key).alias("_key"), sha.alias("_sha"), F.struct("*").alias("_row"))
    kept = named.join(stay, ["_key", "_sha"], "left_semi")
    return kept.groupBy("_key", "_sha").agg(F.first("_row").alias("_row")).select("_row.*")


SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
