"""A training-data pipeline: language, exact copies, near copies, mixture, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept.  ``run`` writes every stage
but the last to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import exact, langid, mixing, pieces, simhash
from riskframe.llm.queries import PIECES
from riskframe.session import durable

#: Least posterior probability of a language; texts without a letter have none.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model learns from all documents that name theirs."""
    return langid.known_languages(docs, langid.fit_languages(docs), least=LEAST_SCORE)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return exact.distinct_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles link within 3 bits: the smallest doc_id."""
    return simhash.one_of_each_group(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it."""
    return mixing.sample_mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's whole text, and whether they decode to it; extra columns of the documents are not returned."""
    both = pieces.round_trip_column(spark, pieces.read_vocabulary(PIECES), F.col("text"))
    out = docs.select("doc_id", "lang", "source", both.alias("_out"))
    return out.selectExpr("doc_id", "lang", "source", "_out.ids", "coalesce(size(_out.ids), 0) AS n_tokens", "_out.same")


STAGES = [
    ("language ID", language), ("exact dedup", exact_copies), ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture), ("SentencePiece encoding and decoding", token_ids),
]

# Naive Bayes sums, 64-bit hashes of shingles and Viterbi are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
