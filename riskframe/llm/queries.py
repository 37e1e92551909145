"""One query per operator, over the whole of its table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import ann, embed_dups, exact, katz, langid, mixing, periodic, pieces, pii, simhash, tokens, urls, whitening
from riskframe.llm.common import in_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op6_mixing": mixing.SQL, "op7_exact_dedup": exact.SQL, "op8_url_filter": urls.SQL}


#: A public vocabulary; never copied into the repository.
PIECES = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_language_id(spark, folder):
    """Learns from three folds of four; the fourth is held out."""
    docs, held = _table(spark, folder, "documents"), in_fold("doc_id", 4, 2)
    model = langid.fit_languages(docs, train=~held)
    return langid.with_language(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


@_query
def op2_nearest(spark, folder):
    """Every twentieth vector against all others."""
    return ann.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@_query
def op3_token_counts(spark, folder):
    return tokens.token_counts(_table(spark, folder, "documents"), pieces.read_vocabulary(PIECES))


@_query
def op4_sentencepiece(spark, folder):
    return pieces.round_trip(_table(spark, folder, "documents"), pieces.read_vocabulary(PIECES))


@_query
def op5_simhash(spark, folder):
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op6_mixing(spark, folder):
    out = mixing.mixed(_table(spark, folder, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op7_exact_dedup(spark, folder):
    return exact.exact_groups(_table(spark, folder, "documents"))


@_query
def op8_url_filter(spark, folder):
    return urls.url_verdicts(_table(spark, folder, "pages"), urls.rule_table(spark))


@_query
def op9_personal_data(spark, folder):
    docs = _table(spark, folder, "documents")
    return pii.personal_data(docs, pii.fit_tagger(docs))


@_query
def op10_katz(spark, folder):
    """Learns from four folds of five; the fifth is held out."""
    out = katz.katz_scores(_table(spark, folder, "documents"), ~in_fold("doc_id", 5, 1))
    return out.withColumn("held_out", ~F.col("trained")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query
def op11_near_vectors(spark, folder):
    return embed_dups.near_vectors(_table(spark, folder, "embeddings"))


@_query
def op12_whitening(spark, folder):
    return whitening.whiten(_table(spark, folder, "embeddings"))


@_query
def op13_periodic_runs(spark, folder):
    """Runs of every text, one in ten of which gets a periodic tail first."""
    return periodic.run_digests(periodic.repeated_tails(_table(spark, folder, "documents")))
