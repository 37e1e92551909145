"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII texts take the fast built-in, which does the same there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def in_fold(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls in one fold; a null key is in none."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def source_key(column: str) -> Column:
    """A join key that is never null and keeps null apart from every text."""
    return F.when(F.col(column).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(column).cast("string")))


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """The rows with the ``n`` smallest distinct values of their column ``_h``, one row each.

    Only hashes are ranked, so tasks send numbers, not rows, before the cut is known.
    """
    cut = rows.select("_h").distinct().orderBy("_h").limit(n).agg(F.max("_h")).first()[0]
    return rows.where(F.col("_h") <= F.lit(cut)).dropDuplicates(["_h"])


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: ``(node, root)`` for each node with an edge, root the smallest node.

    ``edges`` has two columns ``a`` and ``b``.  Alternates two star steps, each of which joins every node to the least
    node it sees; rounds grow with the logarithm of the component size.  Every round is written to the shared folder,
    and only a count and a checksum reach the driver.
    """
    stars = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _checksum(stars)
    while mark[0]:
        stars = durable(_small_star(_large_star(stars)))
        mark, before = _checksum(stars), mark
        if mark == before:
            break
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots).distinct()


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
    return tuple(row)


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    # Every larger neighbour moves to the least node seen from here.
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("a").agg(F.min("b").alias("low"))
    moved = stars.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()




class Shared:
    """A model, broadcast with its class: executors need not have this package.

    Spark pickles what it broadcasts by the name of its class.  Here it gets bytes, in which the class travels by value;
    a worker unpacks them once and keeps the model, and what is built from it, with the broadcast for its next tasks.
    """

    def __init__(self, spark: SparkSession, model):
        self._data = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    @property
    def value(self):
        return self.built(None)

    def built(self, kind):
        """What ``kind`` makes of the model, made once."""
        kept = self._data.__dict__.setdefault("_kept", {})
        name = kind and kind.__name__
        if name not in kept:
            kept[name] = kind(self.value) if kind else pickle.loads(self._data.value)
        return kept[name]
