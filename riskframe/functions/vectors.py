"""Cosine similarity and ranking of given vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.frames import top_per_key


def dot(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column | str) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    size = norm(a)
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def cosine(a: Column | str, b: Column | str) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def semantic_search(
    questions: DataFrame, question_key: str, question: str, columns: DataFrame, key: str, vector: str, k: int
) -> DataFrame:
    """The ``k`` most similar columns of each question.

    A handful of questions is ranked against any number of columns: the questions
    travel as one array to every column row, and each task keeps ``k`` per question.
    """
    packed = questions.agg(F.collect_list(F.struct(question_key, question)).alias("_q")).scalar()
    rows = columns.select(key, vector).withColumn("_q", packed)
    scored = rows.select(key, vector, F.explode("_q").alias("_q")).select(
        F.col("_q")[question_key].alias(question_key), key, cosine(vector, F.col("_q")[question]).alias("score")
    )
    return top_per_key(scored, [question_key], [F.desc("score"), F.col(key)], k)


def search_dictionary(
    questions: DataFrame, question_key: str, question: str, dictionary: DataFrame, vector: str, k: int
) -> DataFrame:
    """``semantic_search`` over a data dictionary: excluded and undescribed columns are left out."""
    usable = dictionary.where(
        (F.coalesce(F.col("EXCLUDE"), F.lit(0)) != 1) & (F.trim(F.coalesce("DESCRIPTION", F.lit(""))) != "")
    )
    return semantic_search(questions, question_key, question, usable, "COLUMN_NAME", vector, k)
