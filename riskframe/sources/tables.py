"""Relational tables over JDBC: partitioned reads, overwriting writes.

Reads are split over executors by ranges of a numeric key; the driver only learns
the key's bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FETCH_ROWS = 150_000
WRITE_ROWS = 1_000
DEMO_ROWS = 1_000


def jdbc_options(url: str, **extra: object) -> dict[str, str]:
    return {"url": url, "fetchsize": str(FETCH_ROWS), **{k: str(v) for k, v in extra.items()}}


def read_query(spark: SparkSession, url: str, query: str, **options: object) -> DataFrame:
    """Rows of one SQL query, run by the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, query=query, **options)).load()


def read_table(
    spark: SparkSession, url: str, table: str, key: str | None = None, partitions: int = 1, **options: object
) -> DataFrame:
    """A whole table; with a numeric ``key`` it is read in ``partitions`` ranges."""
    extra: dict[str, object] = dict(options, dbtable=table)
    if key is not None and partitions > 1:
        low, high = read_query(spark, url, f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}", **options).first()
        if low is not None:
            extra.update(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions)
    return spark.read.format("jdbc").options(**jdbc_options(url, **extra)).load()


def overwrite_table(df: DataFrame, url: str, table: str, **options: object) -> None:
    (
        df.write.format("jdbc")
        .options(**jdbc_options(url, dbtable=table, batchsize=WRITE_ROWS, **options))
        .mode("overwrite")
        .save()
    )


def demo_sample(df: DataFrame, key: str, rows: int = DEMO_ROWS) -> DataFrame:
    """First rows by key: a top-k that keeps ``rows`` per task, not a full sort."""
    return df.orderBy(key).limit(rows)


def row_count(df: DataFrame, table: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(table).alias("table_name"), "row_count")
