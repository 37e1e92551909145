"""Parquet, CSV, text and JSON files, and the report sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    df.write.mode(mode).option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def monitoring_history(log: DataFrame, instance: str, submodule: str) -> DataFrame:
    """Runs of one instance and submodule; partition columns prune the scan."""
    return log.where((F.col("instance_id") == instance) & (F.col("submodule") == submodule))


def read_csv_named(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """CSV whose columns are forced to the given names, all read as text."""
    schema = ", ".join(f"`{c}` STRING" for c in columns)
    # multiLine would stop Spark from splitting a file, so it stays off.
    return spark.read.schema(schema).option("header", header).option("enforceSchema", "true").csv(path)


def read_word_counts(spark: SparkSession, path: str, more_than: int = 100) -> DataFrame:
    """Lines ``word,count`` with a count above the limit."""
    return spark.read.schema("word STRING, count BIGINT").csv(path).where(F.col("count") > more_than)


def read_json_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def flatten_items(df: DataFrame, items: str, header: Sequence[str]) -> DataFrame:
    """One row per nested item, header fields repeated on each."""
    return df.select(*header, F.inline(items))


def parse_json(col: Column | str, schema: str) -> Column:
    return F.from_json(col, schema)


def json_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))


def with_report_columns(df: DataFrame, client: str, project: str, instance: str) -> DataFrame:
    """Client, project and instance in front of a report's own columns."""
    tags = {"Client": client, "Project": project, "Instance": instance}
    return df.select(*[F.lit(v).alias(k) for k, v in tags.items()], *df.columns)


def write_report(
    frames: Mapping[str, DataFrame], folder: str, client: str, project: str, instance: str, fmt: str = "csv"
) -> None:
    """One dataset per report below ``folder``."""
    for name, df in frames.items():
        tagged = with_report_columns(df, client, project, instance)
        tagged.write.mode("overwrite").format(fmt).option("header", True).save(f"{folder}/{name}")


def with_run_columns(df: DataFrame, run_time: str, model: str, experiment: str) -> DataFrame:
    """Stamp a scored batch with its run."""
    return df.withColumns(
        {
            "Prediction_DateTime": F.lit(run_time).cast("timestamp"),
            "Model_Name": F.lit(model),
            "Experiment_Name": F.lit(experiment),
        }
    )


def append_scored(df: DataFrame, path: str, run_time: str, model: str, experiment: str) -> None:
    write_parquet(with_run_columns(df, run_time, model, experiment), path, mode="append")


def probability_sample(df: DataFrame, key: str, probability: str, intervals: int = 9) -> DataFrame:
    """The lowest-probability row of each of ``intervals`` equal closed intervals.

    One aggregate finds all of them; a row standing in two intervals (a shared
    edge) is reported once.
    """
    bounds = df.agg(F.min(probability).alias("_lo"), F.max(probability).alias("_hi"))
    from riskframe.frames import with_scalars

    rows = with_scalars(df.select(key, probability), bounds)
    width = (F.col("_hi") - F.col("_lo")) / intervals
    picks = []
    for i in range(intervals):
        low = F.col("_lo") + width * i
        high = F.col("_hi") if i == intervals - 1 else F.col("_lo") + width * (i + 1)
        row = F.struct(F.col(probability).alias("p"), F.col(key).alias("k"))
        picks.append(F.min(F.when(F.col(probability).between(low, high), row)).alias(f"r{i}"))
    found = rows.agg(*picks).select(F.explode(F.array(*[f"r{i}" for i in range(intervals)])).alias("r"))
    return (
        found.where(F.col("r").isNotNull())
        .select(F.col("r")["k"].alias(key), F.round(F.col("r")["p"], 2).alias(probability))
        .distinct()
    )
