"""Session settings and the few cluster-level helpers every module shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs for skewed keys and oracle-stable timestamps.  Sizes
# (executors, shuffle partitions, memory) belong to the cluster, not to us.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_LOCAL_FOLDERS: dict[str, str | None] = {}


def local_session(cpus: int | str = "*", app: str = "riskframe", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.maxResultSize", "2g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = _LOCAL_FOLDERS.setdefault(sc.applicationId, None) or tempfile.mkdtemp(prefix="riskframe-shared-")
        _LOCAL_FOLDERS[sc.applicationId] = folder
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder once and go on from the written table.

    Cuts the lineage, survives lost executors, and gives the planner real sizes.
    """
    path = f"{shared_folder(df.sparkSession)}/riskframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
