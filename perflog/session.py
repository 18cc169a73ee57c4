"""Session helpers: local sessions for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "perflog", extra: dict | None = None) -> SparkSession:
    """A local session configured the way a cluster job would be, minus the cluster.

    AQE stays on (coalescing tiny shuffle partitions, splitting skewed join
    partitions), the UI stays off, the session time zone is pinned to UTC so
    results do not depend on the host.
    """
    n = os.cpu_count() if cpus == "*" else int(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PERFLOG_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def for_wide_rows(spark: SparkSession) -> SparkSession:
    """Let plans with dozens of columns be compiled: the JVM interprets a generated method of more than 8000 bytes for good, so Spark is told
    to run such a stage operator by operator, whose code it cuts into short methods.  Results are the same."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > 8000:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and stage tables.

    This is what ``spark.checkpoint.dir`` names, or the folder set on the context.
    There is no other: a machine-local folder would be lost with its machine.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def cut_lineage(df):
    """``df`` written as a compressed table into the shared checkpoint folder (never a local one) and read back: its lineage
    ends here.  A checkpoint would keep the rows uncompressed, at several times the size."""
    path = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
