"""Incremental ingest of raw logs with Structured Streaming (re-aim of the
reference's refresh pattern: fetch new rows, stamp them, upsert, read through).

A file stream over a landing folder feeds ``foreachBatch``: each micro-batch is
cleaned, stamped with its epoch and appended to a partition of its own
(``_epoch=<n>``), which a replayed epoch overwrites -- so a batch costs its own
rows and never rewrites stored ones.  Reading takes the newest version of each
key.  The stream checkpoint lives in the shared checkpoint folder, so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from perflog.operators.ranking import dedup_latest
from perflog.session import checkpoint_dir


def ingest_stream(spark: SparkSession, landing: str, schema: str, path: str, keys: list[str],
                  clean: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet",
                  available_now: bool = True, max_files_per_trigger: int | None = None,
                  checkpoint: str | None = None) -> StreamingQuery:
    """Stream ``landing`` into the table at ``path``; one version per key and epoch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(landing)

    def store(batch: DataFrame, epoch: int) -> None:
        b = (clean(batch) if clean else batch).withColumn("_epoch", F.lit(epoch).cast("long"))
        dedup_latest(b, keys, "_epoch").drop("_epoch").write.mode("overwrite").parquet(f"{path}/_epoch={epoch}")

    where = checkpoint or f"{checkpoint_dir(spark)}/streams/{path.strip('/').replace('/', '_')}"
    w = stream.writeStream.foreachBatch(store).option("checkpointLocation", where)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The stored table with the newest version of each key."""
    return dedup_latest(spark.read.parquet(path), keys, "_epoch")


def recent_window_stream(spark: SparkSession, landing: str, schema: str, time_col: str, entity: str,
                         window: str = "7 days", watermark: str = "1 day") -> DataFrame:
    """Rolling activity per entity over event-time windows, late rows bounded
    by a watermark (streaming form of the recent-window read).  Event times without
    a zone are read in the session's, as watermarks need instants."""
    s = spark.readStream.schema(schema).parquet(landing).withColumn(time_col, F.col(time_col).cast("timestamp"))
    return (s.withWatermark(time_col, watermark)
             .groupBy(entity, F.window(time_col, window, "1 day"))
             .agg(F.count(F.lit(1)).alias("rows")))
