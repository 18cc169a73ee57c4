"""Streaming ingest: a landing folder streamed through foreachBatch upserts."""

from pyspark.sql import functions as F

from perflog.sources.tables import DRIVER_SCHEMAS
from perflog.streaming.ingest import ingest_stream, read_latest, recent_window_stream


def test_ingest_events(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    landing, path = str(tmp_path / "landing"), str(tmp_path / "store")
    src.repartition(3).write.parquet(landing)          # three files -> several micro-batches
    args = (spark, landing, DRIVER_SCHEMAS["events"], path, ["event_id"])
    ingest_stream(*args, max_files_per_trigger=1).awaitTermination(300)
    assert read_latest(spark, path, ["event_id"]).count() == src.count()
    # a restarted stream resumes: only the new file is read, and its version wins
    src.limit(10).withColumn("value", F.lit(-1.0)).write.mode("append").parquet(landing)
    ingest_stream(*args).awaitTermination(300)
    got = read_latest(spark, path, ["event_id"])
    assert got.count() == src.count() and got.where("value = -1").count() == 10
    assert spark.read.parquet(path).count() == src.count() + 10


def test_recent_window_counts(spark, tmp_path):
    landing = str(tmp_path / "landing")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(landing)
    q = (recent_window_stream(spark, landing, DRIVER_SCHEMAS["events"], "ts", "user_id", "1 day").writeStream
         .format("memory").queryName("recent").outputMode("complete").trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.awaitTermination(300)
    assert spark.table("recent").agg(F.sum("rows")).first()[0] == spark.read.parquet(landing).where("ts is not null").count()
