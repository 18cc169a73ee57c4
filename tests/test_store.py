"""Store semantics: partial upsert, latest-wins, delete, append, read-through."""

import datetime as dt

from pyspark.sql import functions as F

from perflog.sources import store as S


def test_upsert_partial(spark):
    ex = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0)], "k int, s string, v double")
    inc = spark.createDataFrame([(1, None), (3, "c"), (None, "n")], "k int, s string")
    out = {r.k: (r.s, r.v) for r in S.upsert_partial(ex, inc, ["k"], ["s"]).collect()}
    assert out[1] == (None, 10.0)      # present column overwrites (null too), absent column kept
    assert out[2] == ("b", 20.0)
    assert out[3] == ("c", None)
    assert out[None] == ("n", None)    # keyless record inserted


def test_upsert_latest_and_delete(spark):
    ex = S.stamp(spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), dt.datetime(2020, 1, 1))
    inc = S.stamp(spark.createDataFrame([(1, 5.0)], "k int, v double"), dt.datetime(2021, 1, 1))
    out = S.upsert_latest(ex, inc, ["k"])
    assert sorted((r.k, r.v) for r in out.collect()) == [(1, 5.0), (2, 2.0)]
    kept = S.delete_where(out, F.col("v") > 3)
    assert [r.k for r in kept.collect()] == [2]
    assert S.count_where(out, F.col("v") > 3) == 1


def test_null_keys_and_ties(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 1.0, 1), (None, 2.0, 1), (1, 5.0, 3), (1, 7.0, 3), (1, 9.0, None)], "k int, v double, n int")
    got = sorted(map(repr, S.newest(df, ["k"], ["n"]).collect()))
    assert got == sorted(map(repr, df.where("k is null or v = 7").collect()))
    for parts in (1, 7):      # the survivor of a tie does not depend on the row order
        assert sorted(map(repr, S.newest(df.repartition(parts), ["k"], ["n"]).collect())) == got
    both = S.upsert_latest(df.where("k = 1"), df.where("k is null"), ["k"], "n")
    assert both.count() == 4
    part = S.upsert_partial(df.where("k is null"), df, ["k"], ["n"])
    assert part.where("k is null").count() == 6 and [r.v for r in part.where("k = 1").collect()] == [7.0]


def test_append_and_read_through(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.range(5).withColumn("season", F.col("id") % 2)

    a = S.read_through(spark, path, build, partition_by=["season"])
    b = S.read_through(spark, path, build)
    assert a.count() == b.count() == 5 and len(calls) == 1
    assert S.read_through(spark, path, build, refresh=True).count() == 5 and len(calls) == 2
    log = str(tmp_path / "log")
    for day in (1, 2):
        S.append(spark.range(3), log, dt.datetime(2024, 1, day))
    stored = spark.read.parquet(log)
    assert stored.count() == 6 and stored.select("updated_at").distinct().count() == 2
    assert S.is_fresh(stored, "updated_at", 1, dt.datetime(2024, 1, 3)) and not S.is_fresh(stored, "updated_at", 1, dt.datetime(2024, 1, 9))
