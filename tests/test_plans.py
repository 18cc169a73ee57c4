"""Plan-shape checks: the physical plans we want at scale."""

import re

import pytest

from perflog.plans.registry import all_queries

SF = "/root/testdata/sf0.001"
#: Queries that fit a model, or read a bound from the data, while they are built.
EAGER = {"rf_team_win", "gbt_season_points", "next_season_forecast", "feature_importance", "retrain_top_features", "recent_window",
         "points_information", "player_game_chain", "next_game_vector", "upsert_stored", "landing_players", "landing_quality",
         "landing_info", "stored_seasons"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    tracker = spark.sparkContext.statusTracker()
    out = {}
    for name, q in all_queries().items():
        if name in EAGER:
            continue
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        df = q.build(spark, SF)
        out[name] = (plan(df), len(tracker.getJobIdsForGroup(f"build-{name}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out


def test_no_jobs_while_a_query_is_built(plans):
    assert {n: j for n, (_, j) in plans.items() if j} == {}


def test_no_python_udfs_anywhere(plans):
    for name, (p, _) in plans.items():
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "InArrow" not in p, name


def test_scans_and_exchanges_are_few(plans):
    for name, (p, _) in plans.items():
        assert p.count("FileScan") <= 8 and p.count("Exchange hashpartitioning") <= 16, (name, p.count("FileScan"), p.count("Exchange hashpartitioning"))


def test_windows_in_pieces_scan_twice(plans):
    for name in ("recent_form", "rolling_mean_std", "win_pct", "momentum", "streak_current", "streak_entering"):
        assert plans[name][0].count("FileScan") <= 2, name


def test_no_single_partition_windows(plans):
    for name in ("recent_form", "rolling_mean_std", "ema", "team_win_set", "zscore"):
        assert "SinglePartition" not in plans[name][0], name


#: Queries whose entity windows are bounded: the newest rows of an entity pass a group limit before they move, seasons are aggregates.
BOUNDED = {"last_n", "season_lag_features", "season_trend", "latest_season", "next_season_row"}


def test_no_window_over_a_whole_entity(spark):
    """Ordered windows run by chunk, bucket, range or run of an entity, so a hot entity is many tasks."""
    def specs(p):
        children = p.children()
        own = [p.partitionSpec().mkString(",")] if p.nodeName() == "Window" else []
        return own + [x for i in range(children.size()) for x in specs(children.apply(i))]

    for name, q in all_queries().items():
        if name in EAGER | BOUNDED:
            continue
        for spec in specs(q.build(spark, SF)._jdf.queryExecution().optimizedPlan()):
            assert not re.fullmatch(r"(l_suppkey|o_custkey|user_id)#\d+L?", spec), (name, spec)


def test_recent_window_pushes_filter(spark):
    df = all_queries()["recent_window"].build(spark, SF)
    p = df._jdf.queryExecution().sparkPlan().toString()
    assert "GreaterThanOrEqual(ts" in p


def test_scan_prunes_columns(spark):
    p = all_queries()["delete_where"].build(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "o_orderdate" not in p.split("ReadSchema:")[1].split("\n")[0]


def test_fast_rounding_is_the_decimal_rounding(spark):
    from pyspark.sql import functions as F

    from perflog.plans.sqlbits import r4
    vals = [0.0, -0.0, 1.23455, -1.23455, 0.00005, 2.5e-9, 0.000049999995, 123.45675, 99999.99995, 1e5, 1e12, 1 / 3, -2 / 3, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert df.where(~r4("x").eqNullSafe(F.round(F.col("x").cast("decimal(38,8)"), 4).cast("double"))).count() == 0


def test_clean_logs_move_rows_to_chunks_and_buckets_only(plans):
    """entity means come with the table of chunks; no rows are dealt or joined by the entity's column."""
    for name in ("team_log_clean", "player_log_clean"):
        p = plans[name][0]
        assert not re.search(r"(hashpartitioning|Join )\(?\[?(coalesce\()?l_suppkey", p), p
        assert p.count("Exchange hashpartitioning") <= 6 and p.count("Join ") <= 2, p


def test_statistics_of_entities_come_with_the_numbers(spark):
    from pyspark.sql import functions as F

    from perflog.operators.split import numbered
    from perflog.spec import LogSpec
    # an entity without values, a null entity, null times and repeated rows, in many chunks
    df = spark.range(400).select(
        F.when(F.col("id") % 4 < 3, F.col("id") % 4).alias("e"), F.col("id").alias("k"),
        F.when(F.col("id") % 11 > 0, F.timestamp_add("DAY", F.col("id") * 3, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))).alias("t"),
        F.when((F.col("id") % 4 != 1) & (F.col("id") % 5 > 0), F.col("id") % 13).alias("x"), F.lit("W").alias("r"))
    df = df.unionByName(df.where("k < 20"))
    want = {r.e: (r.m, r.n) for r in df.groupBy("e").agg(F.sum("x").alias("m"), F.count(F.lit(1)).alias("n")).collect()}
    for result in (None, "r"):
        rows = numbered(df, LogSpec(entity="e", time="t", tie=("k",)), result, stats={"m": F.sum("x"), "n": F.count(F.lit(1))}).collect()
        assert len(rows) == 420 and all(want[r.e] == (r.m, r.n) for r in rows)
        assert all(sorted(r["__rn"] for r in rows if r.e == e) == list(range(1, n + 1)) for e, (_, n) in want.items())


def test_plain_dates_are_read_by_a_cast_as_by_the_formats(spark):
    """no format that fails is tried for texts of the usual form, and the result is the formats'."""
    from pyspark.sql import functions as F

    from perflog.functions import parsing as P
    texts = ["2024-01-02T03:04:05", "2024-01-02t23:59:59", " 2024-02-29 03:04:05 ", "2024-01-02", "2023-02-29", "2023-02-29 01:02:03", "2024-13-01",
             "2024-01-02 24:00:00", "2024-01-02 23:59:60", "9999-12-31 00:00:00", "0000-01-01", "2024-1-2", "2024-01-02\n", "2024-01-02 03:04", "2024-01-02  03:04:05",
             "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "Apr 14, 2024", "APR 4, 2024", "01/02/2024", "20240102", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    slow = P.parse_date("s", (*P.DATE_FORMATS, P.DATE_FORMATS[0]))     # a list of its own is read by formats only
    both = df.select("s", P.parse_date("s").alias("a"), slow.alias("b"))
    assert both.dtypes[1][1] == both.dtypes[2][1] == "timestamp_ntz"
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).select("s").collect() == []
    assert "rlike" in str(P.parse_date(F.col("s"))).lower() and "rlike" not in str(slow).lower()
