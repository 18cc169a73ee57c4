"""Golden micro-fixtures (FIXTURES.md part 3) and edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from perflog.functions import calendar as cal
from perflog.functions import parsing as P
from perflog.functions import predict as PR
from perflog.functions import ratios as R
from perflog.operators import clean as C
from perflog.operators import windows as Wn
from perflog.operators.seasons import season_lag_features
from perflog.spec import LogSpec

S = LogSpec(entity="e", time="t", tie=("k",))


def series(spark, values, dtype="double"):
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"e int, t timestamp_ntz, k int, x {dtype}")


def col(df, c):
    return [r[c] for r in df.orderBy("k").select(c).collect()]


def approx(a, b):
    return all((x is None and y is None) or (x is not None and y is not None and abs(x - y) < 1e-9)
               for x, y in zip(a, b)) and len(a) == len(b)


def ewm3(spark, values):
    df = series(spark, values)
    both = Wn.ewm(df, "x", {"y": 3}, S).withColumn("z", Wn.ewm_fold("x", 3, S))
    both = Wn.carry_forward(both, ["z"], S)
    assert approx(col(both, "y"), col(both, "z"))
    return col(both, "y")


def test_ewm_null_inside(spark):
    assert approx(ewm3(spark, [1.0, None, 4.0, 2.0]), [1, 1, 3.4, 2.5384615384615383])


def test_ewm_leading_null(spark):
    assert approx(ewm3(spark, [None, 1.0]), [None, 1.0])


def test_ewm_long_null_run_carries(spark):
    assert approx(ewm3(spark, [5.0] + [None] * 80), [5.0] * 81)


def test_ewm_over_many_buckets(spark):
    """Linear in the rows of one entity, whose buckets carry on from each other."""
    import random
    import pandas as pd
    rng = random.Random(1)
    values = [None if rng.random() < 0.1 else rng.random() for _ in range(3000)]
    want = pd.Series(values, dtype=float).ewm(span=10).mean()
    got = col(Wn.ewm(series(spark, values), "x", {"y": 10, "w": 3}, S, 86400 * 500), "y")
    assert approx(got, [None if pd.isna(x) else x for x in want])


def test_rolling_mean_null_inside(spark):
    df = series(spark, [1.0, None, 3.0, 4.0, 5.0]).withColumn("y", Wn.rolling_mean("x", 3, S))
    assert approx(col(df, "y"), [None, None, None, None, 4.0])


def test_expanding_mean(spark):
    df = series(spark, [1.0, None, 3.0]).withColumn("y", Wn.expanding_mean("x", S))
    assert approx(col(df, "y"), [1.0, 1.0, 2.0])


def test_entering_streak(spark):
    df = Wn.entering_streaks(series(spark, [1, 1, 0, 0, 1], "int"), "x", S, "w", "l")
    assert col(df, "w") == [0, 1, 2, 0, 0] and col(df, "l") == [0, 0, 0, 1, 2]


def test_current_streak(spark):
    df = Wn.current_streaks(series(spark, ["W", "W", "L", "W"], "string"), "x", S, win_out="w", loss_out="l")
    assert col(df, "w") == [1, 2, 0, 1] and col(df, "l") == [0, 0, 1, 0]


def test_current_streak_nulls_equal(spark):
    df = Wn.current_streaks(series(spark, [None, None, "W", "W"], "string"), "x", S, win_out="w", loss_out="l")
    assert col(df, "w") == [0, 0, 1, 2]


def test_whole_day_gap(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 12), 0), (1, dt.datetime(2024, 1, 2, 6), 1)]
    df = spark.createDataFrame(rows, "e int, t timestamp_ntz, k int").withColumn("d", Wn.days_rest(S))
    assert col(df, "d") == [3, 0]


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "e int, s string")
    out = C.fill_mode(df, ["s"], by=["e"])
    assert sorted(r.s for r in out.collect()) == ["a", "a", "b"]


def test_mode_all_null_unknown(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "e int, s string")
    assert {r.s for r in C.fill_mode(df, ["s"], by=["e"]).collect()} == {"Unknown"}


def test_minutes(spark):
    df = spark.createDataFrame([("12:30",), ("12",), (" ",), ("12m",), (None,)], "m string")
    out = df.select(P.minutes("m").alias("a"), P.minutes_or_zero("m").alias("b")).collect()
    assert [r.a for r in out] == [12.5, 12.0, None, 12.0, None]
    assert [r.b for r in out] == [12.5, 12.0, 0.0, 0.0, 0.0]


def test_matchup(spark):
    df = spark.createDataFrame([("AAA vs. BBB",), ("AAA @ BBB",), (None,)], "m string")
    out = df.select(P.is_home("m").alias("h"), P.opponent("m").alias("o")).collect()
    assert [r.h for r in out] == [1, 0, 0] and [r.o for r in out] == ["BBB", "BBB", None]


def test_ratios(spark):
    df = spark.createDataFrame([(20.0, 10.0, 0.0, 6.0, 2.0), (0.0, 0.0, 0.0, 6.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0)],
                               "pts double, fga double, fta double, ast double, tov double")
    out = df.select(R.true_shooting("pts", "fga", "fta", "null").alias("a"),
                    R.true_shooting("pts", "fga", "fta", "zero").alias("b"),
                    R.ast_to_tov("ast", "tov").alias("c")).collect()
    assert [r.a for r in out] == [1.0, None, None]
    assert [r.b for r in out] == [1.0, 0.0, 0.0]
    assert [r.c for r in out] == [3.0, 6.0, None]


def test_rest_bucket(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (4,)], "d int")
    assert [r.b for r in df.select(cal.rest_flags(F.col("d"))["rest_bucket"].alias("b")).collect()] == \
        ["none", "short", "normal", "extended"]


def test_season_trend_and_two_year_mean(spark):
    df = spark.createDataFrame([(1, "2020-21", 10.0, 1), (1, "2021-22", 14.0, 1), (1, "2022-23", 13.0, 1)],
                               "e int, s string, PTS double, GAMES_PLAYED int")
    out = season_lag_features(df, "e", "s", ["PTS"], "PTS").orderBy("s").collect()
    assert [r.SEASON_TREND for r in out] == [0.0, 4.0]
    assert [r.PREV_PTS_2YR_AVG for r in out] == [10.0, 12.0]
    assert [r.AGE for r in out] == [21, 22]


def test_adjusted_prediction(spark):
    df = spark.createDataFrame([(20.0, 36.0, "PTS")], "raw double, m double, stat string")
    role, _ = PR.role_context(F.col("stat"))
    df = df.withColumn("f", PR.adjustment_factors("m", role, "stat"))
    r = df.select(PR.adjusted_value("raw", F.col("f"), F.lit(True)).alias("v"),
                  PR.prediction_interval("raw").alias("ci"), "f",
                  PR.confidence_label("raw").alias("c")).first()
    assert r.v == 23.0 and (r.ci.low, r.ci.high) == (17.0, 23.0) and r.c == "high"
    assert r.f == {"high_minutes": 0.1, "scorer_bonus": 0.05}


def test_feature_category(spark):
    df = spark.createDataFrame([("OPP_PTS_AVG_5",), ("DAYS_REST",), ("MIN",)], "n string")
    assert [r.c for r in df.select(PR.feature_category("n").alias("c")).collect()] == ["Average", "Rest", "Other"]


def test_season_labels(spark):
    df = spark.createDataFrame([("22023", dt.date(2023, 10, 5)), ("2023", dt.date(2024, 1, 5))], "i string, d date")
    out = df.select(cal.season_label_from_id("i").alias("a"), cal.season_label_from_id("i", "reference").alias("b"),
                    cal.season_label_from_date("d").alias("c")).collect()
    assert [r.a for r in out] == ["2023-24", "2023-24"]
    assert [r.b for r in out] == ["2202-03", "2023-24"]
    assert [r.c for r in out] == ["2023-24", "2023-24"]


@pytest.mark.parametrize("n", [1, 3])
def test_short_entity_fixed_schema(spark, n):
    df = series(spark, [1.0] * n).withColumn("r", Wn.rolling_mean("x", 3, S))
    df = Wn.zscore(df, ["x"], S)
    assert set(df.columns) >= {"r", "x_ZSCORE"}
    assert col(df, "x_ZSCORE") == [None] * n          # constant measure: std 0 -> null
    assert col(df, "r")[-1] == (1.0 if n >= 3 else None)


# ------------------------------------------------------------------ windows in pieces
def pieces_case(spark):
    """Entities of many sizes and a null one, null times, ties, and hours around clock changes."""
    import random
    rng = random.Random(3)
    rows, k = [], 0
    for e in (1, 2, 3, None):
        for i in range(rng.choice([1, 5, 60])):
            t = None if rng.random() < 0.2 else dt.datetime(2024, 3, 9, 22) + dt.timedelta(hours=rng.randrange(0, 60) // 2)
            rows.append((e, t, k, rng.choice([None, 1.0, 2.0, 5.0]), rng.choice(["W", "L", "L", None])))
            k += 1
    return spark.createDataFrame(rows, "e int, t timestamp_ntz, k int, x double, r string")


def plain_windows(df):
    df = df.withColumns({"n": Wn.game_number(S), "m": Wn.rolling_mean("x", 3, S), "p": Wn.prior_mean("x", 2, S),
                         "d": Wn.days_rest(S), "g": Wn.lagged("x", 2, S, None)})
    df = Wn.current_streaks(df, "r", S, win_out="w", loss_out="l").withColumn("c", Wn.expanding_mean("x", S))
    return df


def in_small_pieces(df, chunk, size):
    from perflog.operators.split import in_pieces, running_means
    win, loss = Wn.streaks_of_run("r")
    out = in_pieces(df, S, 2, lambda p: {"n": F.col("__rn"), "m": Wn.rolling_mean("x", 3, p, True), "p": Wn.prior_mean("x", 2, p, None, True),
                                         "d": Wn.days_rest(p, 3, True, "t"), "g": Wn.lagged("x", 2, p, None, True)},
                    result="r", keep=("__run",), chunk_seconds=chunk, rows_per_bucket=size)
    out = out.withColumns({"w": win, "l": loss}).drop("__run")
    return running_means(out, S, {"c": "x"}, chunk).drop("__e", "__rn")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_windows_in_pieces_equal_plain_windows(spark, zone):
    cols = ["k", "n", "m", "p", "d", "g", "w", "l", "c"]

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = pieces_case(spark)
        want = list(map(repr, rows(plain_windows(df))))
        for chunk, size in ((3600, 2), (7200, 3), (86400 * 400, 1000)):
            assert list(map(repr, rows(in_small_pieces(df, chunk, size)))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dates_do_not_depend_on_the_zone(spark):
    texts = ["2024-03-10 02:30:00", "2024-01-05T10:00:00Z", "2024-01-05T10:00:00+02:00", "APR 14, 2024", "2024-11-03 01:30:00", "x", None]
    want = [dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 1, 5, 10), dt.datetime(2024, 1, 5, 8), dt.datetime(2024, 4, 14),
            dt.datetime(2024, 11, 3, 1, 30), None, None]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "k int, s string")
            assert [r.d for r in df.orderBy("k").select(P.parse_date("s").alias("d")).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_unknown_margins_and_predictions(spark):
    df = spark.createDataFrame([(None, 1)], "m double, w int")
    r = df.select(R.blowout_win("m", "w").alias("b"), R.close_game("m").alias("c"), PR.prediction_interval("m").alias("i")).first()
    assert (r.b, r.c, r.i) == (0, 0, None)


def test_best_model_ties_and_nan(spark):
    from perflog.operators.metrics import best_model
    rows = [("aaa", "mae", 1.0), ("bbb", "mae", 1.0), ("b", "r2", 0.5), ("c", "r2", float("nan")), ("d", "r2", None)]
    got = {r.metric: r.best_model for r in best_model(spark.createDataFrame(rows, "model string, metric string, value double")).collect()}
    assert got == {"mae": "aaa", "r2": "b"}


def test_lookup_takes_the_smallest_of_duplicates(spark):
    from perflog.operators.lookups import lookup_defaults, resolve_ids
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    dim = spark.createDataFrame([("a", 2, 9), ("a", 1, 8), (None, 5, 5)], "d string, v int, i int")
    got = {r.k: (r.x, r.y) for r in lookup_defaults(df, dim, "k", "d", {"x": ("v", 0), "y": ("i", -1)}).collect()}
    assert got == {"a": (1, 8), "z": (0, -1), None: (0, -1)}
    assert [r.id for r in resolve_ids(df, dim, "k", "d", "i").collect()] == [8]


def test_text_stats_are_read_before_means(spark):
    from perflog.operators.aggregates import season_means
    df = spark.createDataFrame([(1, "s", "10"), (1, "s", "n/a")], "e int, season string, PTS string")
    assert season_means(df, ["e"], "season", ["PTS"]).first().PTS == 5.0


def test_many_rows_of_one_entity_stay_linear(spark):
    """80 000 rows of one entity; a quadratic plan would take minutes."""
    import time
    df = spark.range(80_000).selectExpr("1 as e", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as t", "cast(id as int) as k",
                                        "case when id % 7 = 0 then null else cast(id % 13 as double) end as x")
    began = time.time()
    C.ffill_bfill(df, ["x"], ["e"], ["k"]).write.format("noop").mode("overwrite").save()
    Wn.ewm(df, "x", {"y": 3, "z": 10}, S).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 60
