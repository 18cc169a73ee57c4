"""Landing files with damaged records; stored merges that touch only their partitions."""

import os

import pytest
from pyspark.sql import functions as F

from perflog.operators.lookups import opponent_prior_win_rate
from perflog.sources import landing as L
from perflog.sources import store as S
from perflog.spec import LogSpec


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"id": 1, "full_name": "One", "abbreviation": "ONE"}\n{"id": 2, "full_na\nnot json\n{"id": "x", "full_name": "Bad"}\n{"id": 3}\n\n')
    good, bad = L.read_teams(spark, str(tmp_path / "a"))
    assert sorted((r.id, r.full_name) for r in good.collect()) == [(1, "One"), (3, None)]
    assert good.count() == 2 and bad.count() == 3
    assert {r.file for r in bad.collect()} == {"x.json"} and "not json" in {r.record for r in bad.collect()}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text("PERSON_ID,DISPLAY_FIRST_LAST,POSITION,HEIGHT,TEAM_ID\n1,A,G,6-1,10\nx,B,G,6-1,10\n2,C,F,,\n3,D,C,6-9,11,extra\n")
    info, wrong = L.read_player_info(spark, str(tmp_path / "b"), 2, "csv")
    assert [(r.PERSON_ID, r.HEIGHT, r.TEAM_ID) for r in info.collect()] == [(2, None, None)] and wrong.count() == 2
    many, _ = L.read_player_info(spark, str(tmp_path / "b"), spark.createDataFrame([(1,), (1,), (9,)], "id long"), "csv")
    assert [r.PERSON_ID for r in many.collect()] == [1]
    L.store_bad(bad, str(tmp_path / "bad"), "teams")
    L.store_bad(wrong, str(tmp_path / "bad"), "info")
    assert {(r.source, r["count"]) for r in spark.read.parquet(str(tmp_path / "bad")).groupBy("source").count().collect()} == {("teams", 3), ("info", 2)}


def test_players_of_both_shapes(spark, tmp_path):
    for name, text in (("r", '{"PLAYER": "P", "PLAYER_ID": 1, "TEAM_ID": 5}\n{broken\n'), ("p", '{"id": 2, "full_name": "Q", "team_id": 6}\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "f.json").write_text(text)
    paths = {"roster": str(tmp_path / "r"), "player": str(tmp_path / "p")}
    good, bad = L.read_players(spark, paths)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "P", 5), (2, "Q", 6)] and bad.count() == 1
    assert [r.id for r in L.read_players(spark, paths, team_id=6)[0].collect()] == [2]


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(i, i % 4, float(i), "s%d" % i) for i in range(40)], "k long, season int, v double, s string") \
        .write.partitionBy("season").parquet(path)
    return path


def table(spark, path):
    return {r.k: (r.season, r.v, r.s) for r in spark.read.parquet(path).collect()}


def test_merge_rewrites_touched_partitions_alone(spark, stored):
    before, rows = files(stored), table(spark, stored)
    batch = spark.createDataFrame([(5, -5.0), (9, -9.0), (9, -10.0)], "k long, v double")
    S.merge_stored(spark, stored, batch, ["k"], ["v"], ["season"])
    kept = {f for f in before if not f.startswith("season=1/")}
    assert kept <= files(stored) and not (before - kept) & files(stored)
    assert table(spark, stored) == rows | {5: (1, -5.0, "s5"), 9: (1, -9.0, "s9")}


def test_merge_inserts_moves_and_empties(spark, stored):
    rows = table(spark, stored)
    batch = spark.createDataFrame([(100, 7, 1.0), (2, 0, 2.5)], "k long, season int, v double")
    S.merge_stored(spark, stored, batch, ["k"], ["v"], ["season"])
    want = rows | {100: (7, 1.0, None), 2: (0, 2.5, "s2")}
    assert table(spark, stored) == want
    # every row of season 3 moves: its partition goes
    moved = spark.createDataFrame([(k, 0) for k, r in rows.items() if r[0] == 3], "k long, season int")
    S.merge_stored(spark, stored, moved, ["k"], ["season"], ["season"])
    assert table(spark, stored) == want | {k: (0, *r[1:]) for k, r in rows.items() if r[0] == 3}
    assert not any(f.startswith("season=3") for f in files(stored))
    # a batch without partition value: new rows get none
    S.merge_stored(spark, stored, spark.createDataFrame([(200, 3.0)], "k long, v double"), ["k"], ["v"], ["season"])
    assert table(spark, stored)[200] == (None, 3.0, None) and len(table(spark, stored)) == 42


def test_delete_stored(spark, stored):
    before = files(stored)
    assert S.delete_stored(spark, stored, F.col("k") < 0, ["season"]) == 0 and files(stored) == before
    assert S.delete_stored(spark, stored, (F.col("season") == 2) | (F.col("k") == 5), ["season"]) == 11
    assert {k for k in table(spark, stored)} == {k for k in range(40) if k % 4 != 2 and k != 5}
    assert {f for f in before if f[:8] in ("season=0", "season=3")} <= files(stored)


def test_strength_before_the_instant(spark):
    """Games of one day count from their time on; games of one instant don't count for each other."""
    rows = [(1, "2024-01-01 10:00:00", "A", "L"), (2, "2024-01-01 12:00:00", "A", "W"), (3, "2024-01-01 12:00:00", "A", "L"), (4, "2024-01-02 09:00:00", "A", "W"),
            (5, "2024-01-02 09:00:00", None, "L"), (6, None, "A", "L"), (7, "2024-01-01 23:00:00", "B", "W")]
    df = spark.createDataFrame(rows, "id int, t string, opp string, wl string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    for span in (3600, 86_400, 30 * 86_400):
        out = opponent_prior_win_rate(df, LogSpec(entity="id", time="t"), "opp", F.col("wl") == "L", chunk_seconds=span)
        assert {r.id: round(r.OPP_STRENGTH, 6) for r in out.collect()} == {1: 0.5, 2: 1.0, 3: 1.0, 4: round(2 / 3, 6), 5: 0.5, 6: 0.5, 7: 0.5}
