"""Training sets whose rows move once, and what their models keep (findings of round 4)."""

import re

import pytest
from pyspark.sql import functions as F

from perflog.operators import windows as Wn
from perflog.operators.split import cuts_of, large_entities, placed
from perflog.plans import training as TR
from perflog.plans.bindings import BOX, box_scores
from perflog.spec import LogSpec

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [TR.player_game_set, TR.team_win_set])
def test_rows_of_sets_move_once(spark, make):
    """rows go to (entity, bucket) and nowhere else; all else that moves is counts."""
    plan = make(box_scores(spark, SF), BOX)._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in plan.splitlines() if re.search(r"Exchange hashpartitioning\(__e#\d+L?, __bucket", x)]
    assert 1 <= len(moves) <= 2          # the second one holds the rows of large entities, which are counted beforehand
    assert not [x for x in plan.splitlines() if "Exchange" in x and "__chunk" in x]
    if make is TR.player_game_set:
        assert len(moves) == 1


@pytest.fixture(scope="module")
def log(spark):
    """One large entity, a null one, small ones; null values, null and equal times, rows of one chunk in plenty."""
    rows = spark.range(2600).select(
        F.when(F.col("id") % 10 < 8, F.lit(1)).when(F.col("id") % 10 == 8, F.lit(None)).otherwise(F.col("id") % 7 + 2).cast("long").alias("e"), F.col("id").alias("k"),
        F.when(F.col("id") % 211 > 0, F.timestamp_add("HOUR", F.floor(F.pow(F.col("id") % 1300, F.lit(1.3))).cast("int"),
                                                      F.lit("2001-01-01 00:00:00").cast("timestamp_ntz"))).alias("t"),
        F.when(F.col("id") % 17 > 0, (F.col("id") * 7919 % 50).cast("double")).alias("x"))
    return rows.cache()


SPEC = LogSpec(entity="e", time="t", tie=("k",))


@pytest.mark.parametrize("bucket, lookback", [(100_000, 9), (50, 9), (13, 40)])
def test_placed_rows_have_their_number_and_what_they_look_back_at(spark, log, bucket, lookback):
    large = large_entities(log, SPEC, bucket)
    rows, p = placed(log, SPEC, cuts_of(log, SPEC, large, lookback, 86_400, bucket), 86_400)
    rows = rows.withColumn("back", F.collect_list("k").over(p.rows(-lookback, 0, True)))
    got = {r.k: (r["__rn"], r["__total"], r.back) for r in rows.where("not __halo").collect()}
    w = SPEC.w()
    want = {r.k: (r.n, r.c, r.back) for r in log.withColumns({"n": F.row_number().over(w), "c": F.count("k").over(SPEC.whole()),
                                                             "back": F.collect_list("k").over(SPEC.rows(-lookback, 0))}).collect()}
    assert rows.where("not __halo").count() == 2600 and got == want
    if bucket < 100:
        assert rows.select("__e", "__bucket").distinct().where("__e = 1").count() > 10


@pytest.mark.parametrize("bucket", [100_000, 300])
def test_means_of_blocks_are_the_folds(spark, log, bucket):
    """More rows than a block has, and cuts inside them."""
    spans = {"a": 3, "b": 5, "c": 10}
    back = max(Wn.ewm_horizon(s) for s in spans.values())
    rows, p = placed(log, SPEC, cuts_of(log, SPEC, large_entities(log, SPEC, bucket), back, 86_400, bucket), 86_400)
    rows, _ = Wn.ewm_placed(rows, "x", spans, p)
    got = {r.k: r for r in rows.where("not __halo").collect()}
    want = log.withColumns({c: Wn.ewm_fold("x", s, SPEC) for c, s in spans.items()}).collect()
    assert len(got) == len(want) == 2600
    for r in want:
        for c in spans:
            assert (got[r.k][c] is None) if r.x is None else abs(got[r.k][c] - r[c]) < 1e-9


@pytest.mark.parametrize("pieces", [2, 3, 8, 64, 65])
def test_ranges_are_found_by_halving(spark, pieces):
    """a row's range is the number of cut points below its value, found without going through them all."""
    from perflog.operators.ranges import with_ranges
    vals = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, *[float(i * i % 101) for i in range(300)]]
    df = spark.createDataFrame([(g, v) for g in ("a", "b") for v in vals] + [("none", None), (None, 1.0)], "g string, v double")
    for by in ((), ("g",)):
        out = with_ranges(df, "v", by, pieces)
        assert "__cuts" not in out.columns and "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
        at = F.percentile_approx("v", [i / pieces for i in range(1, pieces)], 100 * pieces)
        cuts = df.groupBy(*[F.col(c).alias("h") for c in by]).agg(at.alias("cuts"))
        want = df.join(cuts, df.g.eqNullSafe(cuts.h)) if by else df.crossJoin(cuts)
        want = want.select("g", "v", F.when(F.col("v").isNotNull(), F.size(F.filter("cuts", lambda c: c < F.col("v")))).otherwise(-1).alias("r"))
        both = out.groupBy("g", "v", F.col("__range").alias("r")).count().exceptAll(want.groupBy("g", "v", "r").count())
        assert both.count() == 0


def test_chain_makes_the_set_once(spark, monkeypatch):
    """both halves come from one stored set, whichever query is first."""
    from perflog.plans import q_player as Q
    calls = []
    made = Q.player_set
    monkeypatch.setattr(Q, "player_set", lambda *a: calls.append(1) or made(*a))
    monkeypatch.setattr(Q, "_kept_at", lambda spark, sf_dir, what, to=Q._kept_at(spark, SF, "once"): f"{to}-{what}")
    assert Q.player_game_chain(spark, SF).count() > 0 and Q.next_game_vector(spark, SF).count() > 0 and len(calls) == 1
    train, test = Q.stored_halves(spark, SF)
    whole = made(spark, SF)
    assert train.count() + test.count() == whole.count() and whole.where(Q.TRAIN).count() == train.count()
