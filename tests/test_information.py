"""Mutual information with a numeric target against plain counting; running state over ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from perflog.models import information as I
from perflog.operators.ranges import fill_along, running_total
from perflog.session import cut_lineage


def psi(n):
    """Digamma of a whole number: the harmonic sum."""
    return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))


def classes(ys, bins):
    s = sorted(ys)
    return [math.floor(bins * sum(v < y for v in s) / len(s)) for y in ys]


def by_neighbours(xs, ls, k):
    """Rows one by one; ends of an interval are computed as the operator computes them."""
    pairs = [(x, c) for x, c in zip(xs, ls) if sum(d == c for d in ls) > 1]
    n, total = len(pairs), 0.0
    for i, (x, c) in enumerate(pairs):
        own = [abs(z - x) for j, (z, d) in enumerate(pairs) if d == c and j != i]
        near = min(k, len(own))
        dist = sorted(own)[near - 1]
        if dist > 0:
            m = sum(x - dist < z < x + dist for z, _ in pairs)
        else:
            near, m = sum(z == x and d == c for z, d in pairs), sum(z == x for z, _ in pairs)
        total += psi(near) - psi(m) - psi(len(own) + 1)
    return max(0.0, total / n + psi(n))


def by_bins(xs, ls, bins):
    b, n = classes(xs, bins), len(xs)
    return sum(c / n * math.log(c * n / (b.count(x) * ls.count(y))) for (x, y), c in
               {p: list(zip(b, ls)).count(p) for p in zip(b, ls)}.items())


def test_digamma(spark):
    got = spark.range(1, 60).select("id", I.digamma(F.col("id")).alias("v")).collect()
    assert all(abs(r.v - psi(r.id)) < 1e-9 for r in got)


@pytest.mark.parametrize("pieces, bucket", [(64, 100_000), (3, 5)])
def test_against_plain_counting(spark, pieces, bucket):
    rng = random.Random(1)
    y = [rng.choice([rng.gauss(0, 1), float(rng.randrange(3))]) for _ in range(160)]
    cols = {"same": y, "noise": [rng.random() for _ in y], "steps": [float(rng.randrange(4)) for _ in y],
            "near": [v + rng.gauss(0, .3) for v in y], "hot": [7.0 if rng.random() < .6 else rng.random() for _ in y], "flat": [1.0] * len(y)}
    df = spark.createDataFrame([tuple(r) for r in zip(y, *cols.values())] + [(None, *[1.0] * 6)], ["y", *cols])
    counts = I.labelled_counts(df, list(cols), "y", 6, pieces)
    got = {r.feature: r.mutual_info for r in I.neighbour_information(counts, 3, pieces, bucket).collect()}
    binned = {r.feature: r.mutual_info for r in I.binned_information(counts, 6, pieces).collect()}
    ls = classes(y, 6)
    for f, xs in cols.items():
        assert abs(got[f] - by_neighbours(xs, ls, 3)) < 1e-7, f
        assert abs(binned[f] - max(0.0, by_bins(xs, ls, 6))) < 1e-9, f
    assert got["same"] > got["near"] > got["noise"] and got["flat"] < 1e-9


def test_information_of_a_gaussian_pair(spark):
    """Known value: -log(1 - r^2) / 2; cutting the target into classes loses little of it."""
    rng, r = random.Random(2), 0.8
    rows = [(x, r * x + math.sqrt(1 - r * r) * rng.gauss(0, 1)) for x in (rng.gauss(0, 1) for _ in range(4000))]
    counts = I.labelled_counts(spark.createDataFrame(rows, "x double, y double"), ["x"], "y", 20)
    assert abs(I.neighbour_information(counts).first().mutual_info + math.log(1 - r * r) / 2) < 0.06


def test_distances_below_the_precision_of_a_value(spark):
    """1 and the number right below it differ by half of what can be added to 1."""
    below = math.nextafter(1.0, 0.0)
    rows = [(x, y) for x, y in ((1.0, 1.0), (below, 1.0), (below, 1.0), (3.0, 2.0), (4.0, 2.0), (5.0, 2.0)) for _ in range(1)]
    for k in (1, 3):
        got = I.neighbour_information(I.labelled_counts(spark.createDataFrame(rows, "x double, y double"), ["x"], "y", 2), k).first().mutual_info
        assert got is not None and 0 <= got < 2


def test_small_classes_and_empty_table(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.5, 2.0)], "x double, y double")
    assert I.neighbour_information(I.labelled_counts(df, ["x"], "y", 3)).first().mutual_info >= 0
    assert I.neighbour_information(I.labelled_counts(df.limit(0), ["x"], "y", 3)).collect() == []


@pytest.mark.parametrize("pieces", [1, 2, 7, 64])
def test_running_total(spark, pieces):
    rng = random.Random(3)
    rows = list({(rng.choice(["a", "b", None]), rng.choice([float(rng.randrange(9)), rng.gauss(0, 9)])) for _ in range(200)})
    df = spark.createDataFrame([(*r, i % 5 + 1) for i, r in enumerate(rows)], "k string, v double, n long").repartition(5)
    for r in running_total(df, ["k"], ["v"], "n", "upto", pieces).collect():
        assert r.upto == sum(i % 5 + 1 for i, (k, v) in enumerate(rows) if k == r.k and v <= r.v)


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_fill_along_with_a_hot_entity(spark, pieces):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None] * 6 + [i]), rng.choice([None] * 30 + ["x%d" % i])) for i in range(400)]
    rows += [("none", 1000 + i, None, None) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, i long, a long, b string").repartition(6)
    got = {r.i: (r.a, r.b) for r in fill_along(df, ["a", "b"], ["k"], ["i"], pieces).collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        for c in (2, 3):
            want, last = [], None
            for r in mine:
                last = last if r[c] is None else r[c]
                want.append(last)
            first = next((w for w in want if w is not None), None)
            assert [got[r[1]][c - 2] for r in mine] == [first if w is None else w for w in want]


def test_counts_do_not_meet_by_feature_alone(spark):
    """What counts meet (sizes, cut points, totals of ranges) is broadcast, so no task gets a feature's counts (finding F6)."""
    counts = spark.range(500).selectExpr("concat('f', id % 2) as feature", "cast(id % 97 as double) as value", "cast(id % 5 as int) as label", "1L as n")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [I.neighbour_distances(counts, 3)._jdf.queryExecution().executedPlan().toString(),
                 I.frequency_classes(counts.groupBy("feature", "value").agg(F.sum("n").alias("n")), ["feature"], "value", "n", 5, "xb")
                 ._jdf.queryExecution().executedPlan().toString()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert all("SortMergeJoin" not in p for p in plans)


def test_stored_rows_are_compressed_tables(spark):
    """Rows that a fit reads several times are a compressed table, not a checkpoint (findings F1, F2, F11)."""
    rows = cut_lineage(spark.range(1000).selectExpr("id", "cast(id % 3 as double) as x"))
    assert rows.count() == 1000 and all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
