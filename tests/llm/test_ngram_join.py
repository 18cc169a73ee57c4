"""The Jaccard join and its components against brute force."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402


def check(df):
    from perflog.llm.ngram_join import link
    want = brute.components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in link(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def test_odd_documents(spark):
    check(spark.createDataFrame(brute.odd_documents(), brute.SCHEMA))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_real_documents(spark, sf):
    check(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))


@pytest.mark.parametrize("block", [4, 512])
def test_families_of_edited_copies(spark, monkeypatch, block):
    """Copies with more and more edits around the threshold, of many sizes, with a passage that all share."""
    import random
    from perflog.llm import ngram_join
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(30)]
    rows, n = [], 0
    for family in range(25):
        size = rng.choice([6, 7, 8, 9, 12, 20, 40, 90, 200])
        base = [f"f{family}w{rng.randrange(60)}" for _ in range(size)] + (shared if family % 2 else [])
        for _ in range(rng.choice([2, 5, 12])):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, len(text) // 20))):
                text[rng.randrange(len(text))] = f"e{rng.randrange(99)}"
            if rng.random() < 0.3:
                text = text[:max(1, int(len(text) * rng.uniform(0.75, 1)))]
            rows.append((n * 7 % 1009, " ".join(text)))
            n += 1
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len({c for _, _, c in got}) < len(got)


def test_small_families_with_edited_tails(spark):
    """Groups that share no shingle with others, whose members link with each other but not all with the class of least hash."""
    import random
    rng = random.Random(11)
    rows = []
    for family in range(120):
        size = rng.choice([14, 14, 15, 18, 24, 30])
        base = [f"f{family}w{j}" for j in range(size)]
        for copy in range(rng.choice([3, 3, 4, 6])):
            cut = rng.choice([1, 1, 2, 3])
            rows.append((len(rows), " ".join(base[:-cut] + [f"e{copy}x{rng.randrange(9)}" for _ in range(cut)])))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_many_near_copies_of_one_text(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:i % 100] + [f"x{i}"] + base[i % 100 + 1:])) for i in range(400)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {c for _, _, c in got} == {0}


def test_bundles_of_a_wide_family_are_bounded(spark, monkeypatch):
    from perflog.llm import ngram_join
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    nodes = spark.range(800).selectExpr("1L as family", "id as part", "id as c", "100 as n")
    sent = ngram_join.meetings(nodes, 80).groupBy("bundle").count().collect()
    assert sum(r["count"] for r in sent) > 60_000 and max(r["count"] for r in sent) <= 32 * 8


def test_bounds_from_maps_lose_no_link():
    """Sets of many sizes around the similarity, in one block or two: every link is among the pairs left, and pairs far off are not."""
    import numpy as np
    from perflog.llm.ngram_join import block_links, parity_map
    rng = np.random.default_rng(1)
    for trial in range(200):
        base = rng.integers(0, 2 ** 63, rng.integers(3, 900)).astype(np.uint64)
        sets = []
        for _ in range(12):
            x, k = base.copy(), rng.integers(0, len(base) // 4 + 1)
            x[rng.choice(len(x), k, replace=False)] = rng.integers(0, 2 ** 63, k).astype(np.uint64)
            sets.append(np.unique(x[:rng.integers(len(x) * 3 // 4 + 1, len(x) + 1)]))
        n = np.array([len(x) for x in sets])
        second = np.arange(12) >= 5 if trial % 2 else np.zeros(12, bool)
        share = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(i + 1, 12) if not trial % 2 or i < 5 <= j}
        got = {(min(p), max(p)) for p in block_links(np.arange(12), np.arange(12), n, [parity_map(x) for x in sets], second, 80)}
        assert {p for p, s in share.items() if 100 * s >= 80 * (n[p[0]] + n[p[1]] - s)} <= got <= set(share)
        assert not any(len(base) > 200 and 100 * share[p] < 65 * (n[p[0]] + n[p[1]] - share[p]) for p in got)


def test_strips_of_a_meeting_give_the_same_pairs(monkeypatch):
    import numpy as np
    from perflog.llm import ngram_join
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[:rng.integers(250, 300)], rng.integers(0, 2 ** 63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(90)]
    n, maps = np.array([len(x) for x in sets]), [ngram_join.parity_map(x) for x in sets]
    for second in (np.zeros(90, bool), np.arange(90) % 3 == 0):
        want = sorted(ngram_join.block_links(np.arange(90), np.arange(90) // 2, n, maps, second, 80))
        with monkeypatch.context() as m:
            m.setattr(ngram_join, "STRIP", 7)
            assert sorted(ngram_join.block_links(np.arange(90), np.arange(90) // 2, n, maps, second, 80)) == want and len(want) > 100


def test_packed_sets():
    """Gaps byte by byte: whole keys come back, and what a codec leaves of them is less than of the keys."""
    import zlib
    import numpy as np
    from perflog.llm.ngram_join import packed, unpacked
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 900):
        keys = np.unique(rng.integers(0, 2 ** 56, size).astype(np.uint64) | (rng.integers(0, 40, size).astype(np.uint64) // np.uint64(39) << np.uint64(63)))
        assert (unpacked(packed(keys)) == keys).all()
    assert len(zlib.compress(packed(keys), 1)) < 0.88 * len(zlib.compress(keys.tobytes(), 1))


def test_both_ends_of_pairs_read_one_shuffle_of_sets(spark, monkeypatch):
    """Sets are dealt by class once, not stored and dealt again for either end of the pairs."""
    import numpy as np
    from pyspark.sql import functions as F
    from perflog.llm import ngram_join
    from perflog.llm.runtime import ready, stage, text_hash
    named = []
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: named.append(name) or stage(df, name))
    ready(spark)
    texts = [" ".join(f"d{d // 2}w{i}" for i in range(60)) + f" e{d}" for d in range(40)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "__id long, __text string").withColumn("__th", text_hash(F.col("__text")))
    docs = stage(docs.select("__id", "__th", "__text"), "docs")
    level = spark.sparkContext.broadcast(np.zeros(ngram_join.COUNTERS, np.uint8))
    rows = stage(ngram_join.figures(docs, 5, level, "__id long, __th long", ["__id", "__th"]), "figures")
    c = [r.c for r in rows.orderBy("__id").collect()]
    pairs = stage(spark.createDataFrame([(c[i], c[i + 1]) for i in range(39)], "a long, b long"), "pairs")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = ngram_join.verify(docs, rows, pairs, 5, 80, level)
        links = sorted((r.a, r.b) for r in got.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert links == sorted((c[i], c[i + 1]) for i in range(0, 39, 2))
    assert "sets" not in named and "ReusedExchange" in plan


def test_bundles_of_long_texts_are_bounded(spark):
    """Sets of 20 000 shingles: what a bundle holds goes by their keys, not by their number."""
    from perflog.llm import ngram_join
    nodes = spark.range(300).selectExpr("id % 3 as family", "id as part", "id as c", "20000 as n")
    sent = ngram_join.meetings(nodes, 80).groupBy("bundle").count().collect()
    blocks = -(-100 * 20_000 // ngram_join.BLOCK_KEYS)
    assert sum(r["count"] for r in sent) == 3 * 100 * blocks
    assert max(r["count"] for r in sent) * 20_000 <= 4 * ngram_join.BUNDLE_KEYS


def test_components_of_long_chains(spark):
    from perflog.llm.ngram_join import components
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + i * 2 + 1) for i in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1063] == 1000


def test_empty(spark):
    from perflog.llm.ngram_join import link
    assert link(spark.createDataFrame([], brute.SCHEMA)).collect() == []


def test_drop_copies(spark):
    from perflog.llm.ngram_join import drop_copies
    df = spark.createDataFrame(brute.odd_documents(), brute.SCHEMA)
    docs = [(r.doc_id, r.text) for r in df.collect()]
    sets = brute.components(docs)
    kept = [(r.doc_id, r.text) for r in drop_copies(df).collect()]
    assert sorted(map(repr, (d for d, s in zip(docs, sets) if s[1] == 0))) == sorted(map(repr, (d for d in kept if not brute.words(d[1]))))
    rest = [d for d in kept if brute.words(d[1])]
    assert all(d in docs for d in rest) and len(set(rest)) == len(rest)
    assert all(n == 0 or i == c for i, n, c in brute.components(kept))
    assert len(rest) == len({s[2] for s in sets if s[1]})


def test_few_edges_take_few_queries(spark, monkeypatch):
    """A chain of 300 nodes took a dozen rounds of two stored or asked plans each; edges that a task can hold take none."""
    from perflog.llm import ngram_join
    from perflog.llm.runtime import stage
    named = []
    monkeypatch.setattr(ngram_join, "stage", lambda df, name: named.append(name) or stage(df, name))
    edges = stage(spark.createDataFrame([(i * 7919 % 300, (i + 1) * 7919 % 300) for i in range(299)] + [(5, 5), (400, 399), (399, 400)], "a long, b long"), "given")
    got = {r.node: r.component for r in ngram_join.components(edges).collect()}
    assert got == dict.fromkeys(range(300), 0) | {399: 399, 400: 399} and len(named) <= 2
    assert ngram_join.components(edges.where("a < 0")).isEmpty()


@pytest.mark.parametrize("share", [1, 40, 1 << 18])
def test_components_of_shares(spark, monkeypatch, share):
    """Edges of many shares give the components that one share gives: negative numbers, repeats, stars and chains."""
    import random
    from perflog.llm import ngram_join
    monkeypatch.setattr(ngram_join, "EDGES", share)
    rng = random.Random(share)
    many = 12 if share == 1 else 130
    pairs = [(rng.randrange(-many, many) * 2 ** 55, rng.randrange(-many, many) * 2 ** 55) for _ in range(many)]
    pairs += [(10 ** 6, i) for i in range(1, many // 2)] + pairs[:5]
    least = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    rows = ngram_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in rows) == sorted(least.items())
