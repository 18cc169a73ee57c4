"""Leaked benchmark items, exact and edited, against plain dynamic programming."""

import random

import numpy as np


def smith_waterman(a, b, penalty):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -penalty), h[i - 1][j] - penalty, h[i][j - 1] - penalty)
    return max(map(max, h))


def test_alignment():
    from perflog.llm.decontaminate import align
    rng = random.Random(1)
    pairs = [([rng.randrange(1, 6) * 2 + 1 for _ in range(rng.randrange(1, 15))], [rng.randrange(1, 6) * 2 + 1 for _ in range(rng.randrange(1, 25))]) for _ in range(60)]
    got = align([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs], 0.5)
    assert np.allclose(got, [smith_waterman(a, b, 0.5) for a, b in pairs])


def test_exact_and_edited_copies(spark):
    from perflog.llm.decontaminate import decontaminate
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(300)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [make(30) for _ in range(20)] + [make(400)]
    rows, want = [], set()
    for i in range(200):
        text = make(100)
        if i % 5 == 0:
            k = rng.randrange(20)
            copy = list(items[k])
            for _ in range(i % 3 * 2):  # up to 4 of 30 words changed, dropped or put in
                at, what = rng.randrange(len(copy)), rng.randrange(3)
                copy[at:at + (what != 1)] = [] if what == 0 else ["Other"]
            text[50:50] = copy
            want.add((i, k))
        rows.append((i, (", " if i % 2 else " ").join(text)))
    rows.append((300, " ".join(make(50) + items[20][100:300] + make(50))))
    want.add((300, 20))
    docs = spark.createDataFrame(rows + [(400, None), (401, ""), (None, " ".join(items[0])), (0, rows[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(50, None), (51, "ab"), (52, "")], "item_id long, text string")
    got = decontaminate(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 0)}
    assert len(got) == len(want) + 1 and all(r.score <= 1 for r in got)


def test_much_edited_copies(spark):
    """15 to 25 % of the words changed, alone and beside an exact copy, against alignment with every pair that shares three words."""
    from perflog.llm.decontaminate import decontaminate
    rng = random.Random(3)
    items = [[f"i{k}w{j}" for j in range(20 + k % 21)] for k in range(40)]
    items[39] = [f"i39w{j % 12}" for j in range(40)]  # with repeated words
    docs = [[w if j % 5 != 4 else "changed" for j, w in enumerate(items[20])]]
    for copies in (False, True):
        for k, item in enumerate(items):
            text = list(item)
            for at in rng.sample(range(len(item)), round(len(item) * rng.uniform(0.15, 0.25))):
                text[at] = f"e{rng.randrange(9)}"
            if k % 4 == 3:  # words put in as well
                text = [x for w in text for x in ([w, "more"] if rng.random() < 0.2 else [w])]
            docs.append([f"u{rng.randrange(500)}" for _ in range(60)] + text + [f"u{rng.randrange(500)}" for _ in range(60)])
            if copies:
                docs.append(["other"] * 10 + item)
    three = lambda x: set(zip(x, x[1:], x[2:]))
    want = {(d, k): smith_waterman(item, doc, 0.5) / len(item) for k, item in enumerate(items) for d, doc in enumerate(docs) if three(item) & three(doc)}
    want = {p: s for p, s in want.items() if s >= 0.5}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    for part in (range(41), range(41, len(docs))):
        df = spark.createDataFrame([(d, " ".join(docs[d])) for d in part], "doc_id long, text string")
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate(df, bench).collect()}
        assert got.keys() == {p for p in want if p[0] in part}
        assert all(abs(s - want[p]) < 1e-5 for p, s in got.items())


def test_real_documents(spark):
    from perflog.llm.decontaminate import decontaminate
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in (r.text or "")}
    assert {(r.doc_id, r.item_id) for r in decontaminate(docs, bench).collect()} == want


def test_empty_tables(spark):
    from perflog.llm.decontaminate import decontaminate
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    bench = some.selectExpr("doc_id as item_id", "text")
    assert decontaminate(none, bench).collect() == []
    assert decontaminate(some, bench.where("false")).collect() == []
    assert len(decontaminate(some.withColumn("item", some.doc_id).withColumn("score", some.doc_id), bench).collect()) == 1
