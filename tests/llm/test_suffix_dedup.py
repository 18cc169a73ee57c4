"""Byte-string dedup against brute force, and its parts."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402


def check(df, **options):
    from perflog.llm.suffix_dedup import remove_repeats
    want = brute.byte_dedup([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = [tuple(r) for r in remove_repeats(df, **options).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


def test_repeated_strings():
    from perflog.llm.suffix_dedup import repeated
    rng = random.Random(1)
    for length in (3, 5, 8):
        for _ in range(60):
            strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(length, 30))) for _ in range(rng.randrange(1, 6))]
            weights = [np.array([rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, len(s) - length + 2))]) for s in strings]
            count = {}
            for s, w in zip(strings, weights):
                for i, x in enumerate(w):
                    count[s[i:i + length]] = count.get(s[i:i + length], 0) + x
            want = [[count[s[i:i + length]] >= 2 for i in range(len(w))] for s, w in zip(strings, weights)]
            assert [x.tolist() for x in repeated(strings, weights, length)] == want


def test_anchor_runs():
    """Equal windows choose equal anchors at equal distances, also in periodic texts."""
    from perflog.llm.suffix_dedup import anchor_runs
    rng = random.Random(2)
    for alphabet in (b"a", b"ab", bytes(range(256))):
        text = bytes(rng.choice(alphabet) for _ in range(3000))
        a, b = text, b"xyz" * 50 + text[500:2500] + b"q" * 700
        where = []
        for t in (a, b):
            first, size, le, key, _ = anchor_runs(np.frombuffer(t, np.uint8), 400)
            assert first[0] == 0 and (first[1:] == (first + size)[:-1]).all() and first[-1] + size[-1] == len(t) - 399
            assert (le >= size - 1).all() and (le <= 400 - 128).all()
            where.append([(f + d - i, k) for f, n, d, k in zip(first, size, le, key) for i in range(f, f + n)])
        assert where[0][500:2101] == where[1][150:1751]


def test_odd_documents(spark):
    check(spark.createDataFrame(brute.odd_documents(), brute.SCHEMA))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_real_documents(spark, sf):
    check(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))


def test_one_passage_in_many_contexts(spark):
    """Shared passages around the threshold, edited copies, and splits of hot anchors."""
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages, base = [make(n) for n in (150, 300, 390, 396, 400, 500)], make(2000)
    rows = []
    for i in range(120):
        text = make(rng.randrange(0, 400)) + rng.choice(passages) + make(rng.randrange(0, 400))
        if i % 4 == 0:
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(2000)] = "?"
            text = "".join(text)
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for variants in (2, 800):
        assert any(r[2] for r in check(df, most_variants=variants))


def test_empty_and_clashing(spark):
    from perflog.llm.suffix_dedup import remove_repeats
    assert remove_repeats(spark.createDataFrame([], brute.SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, "é" * 300, 1, 2), (2, "é" * 300, 1, 2), (None, "b", 3, 4)], "doc_id long, text string, rid int, n_spans int")
    got = {r.doc_id: r for r in remove_repeats(df, with_text=True).collect()}
    assert got[1].n_removed == 600 and got[2].n_spans == 1 and bytes(got[None].kept) == b"b" and bytes(got[1].kept) == b""
