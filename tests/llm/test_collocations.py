"""Phrase collocations against plain counting, and the quicksort of suffix pointers."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def collocations(rows, least, top, share=100, depth=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, depth + 1):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i:i + m]] = max(inside[p[i:i + m]], a)
        scored = []
        for p, a in cand.items():
            if 100 * inside[p] < share * a:
                score, _, l, r = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def check(df, least=100, top=2000, **options):
    from perflog.llm.collocations import mine_collocations
    got = [tuple(r) for r in mine_collocations(df, least=least, top=top, **options).collect()]
    want = collocations([(r.lang, r.text) for r in df.select("lang", "text").collect()], least, top)
    assert sorted(got) == sorted(want)
    return got


def test_quicksort():
    """Counts of all prefixes, weighted; prefixes shorter than the route come out however rare they are."""
    from perflog.llm.collocations import multikey_quicksort
    rng = random.Random(6)
    for _ in range(120):
        n, depth, least = rng.randrange(1, 80), rng.choice([2, 3, 5]), rng.choice([1, 3, 8])
        rows = []
        for _ in range(n):
            size = rng.randrange(1, depth + 1)
            rows.append([rng.randrange(1, 4) for _ in range(size)] + [0] * (depth - size))
        weight = [rng.choice([1, 1, 5]) for _ in range(n)]
        route = [rng.randrange(1, depth + 1) for _ in range(n)]
        want = Counter()
        for row, w, r in zip(rows, weight, route):
            for k in range(2, depth + 1):
                if row[k - 1]:
                    want[r, tuple(row[:k])] += w
        want = {k: v for k, v in want.items() if v >= least or len(k[1]) < k[0]}
        first, length, count = multikey_quicksort(np.array(rows, np.int32).T.copy(), np.array(weight), np.array(route, np.uint8), least)
        got = {(route[i], tuple(rows[i][:k])): c for i, k, c in zip(first.tolist(), length.tolist(), count.tolist())}
        assert got == want and len(got) == len(first)


def prose(rng, n, words=12, marks=(" ", " ", " ", "  ", "\t", ". ", "\n", ",", "!", " \r\n")):
    vocab = ["The", "of", "Ünï", "new", "york", "CITY", "a|b", "日本", "x", "y", "z", "İx"][:words]
    return "".join(rng.choice(vocab) + rng.choice(marks) for _ in range(n))


@pytest.mark.parametrize("hot, bucket", [(1 << 21, 1 << 20), (6, 40)])
def test_random_prose(spark, hot, bucket):
    """Also with hot words and pairs everywhere, whose phrases are counted in several tasks."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(0, 60)), rng.choice(["en", "de", None, "und"])) for i in range(60)]
    rows += [(100 + i, "Same passage of words, again. " * 3, "en") for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for least, top in ((3, 2000), (5, 4)):
        assert check(df, least, top, hot=hot, bucket=bucket)


def test_odd_documents_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame(brute.odd_documents(), brute.SCHEMA)
    got = check(df, 3)
    extra = df.selectExpr("*", "1 as words", "2 as h", "3 as `a.b`", "4 as rank", "5 as __text", "6 as total", "7 as n")
    assert got and sorted(check(extra, 3)) == sorted(got)
    assert check(df.limit(0), 3) == []
    assert check(spark.createDataFrame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string"), 1) == []


def test_long_text_and_full_sketch(spark):
    """One text of many words, and a sketch so small that it lets everything through."""
    rng = random.Random(8)
    df = spark.createDataFrame([(1, prose(rng, 40_000), "en")], "doc_id long, text string, lang string")
    assert check(df, 100, hot=500, bucket=1000, most_counters=1 << 10)


def test_scores_are_exact_beyond_64_bits(spark):
    from perflog.llm.collocations import best_cut
    a, n, l, r = 3_000_000_000_019, 9_000_000_000_000_007, 4_000_000_000_063, 5_000_000_000_053
    phrases = spark.createDataFrame([([1, 2], a)], "words array<bigint>, a long")
    singles = spark.createDataFrame([("en", "x", 1, l, n), ("en", "y", 2, r, n)], "lang string, word string, h long, n long, total long")
    (row,) = best_cut(phrases, singles).collect()
    assert (row.score, row.l, row.r) == (1000 * a * n // (l * r), l, r)


def test_real_documents(spark):
    from perflog.llm.queries import QUERIES
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [tuple(r) for r in QUERIES["op11_collocations"](spark, "/root/testdata/sf0.01").collect()]
    assert sorted(got) == sorted(collocations([(r.lang, r.text) for r in df.select("lang", "text").collect()], 100, 2000))
