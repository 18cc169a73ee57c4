"""Quality rules, packing, token counts, toxicity and window dedup against brute force."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(brute.odd_documents(), brute.SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("which", ["odd", "real"])
def test_text_figures(which, request):
    from perflog.llm.host_rules import apply_host_rules
    df = request.getfixturevalue(which)
    got = apply_host_rules(df).collect()
    want = [(i, *brute.text_figures(t)) for i, t in pairs(df)]
    assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == key(want)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_host_verdict_reaches_documents(spark):
    from perflog.llm.host_rules import apply_host_rules
    good = " ".join("word%d" % i for i in range(60))
    rows = [(i, good, "good") for i in range(40)] + [(100 + i, "too short", "bad") for i in range(39)] + [(139, good, "bad"), (140, good, None)]
    got = {r.doc_id: r for r in apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].kept and got[140].kept and not got[139].kept and not got[139].base_failed
    a = got[139]
    assert 0.5 < a.host_rate_base < 39 / 40  # shrunk towards the prior


def test_every_rule_can_reject_a_host(spark):
    """A host that turns to symbols, or to repeated lines, loses its clean documents too; one with a few such documents doesn't."""
    from perflog.llm.host_rules import apply_host_rules
    word = lambda k: " ".join("w%dx%d" % (k, i) for i in range(60))
    symbols, lines = (lambda k: word(k) + " ####$$$$%%%%&&&&" * 6), (lambda k: word(k) + "\nsame line" * 40)
    rows, odd = [], {"sym": symbols, "line": lines, "some": symbols}
    for h in range(30):
        rows += [("host%d" % h, word(k)) for k in range(20)]
    for h, share in (("sym", 16), ("line", 16), ("some", 2)):
        rows += [(h, odd[h](k) if k < share else word(k)) for k in range(20)]
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in apply_host_rules(df).collect()}
    kept = {}
    for i, (h, _) in enumerate(rows):
        kept.setdefault(h, set()).add(got[i].host_kept)
        assert got[i].kept == (got[i].host_kept and not got[i].base_failed)
    assert {h for h, v in kept.items() if v == {False}} == {"sym", "line"} and all(len(v) == 1 for v in kept.values())
    # a clean document of a host that turned
    last = [i for i, (h, _) in enumerate(rows) if h == "sym"][-1]
    assert not got[last].base_failed and not got[last].kept and 0.2 < got[last].host_rate_symbols < 0.8


@pytest.mark.parametrize("which", ["odd", "real"])
def test_window_dedup(which, request):
    from perflog.llm.window_dedup import remove_repeats
    df = request.getfixturevalue(which)
    want = key(brute.window_dedup(pairs(df)))
    for heavy in (2, 100):  # all repeated windows by the split path, or by the plain one
        assert key(tuple(r) for r in remove_repeats(df, heavy=heavy).collect()) == want
    # a saturated sketch filters nothing and changes nothing
    assert key(tuple(r) for r in remove_repeats(df, most_counters=1 << 20).collect()) == want


@pytest.mark.parametrize("which", ["odd", "real"])
def test_token_counts(which, request):
    import public_tokenizers as P
    from tokenizers import Tokenizer
    from perflog.llm.token_counts import count_tokens
    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, x in pairs(df):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        want.append((i, len((x or "").encode()), n, n > 512))
    assert key(tuple(r) for r in count_tokens(df, P.path("byte_bpe_50k.json")).collect()) == key(want)


@pytest.mark.parametrize("which", ["odd", "real"])
def test_packing(which, request):
    import math
    import public_tokenizers as P
    from tokenizers import Tokenizer
    from perflog.llm.packing import pack
    df = request.getfixturevalue(which)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = pack(df, P.path("word_bpe_49k.json"), block=40).collect()
    want = []
    for i, x in pairs(df):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        want += [(i, k, s, len(ids[s:s + 2048]), brute.crc(ids[s:s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    assert key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == key(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    whole = len(pack(df, P.path("word_bpe_49k.json")).select("sequence_id").distinct().collect())
    assert whole <= math.ceil(sum(w[3] for w in want) / 2048) + 1


def test_crossover_keeps_every_piece():
    import numpy as np
    from perflog.llm.packing import crossover, evolve, fresh
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 1200, 500)
    people = [fresh(sizes, 2048, rng, j) for j in (0, 0.3, 0.6)]
    for _ in range(20):
        child = crossover(sizes, people[2], people[1], 2048, rng)
        assert (child >= 0).all() and np.bincount(child, weights=sizes).max() <= 2048
    best = evolve(sizes, people[1:], 2048, 60, 2, rng)[0]
    assert len(np.unique(best)) <= min(len(np.unique(p)) for p in people[1:])


def test_toxicity(spark):
    from perflog.llm.toxicity import score_toxicity
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    y = {r.doc_id: r.toxic for r in labels.collect()}
    test = [(got[i].score, got[i].predicted, t) for i, t in y.items() if got[i].held_out]
    assert sum(p == t for _, p, t in test) >= 0.95 * len(test)
    for r in got.values():
        import zlib
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1


def test_toxicity_of_odd_input(spark, odd):
    from perflog.llm.toxicity import score_toxicity
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (7, 1, None), (None, 0, 1), (99, 1, 1), (9, 1, 0)], none.schema)
    for labels in (none, some):
        got = score_toxicity(odd, labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)


def test_empty_tables_and_clashing_columns(spark):
    import public_tokenizers as P
    from perflog.llm.host_rules import apply_host_rules
    from perflog.llm.packing import pack
    from perflog.llm.token_counts import count_tokens
    from perflog.llm.toxicity import score_toxicity
    from perflog.llm.window_dedup import remove_repeats
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    runs = [apply_host_rules, remove_repeats, lambda d: pack(d, P.path("word_bpe_49k.json")),
            lambda d: count_tokens(d, P.path("byte_bpe_50k.json")), lambda d: score_toxicity(d, labels)]
    empty = spark.createDataFrame([], brute.SCHEMA)
    clash = spark.createDataFrame([(1, "a b", "s", 1.5, "x", 3)], "doc_id long, text string, source string, score double, kept string, n_words int")
    for run in runs:
        assert run(empty).collect() == []
        assert len(run(clash).collect()) == 1


def test_long_words(spark):
    """Words of many letters, repeats and other scripts against the library; a megabyte without a blank takes seconds."""
    import random
    import time
    from perflog.llm.queries import vocabulary
    from perflog.llm.token_counts import merger
    from tokenizers import Tokenizer
    path = vocabulary("byte_bpe_50k.json")
    tok, m, rng = Tokenizer.from_file(path), merger(path), random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 3, 50, 3000, 20_000)]
    words += ["a" * n for n in (2049, 2050, 5001)] + ["ab" * 3000, "aab" * 2000, "日本語" * 1500, "".join(rng.choice("aaab") for _ in range(6000)),
                                                    "".join(rng.choice("thein") for _ in range(9000)), "0" * 4000, "=" * 4097]
    for w in words:
        assert m.count_long(w.encode()) == len(tok.encode(w, add_special_tokens=False).ids), w[:20]
    assert m.batch([" ".join(words), words[-1] + "\n" + words[5]]) == [len(tok.encode(t, add_special_tokens=False).ids)
                                                                      for t in (" ".join(words), words[-1] + "\n" + words[5])]
    t = time.perf_counter()
    m.count_long("".join(rng.choice(letters) for _ in range(1_000_000)).encode())
    assert time.perf_counter() - t < 60
