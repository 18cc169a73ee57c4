"""Packing over the histogram of lengths: ids against the library, packs against their contract."""

import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402


@pytest.fixture(scope="module")
def tok():
    from perflog.llm.queries import vocabulary
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def test_ids_equal_the_library(tok):
    """Random runs of white space, contractions, odd white space, special strings and letters, many texts at a time."""
    from perflog.llm.length_packing import ByteIds
    from perflog.llm.queries import vocabulary
    rng, ids = random.Random(3), ByteIds(vocabulary("byte_bpe_50k.json"))
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "é", " ", "　", "1", ".", " x", "\x1c", "\x85", "<|endoftext|>", "\r\n", "日", "Word", " the"]
    for _ in range(600):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 8))]
        raw = [t.encode() for t in texts]
        got, count = ids.batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert count.tolist() == list(map(len, want)) and got.tolist() == [i for w in want for i in w]


def worst_fit(lengths, capacity):
    """Piece by piece: the longest first, into the shortest pack that is open, or a new one."""
    packs = []
    for l in sorted(lengths, reverse=True):
        if packs and packs[0] + l <= capacity:
            packs[0] += l
        else:
            packs.append(l)
        packs.sort()
    return packs


def test_patterns_equal_packing_piece_by_piece():
    from perflog.llm.length_packing import filled, shortest_pack_first
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([8, 13, 64])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 120))]
        patterns = shortest_pack_first(Counter(lengths), capacity)
        assert sorted(filled(r) for n, r in patterns for _ in range(n)) == worst_fit(lengths, capacity)
        used = Counter()
        for n, runs in patterns:
            for l, m in runs:
                used[l] += n * m
        assert used == Counter(lengths)


@pytest.mark.parametrize("slack", [0, 3])
def test_plan_places_every_token_once(slack):
    from perflog.llm.length_packing import Plan
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([16, 64])
        low = rng.choice([1, capacity // 2 + 1])
        count = Counter(rng.randrange(low, capacity) for _ in range(rng.randrange(1, 200)))
        plan, fill = Plan(count, capacity, slack), defaultdict(list)
        for l, n in count.items():
            sequence, offset = plan.place(np.full(n, l), np.arange(n))
            for s, o in zip(sequence.tolist(), offset.tolist()):
                parts = [(0, l, s, o)] if s >= 0 else plan.cuts(o, l)
                assert [a for a, *_ in parts] == [sum(p[1] for p in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) == l
                for _, m, s, o in parts:
                    fill[s].append((o, m))
        sizes = []
        for pieces in fill.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [sum(m for _, m in pieces[:k]) for k in range(len(pieces))]
            sizes.append(sum(m for _, m in pieces))
        # what is padded has little room, all else is full or a power of two, each of these at most once
        short = [x for x in sizes if capacity - x > slack]
        assert all(x & (x - 1) == 0 for x in short) and len(set(short)) == len(short)


def test_work_does_not_follow_counts():
    from perflog.llm.length_packing import Plan
    few, many = (Plan({l: k * (l % 7 + 1) for l in range(1, 1024)}, 1024, 8) for k in (1000, 10**12))
    assert len(many.slots) < 1.2 * len(few.slots) < 20_000


def check(df, tok, length=1024, **options):
    from perflog.llm.length_packing import pack
    from perflog.llm.queries import vocabulary
    rows = pack(df, vocabulary("byte_bpe_50k.json"), length=length, **options).collect()
    want = Counter()
    docs = {}
    for r in df.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id] += len(ids)
        docs.setdefault(r.doc_id, []).append(ids)
    got, places = Counter(), defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.length
        assert any(len(d) == r.doc_tokens and zlib.crc32(np.array(d[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
                   for d in docs[r.doc_id])
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for i, texts in docs.items():
        if len(texts) == 1:
            cut = sorted((r.start, r.length) for r in rows if r.doc_id == i)
            assert [s for s, _ in cut] == [sum(n for _, n in cut[:k]) for k in range(len(cut))]
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= length
    return [sum(n for _, n in x) for x in places.values()]


@pytest.mark.parametrize("length", [16, 1024])
def test_odd_documents(spark, tok, length):
    df = spark.createDataFrame(brute.odd_documents(), brute.SCHEMA)
    check(df.selectExpr("*", "1 as sequence_id", "2 as __ids", "3 as `a.b`", "4 as length"), tok, length)
    assert check(df.limit(0), tok) == []


def test_hot_length_just_over_half(spark, tok):
    """A third and more of all documents have one length of which two don't fit: without cuts 40 % would be padding."""
    text = " word" * 612
    sizes = check(spark.range(300).selectExpr("id as doc_id", f"if(id % 3 = 0, '{' x' * 900}', '{text}') as text").repartition(7), tok)
    assert sum(1024 - s for s in sizes if s & (s - 1)) <= 8 * len(sizes)


def test_real_documents(spark, tok):
    sizes = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tok)
    assert sum(1024 - s for s in sizes if s & (s - 1)) < 0.005 * sum(sizes)
