"""Merkle manifest against a plain tree, and the van Emde Boas layout."""

import sys
import zlib
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root, and for every leaf the (before, after) of each level."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for s, i in zip(steps, at):
            run = level[i - i % 3:i - i % 3 + 3]
            s.append(("".join(run[:i % 3]), "".join(run[i % 3 + 1:])))
        level = [h(level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], steps


def manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by = {}
    for i, text, lang, source, n in rows:
        leaf = h(map(field, (i, source, lang, n, text)))
        odd = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        other = h(map(field, (i, source, lang, n, None if text is None else text.replace("\n", "")))) if odd else leaf
        by.setdefault(source, []).append((i, leaf, other))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in by[s]])
    if not order:
        return []
    root, top = tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, top):
        for (i, leaf, other), steps in zip(by[s], trees[s][1]):
            steps = steps + above
            x = other
            for a, b in steps:
                x = h([a, x, b])
            out.append((i, leaf, trees[s][0], root, h(a + b for a, b in steps), x, x == root))
    return out


def check(df, **options):
    from perflog.llm.merkle import manifest_check
    got = [tuple(r) for r in manifest_check(df, **options).collect()]
    want = manifest([tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return got


@pytest.mark.parametrize("levels", range(1, 8))
def test_layout(levels):
    """Every address once; a subtree cut at half the height lies in one piece, below its top half."""
    from perflog.llm.merkle import layout, nodes_of
    at = layout(levels)
    assert sorted(np.concatenate(at).tolist()) == list(range(nodes_of(levels)))
    top = levels // 2
    if top:
        assert max(a.max() for a in at[:top]) < nodes_of(top)
        for i in range(3 ** top):
            mine = np.concatenate([a.reshape(3 ** top, -1)[i] for a in at[top:]])
            assert mine.max() - mine.min() + 1 == len(mine) == nodes_of(levels - top)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27])
def test_block(n):
    from perflog.llm.merkle import build_block, fold, levels_for, siblings, steps_of
    leaves = [sha256(bytes([i])).hexdigest() for i in range(n)]
    root, steps = tree(leaves)
    levels = levels_for(n)
    store = build_block(np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, 32), levels)
    below = siblings(store, levels, n)
    assert store[0].tobytes().hex() == root
    for i in range(n):
        got = steps_of(below, i)
        assert [(a.decode(), b.decode()) for a, b in got] == steps[i]
        assert fold(leaves[i].encode(), got).decode() == root


@pytest.mark.parametrize("height", [1, 2, 8])
def test_odd_documents(spark, height):
    rows = brute.odd_documents()
    rows += [(7, "same", None, "src1", None)] * 5 + [(30, "a\nb", "en", "é", 3), (31, "lone", "en", "", 4)]
    check(spark.createDataFrame(rows, brute.SCHEMA), height=height)


def test_empty_one_row_and_clashing_columns(spark):
    check(spark.createDataFrame([], brute.SCHEMA))
    one = spark.createDataFrame([(None, None, None, None, None)], brute.SCHEMA)
    (row,) = check(one)
    assert row[1] == row[2] == row[3] and row[6]
    df = spark.createDataFrame(brute.odd_documents()[:6], brute.SCHEMA)
    extra = df.selectExpr("*", "1 as leaf", "'x' as root", "2 as __k", "3 as __rank", "4 as `a.b`")
    assert check(extra) == check(df)


def test_hot_source_is_many_blocks(spark):
    from perflog.llm.merkle import build_manifest
    df = spark.range(500).selectExpr("id as doc_id", "'t' || id as text", "'en' as lang",
                                     "if(id % 5 = 0, 's' || id % 15, 'hot') as source", "1L as n_chars")
    m = build_manifest(df, height=2)
    counts = [b.where("__k = '=hot'").count() for b in m.blocks]
    assert counts == [45, 5, 1] and m.blocks[0].agg({"__n": "max"}).first()[0] == 9
    check(df, height=2)


def test_real_documents(spark):
    from perflog.llm.queries import QUERIES
    want = manifest([tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
                     .select("doc_id", "text", "lang", "source", "n_chars").collect()])
    got = [tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and 0 < sum(r[6] for r in got) < len(got)
