"""The pipeline's stages, each against a plain version on its own input, and run() against them all."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
from test_personal_data import BASE, passes  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df, cols):
    return sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())


@pytest.fixture(scope="module")
def steps(spark):
    import corpus_pipeline as P
    from perflog.llm.runtime import stage
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in P.STAGES:
        out.append(stage(f(spark, out[-1], SF), name))
    return out


def test_columns(steps):
    for s in steps[1:5]:
        assert s.columns == steps[0].columns


def test_toxicity_drops_only_toxic(spark, steps):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r.doc_id for r in steps[0].join(steps[1], "doc_id", "left_anti").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert gone & toxic and not gone & clean


def test_one_of_each_group_stays(steps):
    docs = [(r.doc_id, r.text) for r in steps[1].orderBy("doc_id").collect()]
    want = sorted(i for i, n, c in brute.components(docs) if n == 0 or i == c)
    assert sorted(r.doc_id for r in steps[2].collect()) == want


def test_leaks_go(spark, steps):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = sorted(r.doc_id for r in steps[2].collect() if not any(t in (r.text or "") for t in items))
    assert sorted(r.doc_id for r in steps[3].collect()) == want


def test_personal_data_is_gone(steps):
    assert steps[3].count() == steps[4].count()
    for r in steps[4].collect():
        assert r.n_chars == len(r.text)
        for kind, pattern in BASE.items():
            assert not [m for m in re.finditer(pattern, r.text) if passes(kind, m.group())]
    assert {r.doc_id for r in steps[4].collect() if "[" in r.text}


def test_run(spark, steps):
    import corpus_pipeline as P
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(P.run(spark, SF), cols) == rows(steps[5], cols)
    import public_tokenizers as T
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(T.path("word_bpe_49k.json"))
    want = []
    for r in steps[4].collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, k, s, len(ids[s:s + 2048]), brute.crc(ids[s:s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    assert rows(steps[5], cols) == sorted(map(repr, want))


def test_odd_documents_pass_every_stage(spark):
    import corpus_pipeline as P
    from perflog.llm.runtime import stage
    odd = spark.createDataFrame([(*r, 1.5, "x") for r in brute.odd_documents()], brute.SCHEMA + ", score double, sequence_id string")
    empty = odd.where("false")
    for docs in (odd, empty):
        for name, f in P.STAGES:
            out = stage(f(spark, docs, SF), name)
            assert name == "packing" or out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) == (out is not None and docs.count() > 0)
