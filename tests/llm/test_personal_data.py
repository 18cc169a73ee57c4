"""Personal data: base spans against plain regular expressions, the added kind, redaction."""

import hashlib
import random
import re

import pytest

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")),
            "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def plain(t):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, t or "") if passes(kind, m.group())]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(out)]


def odd_texts():
    rng = random.Random(4)
    bits = ["a.b@c.d", "@", ".", "_x@y", "1.2.3.4", "256.1.1.1", "0255.1.2.003", "4041894974608795", "4041 8949 7460 8795", "4041-8949-7460-8795",
            "4111111111111111111", "+1 (988) 555-2485", "+", "+44.20.7946.0958", "é", "日本", " ", "-", "--", "  ", "\n", "x", "9", "12", "\u0001", "\u0002", "😀", "%", "(", ")"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    texts += [None, "", "a@b.c._d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "a" * 50_000 + "@b.c", "1" * 50_000, "1 " * 30_000, "a." * 20_000 + "@x.y" + ".z" * 20_000,
              "+1" + " 2" * 20_000, "9.9.9.9 " * 3000]
    return texts


def test_base_spans(spark):
    from perflog.llm.personal_data import find_personal_data
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in find_personal_data(rows).collect():
        want = plain(texts[r.doc_id])
        got = [x for x in r.spans.split(",") if x and not x.startswith("secret")]
        assert got == want, texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k) for x in want) for k in BASE)


def test_real_documents(spark):
    from perflog.llm.personal_data import find_personal_data
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    keys = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]+)"', t or "")}
    got = set()
    for r in find_personal_data(docs).collect():
        spans = [x for x in r.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("secret")] == plain(texts[r.doc_id])
        got |= {(r.doc_id, *map(int, x.split(":")[1:])) for x in spans if x.startswith("secret")}
    assert got == keys


def test_reliabilities(spark):
    """Labelers that agree with the truth come out reliable, a noisy one less so."""
    from perflog.llm.personal_data import expectation_maximisation
    rng = random.Random(2)
    rows = {}
    for _ in range(5000):
        y = rng.random() < 0.3
        votes = tuple((1 if (y if rng.random() < p else not y) else -1) if rng.random() < 0.9 else 0 for p in (0.95, 0.9, 0.9, 0.6, 0.85))
        rows[votes] = rows.get(votes, 0) + 1
    out = expectation_maximisation(spark.createDataFrame([(list(v), float(n)) for v, n in rows.items()], "votes array<int>, n double")).collect()
    right = out[0].right
    assert abs(right[0] - 0.95) < 0.03 and abs(right[3] - 0.6) < 0.05 and abs(out[0].prior - 0.3) < 0.05


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a@b.co"), (None, "a@b.co"), (2, "")]])
def test_odd_input(spark, rows):
    from perflog.llm.personal_data import find_personal_data, redact
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h1 int, kind string")
    assert len(find_personal_data(df).collect()) == len(rows)
    assert sorted(map(repr, [(r.doc_id, r.text) for r in redact(df).collect()])) == sorted(
        map(repr, [(i, t and t.replace("a@b.co", "[email]")) for i, t in rows]))


def test_redaction(spark):
    from perflog.llm.personal_data import redact
    t = "é mail a.b@c.d, card 4041 8949 7460 8795 host 10.0.0.1 tel +1 (988) 555-2485."
    got = redact(spark.createDataFrame([(1, t, 7)], "doc_id long, text string, n int")).collect()
    assert [tuple(r) for r in got] == [(1, "é mail [email], card [card] host [ip] tel [phone].", 7)]
