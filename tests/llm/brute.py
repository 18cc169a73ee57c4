"""Slow, plain versions of the operators' contracts, and odd documents to try them on."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def odd_documents():
    """Null texts and ids, empty and long texts, repeated rows, copies, and shared passages."""
    rng = __import__("random").Random(5)
    vocab = ["w%d" % i for i in range(400)] + ["Ünï", "İx", "a|b", "#", "$5", "x<y>", "日本"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, long = make(120), make(6000)
    passage = make(40)
    edited = base.split()
    edited[60] = "changed"
    rows = [
        (1, base), (2, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two three"),
        (8, "One TWO three"), (9, long), (10, long + " tail"), (11, make(50) + "\n" + passage + "\n" + make(30)),
        (12, make(20) + " " + passage + " " + make(10)), (13, "a\na\n\n a\na b\na b\n"), (14, "x " * 300), (15, "x " * 290),
        (16, "aaaa" * 400), (17, "aaaa" * 300), (None, make(60)), (None, None), (18, "a b c d e"), (19, "A b C d e"),
        (20, "\x1c w \x1cz \x85 q  r"), (21, base + "\x0b" + passage), (2, make(70)),
    ]
    return [(i, t, "en", "src%d" % (k % 3) if k % 7 else None, len(t or "")) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text_figures(t):
    ws = words(t)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    count = Counter(grams)
    inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(ws), sum(map(len, ws)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(inside))


def window_dedup(docs, k=13):
    least = {}
    order = lambda i: float("inf") if i is None else i
    for i, t in docs:
        ws = words(t)
        for j in range(len(ws) - k + 1):
            g = tuple(ws[j:j + k])
            least[g] = min(least.get(g, float("inf")), order(i))
    out = []
    for i, t in docs:
        ws = words(t)
        gone = set()
        for j in range(len(ws) - k + 1):
            if least[tuple(ws[j:j + k])] < order(i):
                gone.update(range(j, j + k))
        kept = " ".join(w for j, w in enumerate(ws) if j not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def byte_dedup(docs, k=400):
    raw = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(b[j:j + k] for _, b in raw for j in range(len(b) - k + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for j in range(len(b) - k + 1):
            if count[b[j:j + k]] > 1:
                gone[j:j + k] = b"\1" * k
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(t, k=5):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)]
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) or frozenset([tuple(ws)])


def components(docs, percent=80):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    done = set()
    for rows in index.values():
        for a in range(len(rows)):
            for b in range(a):
                x, y = rows[b], rows[a]
                if (x, y) not in done:
                    done.add((x, y))
                    both = len(sets[x] & sets[y])
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        parent[find(x)] = find(y)
    least = {}
    key = lambda i: float("inf") if docs[i][0] is None else docs[i][0]
    for i in range(len(docs)):
        r = find(i)
        least[r] = min(least.get(r, float("inf")), key(i))
    return [(d[0], len(s), None if least[find(i)] == float("inf") else least[find(i)]) for i, (d, s) in enumerate(zip(docs, sets))]


def crc(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
