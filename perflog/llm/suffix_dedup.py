"""Byte-string dedup by threshold-bounded interval expansion (operator 3).

Places are dealt to tasks by content: a window of ``length`` bytes chooses the rightmost of its
least ``CORE``-byte hashes as its anchor, so equal windows choose equal anchors at equal
distances. Windows of a text that share an anchor are one run; runs whose anchor occurs nowhere else
are dropped. The others' bytes go to shards by anchor, runs with equal bytes only once, with
their number as weight (and neighbouring runs that have no variants as one stretch).

A shard's strings become one Burrows-Wheeler transform. Intervals of suffixes are expanded
breadth first by backward extension: the intervals of all strings of l + 1 symbols, made from
those of l symbols, bound common prefixes of l, so prefixes come in rising order, and the
expansion stops at ``length``. Neighbouring suffixes that no interval has parted by then share
``length`` bytes; a class of them that weighs two or more is a repeated string. Marks go back to all runs of equal
bytes, covered bytes are removed, and texts without marks are never moved.

An anchor with more than ``most_variants`` different runs (a passage in many contexts) is split: a window holds
half of the missing bytes to the left or to the right of its core, which join the key, and so on
until the groups are small; groups of one are dropped on the way.

Null text is empty. Texts are told apart by 64-bit hash and length. Repeated rows repeat each other. Texts
shorter than ``length`` stay whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perflog.llm.runtime import bitmap, has_bit, pow2, ready, stage, text_hash
from perflog.llm.words import U, mix, powers

CORE = 128
#: Windows of a text that one numpy pass works on, bytes of a stretch, and bytes of a shard (on average).
PASS, STRETCH, SHARD = 1 << 19, 1 << 14, 1 << 18


def anchor_runs(text: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """first window, windows, anchor's distance, anchor hash and content hash of every run of windows of one text."""
    n, wide = len(text), length - CORE + 1
    windows = n - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    forth, back = powers(max(n + 1, 1 << 16))
    total = np.zeros(n + 1, U)
    np.cumsum((text.astype(U) + U(1)) * forth[:n], out=total[1:])
    m = n - CORE + 1
    g = mix((total[CORE:] - total[:m]) * back[:m]) >> U(1)
    # least hash of every window, by least hashes from both ends of blocks as wide as a window
    blocks = -(-m // wide)
    x = np.full(blocks * wide, U(1 << 63))
    x[:m] = g
    x = x.reshape(blocks, wide)
    place = np.arange(blocks * wide).reshape(blocks, wide)
    left = np.minimum.accumulate(x, axis=1)
    left_at = np.maximum.accumulate(np.where(x == left, place, 0), axis=1).ravel()
    turned = x[:, ::-1]
    right = np.minimum.accumulate(turned, axis=1)
    step = np.ones(x.shape, bool)
    step[:, 1:] = right[:, 1:] < right[:, :-1]
    back_place = np.arange(wide)
    right_at = np.maximum.accumulate(np.where(step, back_place, 0), axis=1)
    right_at = (place[:, -1:] - right_at)[:, ::-1].ravel()
    right, left = right[:, ::-1].ravel()[:windows], left.ravel()[wide - 1:wide - 1 + windows]
    at = np.where(left <= right, left_at[wide - 1:wide - 1 + windows], right_at[:windows])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    size = np.diff(np.append(first, windows))
    at = at[first]
    content = mix((total[first + size - 1 + length] - total[first]) * back[first] ^ ((at - first).astype(U) << U(32)) ^ (size.astype(U) << U(48)))
    return first, size, at - first, g[at].view(np.int64), content.view(np.int64)


def runs(docs: DataFrame, length: int) -> DataFrame:
    """rid, key (anchor), c (content), first, n and le (bytes before the anchor) of every run of every text."""

    def go(batches):
        names = ["rid", "key", "c", "first", "n", "le"]

        def batch(parts):
            rid, first, size, le, key, c = (np.concatenate(p) for p in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(key), pa.array(c), pa.array(first), pa.array(size.astype(np.int32)),
                                               pa.array(le.astype(np.int32))], names)

        for b in batches:
            held, rows = [], 0
            for rid, t in zip(b.column(0).to_pylist(), b.column(1)):
                if not t.is_valid:
                    continue
                text = np.frombuffer(t.as_buffer(), np.uint8)
                for cut in range(0, max(0, len(text) - length + 1), PASS):
                    first, *rest = anchor_runs(text[cut:cut + PASS + length - 1], length)
                    held.append((np.full(len(first), rid), first + cut, *rest))
                    rows += len(first)
                if rows > 1 << 17:
                    yield batch(held)
                    held, rows = [], 0
            if rows:
                yield batch(held)

    return docs.select("__rid", "__text").mapInArrow(go, "rid long, key long, c long, first long, n int, le int")


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first ``depth`` symbols, by prefix doubling from packed symbols."""
    n = len(symbols)
    code = np.zeros(257, np.int64)
    used = np.unique(symbols)
    code[used] = np.arange(1, len(used) + 1)
    base = len(used) + 1
    wide = max(1, min(depth, int(62 / math.log2(base))))
    padded = np.concatenate([code[symbols], np.zeros(wide, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(wide):
        key = key * base + padded[j:j + n]
    rank = np.empty(n, np.int64)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        number = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        if wide >= depth or number[-1] == n:
            return order
        rank[order] = number
        step = min(wide, depth - wide)
        key = rank * (n + 1)
        key[:n - step] += rank[step:]
        wide += step


def parted(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix of ``order`` differs from the one before within ``depth`` symbols.

    Symbol 0 ends strings; nothing is extended over it. An interval is kept for extension only if it
    has newly bounded a common prefix, so all intervals together are at most two for each suffix."""
    n = len(symbols)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    to_row = np.empty(n, np.int64)
    to_row[by_symbol] = np.arange(n)
    before, after = np.full(n, -1), np.full(n, n)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    live = bwt != 0
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    low, high = np.array([0]), np.array([n])
    for _ in range(depth):
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        row = np.arange(len(which)) + np.repeat(low - (np.cumsum(size) - size), size)
        ok = live[row]
        # a symbol's first and last rows in an interval bound the interval of the longer string
        a = np.sort(to_row[row[ok & (before[row] < low[which])]])
        b = np.sort(to_row[row[ok & (after[row] >= high[which])]]) + 1
        new = ~bound[a] | ~bound[b]
        bound[a] = bound[b] = True
        low, high = a[new], b[new]
        if not len(low):
            break
    return bound[:n]


def repeated(strings: list[bytes], weights: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For every string, which of its windows (as many as it has weights) occur twice or more by weight among all."""
    symbols = np.zeros(sum(len(s) + 1 for s in strings), np.int16)
    weight = np.zeros(len(symbols))
    starts, at = [], 0
    for s, w in zip(strings, weights):
        symbols[at:at + len(s)] = np.frombuffer(s, np.uint8).astype(np.int16) + 1
        weight[at:at + len(w)] = w
        starts.append(at)
        at += len(s) + 1
    order = suffix_order(symbols, length)
    group = np.cumsum(parted(symbols, order, length)) - 1
    heavy = np.zeros(len(symbols), bool)
    heavy[order] = (np.bincount(group, weights=weight[order]) >= 2)[group]
    return [heavy[a:a + len(w)] for a, w in zip(starts, weights)]


SPAN = "shard long, keys array<long>, cs array<long>, ws array<long>, ns array<int>, le int, core int, variants long, bytes binary"


def spans(texts: DataFrame, length: int, most_variants: int) -> DataFrame:
    """Bytes of the runs that a text stands for: runs with variants one by one, neighbouring ones without as stretches."""

    def go(batches):
        for b in batches:
            rows = []
            for text, items in zip(b.column(0), b.column(1).to_pylist()):
                raw, last = text.as_buffer().to_pybytes(), None
                for r in sorted((r for r in items if r["own"]), key=lambda r: r["first"]):
                    if last and last["variants"] == r["variants"] == 1 and last["to"] == r["first"] and r["first"] - last["from"] < STRETCH:
                        for name, value in (("keys", "key"), ("cs", "c"), ("ws", "w"), ("ns", "n")):
                            last[name].append(r[value])
                        last["to"] += r["n"]
                    else:
                        last = {"keys": [r["key"]], "cs": [r["c"]], "ws": [r["w"]], "ns": [r["n"]], "le": r["le"], "core": CORE, "shard": r["key"],
                                "variants": r["variants"], "from": r["first"], "to": r["first"] + r["n"]}
                        rows.append(last)
                        last["raw"] = raw
            for r in rows:
                r["bytes"] = r["raw"][r["from"]:r["to"] - 1 + length]
            yield pa.RecordBatch.from_pylist([{k: v for k, v in r.items() if k not in ("raw", "from", "to")} for r in rows], schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("keys", pa.list_(pa.int64())), ("cs", pa.list_(pa.int64())), ("ws", pa.list_(pa.int64())),
                        ("ns", pa.list_(pa.int32())), ("le", pa.int32()), ("core", pa.int32()), ("variants", pa.int64()), ("bytes", pa.binary())])
    return texts.select("text", "items").mapInArrow(go, SPAN)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def halves(hot: DataFrame, length: int) -> DataFrame:
    """Both halves of the windows of hot runs: parent key and content, shift, and the child's key, c, w, n, le, core, bytes."""
    schema = "pkey long, pc long, shift int, key long, c long, w long, n int, le int, core int, bytes binary"

    def go(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                raw, s, n, key = r["bytes"], r["le"], r["ns"][0], r["keys"][0]
                half = (length - r["core"] + 1) // 2
                cut = min(n, max(0, s - half + 1))  # windows before it hold ``half`` more bytes to the left of the core
                for side, x, y, lo in ((b"l", 0, cut, s - half), (b"r", cut, n, s)):
                    if x < y:
                        part = raw[x:y - 1 + length]
                        core = raw[lo:lo + r["core"] + half]
                        rows.append({"pkey": key, "pc": r["cs"][0], "shift": x, "key": _number(side, str(key).encode(), core),
                                     "c": _number(part, str(lo - x).encode()), "w": r["ws"][0], "n": y - x, "le": lo - x, "core": len(core), "bytes": part})
            kinds = pa.schema([("pkey", pa.int64()), ("pc", pa.int64()), ("shift", pa.int32()), ("key", pa.int64()), ("c", pa.int64()), ("w", pa.int64()),
                               ("n", pa.int32()), ("le", pa.int32()), ("core", pa.int32()), ("bytes", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return hot.select("keys", "cs", "ws", "ns", "le", "core", "bytes").mapInArrow(go, schema)


def expand(ready_spans: DataFrame, length: int) -> DataFrame:
    """key, c and places (window ranges, flat) of runs with repeated windows, shard by shard."""
    total = ready_spans.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD))

    def go(key, table):
        rows = table.select(["keys", "cs", "ws", "ns", "bytes"]).to_pylist()
        found = repeated([r["bytes"] for r in rows], [np.repeat(r["ws"], r["ns"]) for r in rows], length)
        out = {"key": [], "c": [], "places": []}
        for r, hit in zip(rows, found):
            at = 0
            for k, c, n in zip(r["keys"], r["cs"], r["ns"]):
                part = np.concatenate([[False], hit[at:at + n], [False]])
                edge = np.flatnonzero(part[1:] != part[:-1])
                at += n
                if len(edge):
                    out["key"].append(k)
                    out["c"].append(c)
                    out["places"].append(edge.tolist())
        return pa.table(out, schema=pa.schema([("key", pa.int64()), ("c", pa.int64()), ("places", pa.list_(pa.int32()))]))

    return (ready_spans.withColumn("shard", F.pmod(F.xxhash64("shard"), F.lit(shards))).groupBy("shard")
            .applyInArrow(go, "key long, c long, places array<int>"))


def marks(all_spans: DataFrame, length: int, most_variants: int) -> DataFrame:
    """key, c and places of every run with repeated windows, hot anchors split on the way."""
    found = expand(all_spans.where(F.col("variants") <= most_variants), length)
    hot = all_spans.where(F.col("variants") > most_variants)
    ways, deeper = [], []
    while not hot.isEmpty():
        child = stage(halves(hot, length), "halves")
        group = child.groupBy("key", "c").agg(F.sum("w").alias("w"), F.first("n").alias("n"), F.first("le").alias("le"), F.first("core").alias("core"),
                                              F.first("bytes").alias("bytes"))
        group = stage(group, "groups")
        size = group.groupBy("key").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("variants")).where("all > 1")
        group = stage(group.join(size, "key").select(
            F.col("key").alias("shard"), F.array("key").alias("keys"), F.array("c").alias("cs"), F.array("w").alias("ws"), F.array("n").alias("ns"), "le", "core",
            "variants", "bytes"), "variants")
        ways.append(child.select("pkey", "pc", "shift", "key", "c"))
        deeper.append(expand(group.where(F.col("variants") <= most_variants), length))
        hot = group.where(F.col("variants") > most_variants)
    below = None
    for way, own in zip(reversed(ways), reversed(deeper)):
        below = own if below is None else own.unionByName(below)
        shift = F.transform("places", lambda x: x + F.col("shift"))
        below = stage(below.join(way, ["key", "c"]).select(F.col("pkey").alias("key"), F.col("pc").alias("c"), shift.alias("places")), "below")
    return found if below is None else found.unionByName(below)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, most_variants: int = 300,
                   with_text: bool = False) -> DataFrame:
    """Id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) of every row: bytes covered by a string of ``length``
    bytes that also starts elsewhere are removed."""
    spark = ready(docs.sparkSession)
    if length <= CORE:
        raise ValueError(f"strings of more than {CORE} bytes only")
    t = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("__id"), text_hash(t).alias("__rid"), t.cast("binary").alias("__text"))
    long = docs.where(F.length("__text") >= length)
    every = stage(runs(long, length), "runs")
    twice = every.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    some = stage(every.join(twice, "key"), "candidates")
    contents = some.groupBy("key", "c").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct("rid", "first")).alias("rep"))
    variants = contents.groupBy("key").agg(F.count(F.lit(1)).alias("variants"))
    contents = stage(contents.join(variants, "key"), "contents")
    items = some.join(contents, ["key", "c"]).select("rid", F.struct(
        "first", "n", "le", "key", "c", "w", "variants", ((F.col("rep.rid") == F.col("rid")) & (F.col("rep.first") == F.col("first"))).alias("own")).alias("item"))
    items = stage(items.groupBy("rid").agg(F.collect_set("item").alias("items")), "items")
    bits = spark.sparkContext.broadcast(bitmap(items, "rid", pow2(32 * max(1, items.count()), 1 << 16, 1 << 28)))

    def pick(batches):
        for b in batches:
            hit = pa.array(has_bit(bits.value, b.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(hit), b.column(1).filter(hit)], ["rid", "text"])

    texts = long.select("__rid", "__text").mapInArrow(pick, "rid long, text binary").groupBy("rid").agg(F.first("text").alias("text"))
    texts = stage(texts.join(items, "rid"), "texts")
    pieces = stage(spans(texts, length, most_variants), "spans")
    places = marks(pieces, length, most_variants)
    members = texts.select("rid", F.explode("items").alias("i")).select("rid", "i.first", "i.key", "i.c")
    hits = members.join(places, ["key", "c"]).select("rid", F.struct("first", "places").alias("p")).groupBy("rid").agg(F.collect_list("p").alias("places"))
    names = ["rid", "n_removed", "n_spans", "sha"] + ["kept"] * with_text

    def cut(batches):
        for b in batches:
            out = {n: [] for n in names}
            for rid, text, places in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = text.as_buffer()
                step = np.zeros(len(raw) + 1, np.int64)
                for p in places:
                    x = p["first"] + np.array(p["places"], np.int64).reshape(-1, 2)
                    np.add.at(step, x[:, 0], 1)
                    np.add.at(step, np.minimum(x[:, 1] - 1 + length, len(raw)), -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                row = [rid, int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), hashlib.sha256(kept).hexdigest(), kept]
                for n, v in zip(names, row):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("rid", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("sha", pa.string())]
                                                                   + [("kept", pa.binary())] * with_text))

    done = texts.select("rid", "text").join(hits, "rid").mapInArrow(cut, "rid long, n_removed long, n_spans long, sha string" + ", kept binary" * with_text)
    rows = docs.select("__id", "__rid", F.length("__text").cast("long").alias("n_bytes"), F.sha2("__text", 256).alias("whole"),
                       *[F.col("__text")] * with_text)
    out = rows.join(done, F.col("__rid") == F.col("rid"), "left")
    return out.select(F.col("__id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
                      *[F.coalesce("kept", "__text").alias("kept")] * with_text)
