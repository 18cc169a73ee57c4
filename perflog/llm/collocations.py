"""Phrase collocations by multikey quicksort of suffix pointers (operator 11).

A suffix is the run of up to five words that starts at a word of a piece. Suffixes are routed by their leading words,
so that all that share them meet in one task; there a three-way quicksort parts the pointers by one
word after another. A part whose pointers are equal in their first words has the phrase's occurrences
as its size; a part of fewer than ``least`` occurrences holds no candidate and is abandoned. All parts of a
task are split in step, as arrays.

*Less to route.* A suffix ends before its first pair of words that is surely infrequent: words
are counted exactly, pairs by a sketch that only overestimates. Its size is bounded; beyond the bound
it lets more suffixes through and results stay the same. Equal suffixes of a task are one with a weight.

*Hot words.* A suffix is routed by its first word unless that word occurs more than ``hot`` times, else by two unless the
pair does, and so on, so no task gets more than ``hot`` suffixes that it can't tell apart beforehand. A phrase
shorter than its suffixes' route is counted in several tasks and summed; such parts are not abandoned.

Words and languages are told apart by 64-bit hashes. Null text counts as empty, null lang as ``und``. Repeated
rows count as often as they are there; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perflog.llm.runtime import bitmap, chunks, few, has_bit, pow2, ready, stage, utf8
from perflog.llm.window_dedup import gaps, ungaps
from perflog.llm.words import LOWER, U, Words, mix

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = BREAK.copy()
BETWEEN[[0x20, 0x09]] = True
#: Ranges of counters that the sketch of pairs is dealt by.
RANGES = 64
#: Words or suffixes that a task gathers before it sends them.
GATHER = 1 << 20
HOT_BITS = 1 << 20
#: Parts in which the best phrases of a language are found first.
SALTS = 64


def phrase_words(data: np.ndarray, offs: np.ndarray, lang: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words of texts, their hashes with the language's (never 0), and which are followed by a word of their piece."""
    w = Words(data, offs, BETWEEN, LOWER)
    h = np.maximum(mix(w.hash ^ lang[w.row]), U(1))
    piece = np.cumsum(BREAK[data])[w.start]
    follows = np.zeros(len(h), bool)
    follows[:-1] = (w.row[1:] == w.row[:-1]) & (piece[1:] == piece[:-1])
    return w, h, follows


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    return docs.select(lang.alias("__lang"), F.xxhash64(lang).alias("__h"), F.col(f"`{text_col}`").alias("__text"))


def each_chunk(batches) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Languages, their hashes, bytes and offsets of chunks of texts."""
    for b in batches:
        mark = b.column(1).to_numpy(zero_copy_only=False).view(U)
        data, offs = utf8(b.column(2))
        for lo, hi in chunks(offs):
            yield b.column(0).slice(lo, hi - lo), mark[lo:hi], data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, h, n of every word of a language, and with a null word the number of all."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, n = (np.concatenate(x) for x in list(zip(*held))[:2])
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            total = np.bincount(which, n).astype(np.int64)
            lang, word = (pa.concat_arrays([x[k] for x in held]).take(pa.array(first)) for k in (2, 3))
            sums = pa.table([lang, pa.array(total)], ["lang", "n"]).group_by("lang").aggregate([("n", "sum")]).combine_chunks()
            lang = pa.concat_arrays([lang, sums.column("lang").chunk(0)])
            word = pa.concat_arrays([word, pa.nulls(len(sums), pa.string())])
            h = np.concatenate([h[first].view(np.int64), np.zeros(len(sums), np.int64)])
            return pa.RecordBatch.from_arrays([lang, word, pa.array(h), pa.array(np.concatenate([total, sums.column("n_sum").to_numpy()]))],
                                              ["lang", "word", "h", "n"])

        for lang, mark, data, offs in each_chunk(batches):
            w, h, _ = phrase_words(data, offs, mark)
            if not len(h):
                continue
            _, at, n = np.unique(h, return_index=True, return_counts=True)
            length = w.end[at] - w.start[at]
            edge = np.concatenate([[0], np.cumsum(length)])
            raw = LOWER[data[np.repeat(w.start[at] - edge[:-1], length) + np.arange(edge[-1])]]
            words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            held.append((h[at], n, lang.take(pa.array(w.row[at])), words))
            size += len(at)
            if size >= GATHER:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return docs.mapInArrow(run, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


class Pairs:
    """Bits of what may be frequent: words (exact but for equal bits) and pairs of them (estimated from above), and what may be hot."""

    def __init__(self, words: np.ndarray, hot_words: np.ndarray, counters: int):
        self.words, self.hot_words, self.counters = words, hot_words, counters
        self.pairs, self.hot_pairs = np.zeros(counters // 8, np.uint8), np.zeros(HOT_BITS // 8, np.uint8)
        self.left = 0

    def slots(self, pair: np.ndarray) -> np.ndarray:
        return (pair >> U(64 - self.counters.bit_length() + 1)).astype(np.int64)

    def linked(self, h: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Places of pairs of neighbours that are both frequent words."""
        may = has_bit(self.words, h)
        may[:-1] &= may[1:] & follows[:-1]
        may[-1:] = False
        return np.flatnonzero(may)


def sketch_pairs(docs: DataFrame, pairs: Pairs, least: int, hot: int) -> None:
    """Fill in the bits of pairs. The counters are dealt by ranges, so no task and no row holds them all."""
    sent = docs.sparkSession.sparkContext.broadcast(pairs)
    width = pairs.counters // RANGES

    def parts(batches):
        held, size = [], 0

        def flush():
            s, n = np.unique(np.concatenate(held), return_counts=True)
            edge = np.searchsorted(s, np.arange(RANGES + 1) * width)
            rows = [(r, gaps(s[a:b] - r * width), gaps(s[a:b][n[a:b] > 1] - r * width), (n[a:b][n[a:b] > 1] - 1).astype("<u4").tobytes())
                    for r, a, b in zip(range(RANGES), edge[:-1], edge[1:]) if a < b]
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                              ["range", "once", "again", "more"])

        for _, mark, data, offs in each_chunk(batches):
            _, h, follows = phrase_words(data, offs, mark)
            at = sent.value.linked(h, follows)
            if len(at):
                held.append(sent.value.slots(pair_hash(h[at], h[at + 1])))
                size += len(at)
                if size >= 4 * GATHER:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(width, np.int64)
        for b in batches:
            for once, again, more in zip(*(b.column(b.schema.get_field_index(c)) for c in ("once", "again", "more"))):
                count[ungaps(once.as_buffer())] += 1
                count[ungaps(again.as_buffer())] += np.frombuffer(more.as_buffer(), "<u4")
        r = key[0].as_py()
        much = np.unique((np.flatnonzero(count > hot) + r * width) % HOT_BITS).astype("<u4")
        yield pa.RecordBatch.from_pydict({
            "range": pa.array([r], pa.int32()), "bits": pa.array([np.packbits(count >= least, bitorder="little").tobytes()], pa.binary()),
            "hot": pa.array([much.tobytes()], pa.binary()), "left": pa.array([int(count[count >= least].sum())], pa.int64())})

    rows = docs.mapInArrow(parts, "range int, once binary, again binary, more binary").groupBy("range").applyInArrow(
        add, "range int, bits binary, hot binary, left long")
    for r in rows.toLocalIterator():
        lo = r.range * width // 8
        pairs.pairs[lo:lo + width // 8] = np.frombuffer(bytes(r.bits), np.uint8)
        x = np.frombuffer(bytes(r.hot), "<u4").astype(np.int64)
        np.bitwise_or.at(pairs.hot_pairs, x >> 3, (1 << (x & 7)).astype(np.uint8))
        pairs.left += r.left
    sent.unpersist()


def bit(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def suffixes(h: np.ndarray, follows: np.ndarray, pairs: Pairs, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of two and more words (rows of ``depth`` hashes, 0 beyond the end) and the number of words each is routed by."""
    at = pairs.linked(h, follows)
    slot = pairs.slots(pair_hash(h[at], h[at + 1]))
    often = bit(pairs.pairs, slot)
    at, slot = at[often], slot[often]
    good, much = np.zeros(len(h) + depth, bool), np.zeros(len(h) + depth, bool)
    good[at] = True
    much[at] = bit(pairs.hot_pairs, slot % HOT_BITS)
    out = np.zeros((len(at), depth), U)
    out[:, 0] = h[at]
    route = np.ones(len(at), np.uint8)
    still, deeper = np.ones(len(at), bool), has_bit(pairs.hot_words, h[at])
    for j in range(1, depth):
        route[deeper] = j + 1
        still &= good[at + j - 1]
        out[still, j] = h[at[still] + j]
        deeper = deeper & still & much[at + j - 1]
    return out, route


def row_hash(rows: np.ndarray, upto: np.ndarray | None = None) -> np.ndarray:
    x = np.full(len(rows), U(0x8CB92BA72F3D8DD7))
    for j in range(rows.shape[1]):
        y = mix(x * U(0x9E3779B97F4A7C15) + rows[:, j])
        x = y if upto is None else np.where(j < upto, y, x)
    return x


def packed(rows: np.ndarray, route: np.ndarray, weight: np.ndarray) -> bytes:
    """Suffixes as codes of their own dictionary, in order and column by column."""
    words, code = np.unique(rows, return_inverse=True)
    code = code.reshape(rows.shape).astype("<u2" if len(words) <= 1 << 16 else "<u4")
    order = np.lexsort(code.T[::-1])
    raw = b"".join([np.array([len(words), len(rows), rows.shape[1]], "<u4").tobytes(), words.astype("<u8").tobytes(),
                    np.ascontiguousarray(code[order].T).tobytes(), route[order].tobytes(), weight[order].astype("<u4").tobytes()])
    return np.array([len(raw)], "<u8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, codes (depth x suffixes), routes and weights."""
    raw = pa.decompress(blob[8:], int(np.frombuffer(blob, "<u8", 1)[0]), codec="zstd", asbytes=True)
    k, n, depth = np.frombuffer(raw, "<u4", 3).tolist()
    at, kind = 12 + 8 * k, np.dtype("<u2" if k <= 1 << 16 else "<u4")
    end = at + kind.itemsize * depth * n
    return (np.frombuffer(raw, "<u8", k, 12), np.frombuffer(raw, kind, depth * n, at).reshape(depth, n),
            np.frombuffer(raw, np.uint8, n, end), np.frombuffer(raw, "<u4", n, end + n))


def route_suffixes(docs: DataFrame, pairs: Pairs, buckets: int, depth: int) -> DataFrame:
    """bucket, blob: suffixes by the leading words that route them."""
    sent = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        held, size = [], 0

        def flush():
            rows, route = (np.concatenate(x) for x in zip(*held))
            _, first, weight = np.unique(row_hash(rows), return_index=True, return_counts=True)
            rows, route = rows[first], route[first]
            bucket = (row_hash(rows, route) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]]))
            for a, b in zip(edge[:-1], edge[1:]):
                some = order[a:b]
                yield int(bucket[some[0]]), packed(rows[some], route[some], weight[some])

        def batch():
            cols = list(zip(*flush()))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], ["bucket", "blob"])

        for _, mark, data, offs in each_chunk(batches):
            _, h, follows = phrase_words(data, offs, mark)
            if not len(h):
                continue
            rows, route = suffixes(h, follows, sent.value, depth)
            held.append((rows, route))
            size += len(rows)
            if size >= GATHER:
                yield batch()
                held, size = [], 0
        if size:
            yield batch()

    return docs.mapInArrow(run, "bucket long, blob binary")


def multikey_quicksort(code: np.ndarray, weight: np.ndarray, route: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A suffix that starts with the phrase, number of words and occurrences of every phrase of two and more words
    that occurs ``least`` times, or that is shorter than the route of its suffixes.

    ``code``: depth x suffixes, 0 beyond the end. All parts are split at once by the word in the middle of each."""
    depth = len(code)
    p = np.argsort(route, kind="stable")
    kinds, size = np.unique(route, return_counts=True)
    at, upto = np.zeros(len(kinds), np.int64), kinds.astype(np.int64)
    out = []
    while len(size):
        part = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        char = code[at[part], p]
        pivot = char[start + size // 2]
        side = 1 + (char > pivot[part]).astype(np.int8) - (char < pivot[part]).astype(np.int8)
        key = part * 3 + side
        total = np.bincount(key, weight[p], 3 * len(size)).astype(np.int64).reshape(-1, 3)
        count = np.bincount(key, minlength=3 * len(size)).reshape(-1, 3)
        partial = at + 1 < upto
        stay = (count > 0) & ((total >= least) | partial[:, None])
        stay[:, 1] &= pivot > 0
        found = np.flatnonzero(stay[:, 1] & (at >= 1))
        out.append((p[start[found] + size[found] // 2], at[found] + 1, total[found, 1]))
        stay[:, 1] &= at + 1 < depth
        # parts that stay, in place order: the smaller, the equal (one word deeper), the greater
        new = np.where(stay, count, 0)
        begin = (np.cumsum(new) - new.ravel()).reshape(-1, 3)
        q = np.empty(int(new.sum()), np.int64)
        for s in range(3):
            mine = np.flatnonzero((side == s) & stay[part, s])
            n = new[:, s]
            q[np.repeat(begin[:, s] - (np.cumsum(n) - n), n) + np.arange(len(mine))] = p[mine]
        keep = stay.ravel()
        at, upto = (np.repeat(x, 3)[keep] for x in (at, upto))
        at = at + np.tile([0, 1, 0], len(stay))[keep]
        p, size = q, new.ravel()[keep]
    first, length, n = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 3
    return first, length, n


def count_phrases(routed: DataFrame, least: int, depth: int) -> DataFrame:
    """words (hashes), a: phrases of two to ``depth`` words that occur ``least`` times."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpacked(x.as_py()) for b in batches for x in b.column(b.schema.get_field_index("blob"))]
        words = np.unique(np.concatenate([np.zeros(1, U), *[x[0] for x in parts]]))
        code = np.concatenate([np.searchsorted(words, x[0]).astype(np.int32)[x[1]] for x in parts], axis=1)
        route, weight = (np.concatenate([x[k] for x in parts]) for k in (2, 3))
        first, length, n = multikey_quicksort(code, weight, route, least)
        edge = np.concatenate([[0], np.cumsum(length)])
        column = np.arange(edge[-1]) - np.repeat(edge[:-1], length)
        flat = words[code[column, np.repeat(first, length)]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat)), pa.array(n)], ["words", "a"])

    return (routed.groupBy("bucket").applyInArrow(run, "words array<bigint>, a long")
            .groupBy("words").agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def best_cut(phrases: DataFrame, singles: DataFrame) -> DataFrame:
    """words, a, lang, n, and of the lowest-scoring cut l, r, score."""
    cuts = phrases.select("words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", 1, F.col("k")).alias("left"),
                       F.expr("slice(words, k + 1, size(words) - k)").alias("right"))
    # a single word's language and total come with it, so the last word of the right part brings them
    count = phrases.select("words", "a").unionByName(singles.select(F.array("h").alias("words"), F.col("n").alias("a")))
    left, right = (count.select(F.col("words").alias(x), F.col("a").alias(y)) for x, y in (("left", "l"), ("right", "r")))
    scored = (cuts.join(left, "left").join(right, "right")
              .join(singles.select(F.array("h").alias("first"), "lang", F.col("total").alias("n")), F.expr("slice(words, 1, 1)") == F.col("first")))
    exact = "decimal(38, 0)"
    scored = scored.withColumn("score", F.expr(
        f"cast(1000 as {exact}) * cast(a as {exact}) * cast(n as {exact}) div (cast(l as {exact}) * cast(r as {exact}))"))
    low = F.min(F.struct("score", "k", "l", "r")).alias("low")
    return scored.groupBy("words", "a", "lang", "n").agg(low).select("words", "a", "lang", "n", "low.l", "low.r", "low.score")


def inner(phrases: DataFrame) -> DataFrame:
    """words, most: for phrases inside longer ones, the count of the most frequent of these."""
    parts = F.expr("""flatten(transform(sequence(2, size(words) - 1), m ->
        transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))""")
    return phrases.where(F.size("words") > 2).select(F.explode(parts).alias("words"), "a").groupBy("words").agg(F.max("a").alias("most"))


def mine_collocations(docs: DataFrame, least: int = 100, top: int = 2000, share: int = 100, depth: int = 5, lang_col: str = "lang",
                      text_col: str = "text", hot: int = 1 << 21, bucket: int = 1 << 20, most_counters: int = 1 << 28) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of every language.

    ``share``: a phrase goes if a longer candidate that holds it occurs at least so many hundredths as often.
    ``bucket``: suffixes that a task sorts, about; ``hot``: occurrences from which a leading word or pair does not route alone."""
    spark = ready(docs.sparkSession)
    docs = texts(docs, lang_col, text_col)
    words = stage(few(count_words(docs).where((F.col("n") >= least) | F.col("word").isNull())), "frequent-words")
    totals = words.where("word is null").select("lang", F.col("n").alias("total"))
    n_words = totals.agg(F.sum("total")).first()[0] or 0
    singles = words.where("word is not null").join(totals, "lang")
    size = pow2(16 * singles.count(), 1 << 16, 1 << 28)
    pairs = Pairs(bitmap(singles, "h", size), bitmap(singles.where(F.col("n") > hot), "h", 1 << 16), pow2(n_words / 8, 1 << 20, most_counters))
    sketch_pairs(docs, pairs, least, hot)
    phrases = stage(few(count_phrases(route_suffixes(docs, pairs, max(1, -(-pairs.left // bucket)), depth), least, depth)), "phrases")
    kept = best_cut(phrases, singles).join(inner(phrases), "words", "left").where(
        F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    spelled = (kept.select("words", F.posexplode("words").alias("pos", "h")).join(singles.select("h", "word"), "h")
               .groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    listed = kept.join(spelled, "words").withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
    for by in (["lang", "salt"], ["lang"]):
        listed = listed.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return listed.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
