"""Substring dedup over word windows with a count-min prefilter (operator 9).

First pass: every task counts the documents of each window hash in count-min sketches of its
part, written as short gap lists, one for each range of counters. One group per range adds up
the parts. Counts can only be too high, so a window whose counters stay below two in any
row of the sketch occurs in one document only and is dropped for good; none that repeats is
lost. Second pass: the windows estimated repeated are grouped exactly (by 90 bits of two
independent hashes) to find the smallest document of each. Windows that the sketch holds possible in ``heavy``
or more documents are split by salt, and each part gets the least document of all parts, which is summed
before it moves; all others have fewer than ``heavy`` documents in a group. At last, a document's marked window
starts meet its text, and covered words go.

The sketch's size follows the corpus up to ``most_counters`` per row (two rows; 64 MB of
broadcast bits at the default). Beyond that it only filters less; results stay the same.

Null texts have no words. Words of shorter texts than a window stay. A null id counts as
larger than every other, and documents of one id (or without id) don't remove from each other. Repeated
rows and an empty table are fine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perflog.llm.runtime import bitmap, chunks, has_bit, pow2, ready, stage, text_hash, utf8
from perflog.llm.words import U, Words, covered, mix

RANGES = 64
#: Window hashes that a task gathers before it writes a part of its sketch.
GATHER = 4 << 20
HEAVY_BITS = 1 << 24
#: Parts into which a heavy window's documents are split.
SALTS = 64
NO_ID = (1 << 63) - 1


def gaps(slots: np.ndarray) -> bytes:
    """Sorted numbers as one byte per gap; 255 stands for a step of 255 without a number."""
    step = np.diff(slots, prepend=0)
    far, near = step // 255, step % 255
    at = np.cumsum(far + 1) - 1
    out = np.full(int(far.sum()) + len(slots), 255, np.uint8)
    out[at] = near
    return out.tobytes()


def ungaps(raw) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    return np.cumsum(x, dtype=np.int64)[x != 255]


def slots(h: np.ndarray, row: int, counters: int) -> np.ndarray:
    """Counter of every hash in one row of the sketch."""
    return ((h if row == 0 else h * U(0xD6E8FEB86659FD93)) >> U(64 - counters.bit_length() + 1)).astype(np.int64)


def doc_windows(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[Words, np.ndarray, np.ndarray]:
    w = Words(data, offs)
    at, h = w.windows(k)
    return w, at, h


def sketch(docs: DataFrame, k: int, counters: int, heavy: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bits of counters that reach two, for both rows; bits (folded) of those that reach ``heavy`` in the first."""
    width = counters // RANGES

    def parts(batches):
        held, n = [], 0

        def flush():
            h = np.concatenate(held)
            for row in (0, 1):
                s, count = np.unique(slots(h, row, counters), return_counts=True)
                edge = np.searchsorted(s, np.arange(RANGES + 1) * width)
                for r in range(RANGES):
                    x, c = s[edge[r]:edge[r + 1]] - r * width, count[edge[r]:edge[r + 1]]
                    if len(x):
                        many = c > 1
                        yield row * RANGES + r, gaps(x), gaps(x[many]), np.minimum(c[many] - 1, 255).astype(np.uint8).tobytes()

        def batch(rows):
            rows = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]],
                                              ["range", "once", "again", "more"])

        for b in batches:
            data, offs = utf8(b.column(0))
            for lo, hi in chunks(offs):
                w, at, h = doc_windows(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], k)
                if len(h):
                    order = np.lexsort((h, w.row[at]))
                    row, h = w.row[at][order], h[order]
                    held.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])])
                    n += len(held[-1])
                if n >= GATHER:
                    yield batch(flush())
                    held, n = [], 0
        if n:
            yield batch(flush())

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(width, np.uint8)
        for b in batches:
            for once, again, more in zip(*(b.column(b.schema.get_field_index(c)) for c in ("once", "again", "more"))):
                x = ungaps(once.as_buffer())
                count[x] = np.minimum(count[x], 254) + 1
                x, c = ungaps(again.as_buffer()), np.frombuffer(more.as_buffer(), np.uint8)
                count[x] = np.minimum(count[x].astype(np.int64) + c, 255)
        r = key[0].as_py()
        hot = np.flatnonzero(count >= heavy) + (r % RANGES) * width if r < RANGES else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({
            "range": pa.array([r], pa.int32()),
            "bits": pa.array([np.packbits(count >= 2, bitorder="little").tobytes()], pa.binary()),
            "hot": pa.array([np.unique(hot % HEAVY_BITS).astype("<u4").tobytes()], pa.binary())})

    rows = docs.select("__text").mapInArrow(parts, "range int, once binary, again binary, more binary").groupBy("range").applyInArrow(
        add, "range int, bits binary, hot binary")
    found = [np.zeros(counters // 8, np.uint8) for _ in (0, 1)]
    hot = np.zeros(HEAVY_BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        lo = (r.range % RANGES) * width // 8
        found[r.range // RANGES][lo:lo + width // 8] = np.frombuffer(bytes(r.bits), np.uint8)
        x = np.frombuffer(bytes(r.hot), "<u4").astype(np.int64)
        np.bitwise_or.at(hot, x >> 3, (1 << (x & 7)).astype(np.uint8))
    return found, hot


def bit(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def repeated_rows(docs: DataFrame, k: int, counters: int, shared, heavy_only: bool = False) -> DataFrame:
    """h, part, doc and aux (text tag, place) of every different window of a document that is estimated repeated, at its first place.

    ``part`` holds check bits from a second hash and, for windows estimated heavy, one of SALTS numbers by document."""

    def run(batches):
        found, hot = shared.value
        for b in batches:
            doc, tag = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offs = utf8(b.column(2))
            for lo, hi in chunks(offs):
                w, at, h = doc_windows(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], k)
                if not len(h):
                    continue
                s = slots(h, 0, counters)
                may = bit(found[0], s)
                may[may] = bit(found[1], slots(h[may], 1, counters))
                often = bit(hot, s % HEAVY_BITS)
                if heavy_only:
                    may &= often
                if not may.any():
                    continue
                at, h, often = at[may], h[may], often[may]
                row = w.row[at]
                order = np.lexsort((at, h, row))
                first = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])])
                order = np.sort(order[first])
                at, h, often, row = at[order], h[order], often[order], row[order]
                other = np.zeros(len(at), U)
                for j in range(k):
                    other = other * U(0xA24BAED4963EE407) + (w.hash[at + j] ^ U(0x9FB21C651E98DF25))
                start = np.cumsum(w.count) - w.count
                mine = doc[lo:hi][row]
                salt = np.where(often, (mix(mine.view(U)) % U(SALTS)).astype(np.int64), 0)
                part = ((other >> U(38)).astype(np.int64) * SALTS + salt - (1 << 31)).astype(np.int32)
                aux = (tag[lo:hi][row].astype(np.int64) << 32) | (at - start[row])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(part), pa.array(mine), pa.array(aux)],
                                                 ["h", "part", "doc", "aux"])

    return docs.select("__doc", "__tag", "__text").mapInArrow(run, "h long, part int, doc long, aux long")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, heavy: int = 100,
                   most_counters: int = 1 << 28, with_text: bool = False) -> DataFrame:
    """Id, n_words, n_removed, kept_sha256 (and kept_text) of every row: words covered by a window of ``k`` words that
    also starts in a document with a smaller id are removed."""
    spark = ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__doc"),
                       F.pmod(text_hash(F.col(text_col), 5), F.lit(4096)).cast("int").alias("__tag"), F.col(text_col).alias("__text"))
    size = docs.agg(F.sum(F.length("__text"))).first()[0] or 0
    counters = pow2(size / 3, 1 << 20, most_counters)
    found, hot = sketch(docs, k, counters, heavy)
    shared = spark.sparkContext.broadcast((found, hot))
    rows = repeated_rows(docs, k, counters, shared)
    if hot.any():
        # a heavy window's groups are split by salt; each gets the least document of all, summed before it moves
        base = F.col("part") - F.pmod(F.col("part"), F.lit(SALTS))
        least = repeated_rows(docs, k, counters, shared, heavy_only=True).groupBy("h", base.alias("part")).agg(F.min("doc").alias("doc"))
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rows = rows.unionByName(least.select("h", "part", "doc", salts.alias("salt")).select(
            "h", (F.col("part") + F.col("salt")).alias("part"), "doc", F.lit(-1).cast("long").alias("aux")))
    group = Window.partitionBy("h", "part")
    marks = rows.withColumn("least", F.min("doc").over(group)).where("doc > least and aux >= 0").select("doc", "aux")
    marks = stage(marks.groupBy("doc").agg(F.collect_list("aux").alias("starts")), "marks")
    touched = spark.sparkContext.broadcast(bitmap(marks, "doc", pow2(16 * marks.count(), 1 << 16, 1 << 28)))

    def figures(batches):
        bits = touched.value
        for b in batches:
            doc = b.column(1).to_numpy(zero_copy_only=False)
            hit = has_bit(bits, doc.astype(np.int64))
            texts = b.column(3).to_pylist()
            n, sha, keep = [], [], []
            for t, x in zip(texts, hit):
                words = (t or "").encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                keep.append(t if x or with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(keep, pa.string())], ["__id", "__doc", "__tag", "n_words", "sha", "__text"])

    all_docs = docs.mapInArrow(figures, f"__id {kind}, __doc long, __tag int, n_words long, sha string, __text string")
    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def cut(batches):
        for b in batches:
            ids, tags, n, sha, texts, starts = (b.column(i) for i in range(6))
            out, removed, kept_texts = sha.to_pylist(), np.zeros(len(ids), np.int64), texts.to_pylist()
            data, offs = utf8(texts)
            for lo, hi in chunks(offs):
                if starts.slice(lo, hi - lo).null_count == hi - lo and not with_text:
                    continue
                part = data[offs[lo]:offs[hi]]
                w, at, h = doc_windows(part, offs[lo:hi + 1] - offs[lo], k)
                edge, window = np.concatenate([[0], np.cumsum(w.count)]), np.searchsorted(w.row[at], np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    drop = np.zeros(w.count[i], bool)
                    if starts[lo + i].is_valid:
                        aux = starts[lo + i].values.to_numpy(zero_copy_only=False)
                        first = aux[(aux >> 32) == tags[lo + i].as_py()] & 0xFFFFFFFF
                        mine = h[window[i]:window[i + 1]]
                        # a text whose tag is another's by chance can be shorter; its own windows are all within
                        again = np.isin(mine, mine[first[first < len(mine)]])
                        drop = covered(np.flatnonzero(again), k, len(drop))
                    if drop.any() or with_text:
                        raw = [part[x:y].tobytes() for x, y in zip(w.start[edge[i]:edge[i + 1]][~drop], w.end[edge[i]:edge[i + 1]][~drop])]
                        removed[lo + i] = drop.sum()
                        out[lo + i] = hashlib.sha256(b" ".join(raw)).hexdigest()
                        kept_texts[lo + i] = b" ".join(raw).decode()
            yield pa.RecordBatch.from_arrays([ids, n, pa.array(removed), pa.array(out, pa.string())] + [pa.array(kept_texts, pa.string())] * with_text, names)

    joined = all_docs.join(marks, F.col("__doc") == F.col("doc"), "left").select("__id", "__tag", "n_words", "sha", "__text", "starts")
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
