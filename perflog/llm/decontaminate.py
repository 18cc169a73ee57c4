"""Benchmark decontamination by shared n-grams and local alignment (operator 5).

Items are cut into overlapping segments of bounded length; all word n-grams of a segment are
its seeds, frequent ones too, since an edited copy may keep no other. Documents that hold
seeds (a Bloom filter of bounded size tells) give up the passages around them, with words
that no item holds blanked. Seeds join passages to segments. Seeds of a pair whose places
differ by more gaps than a score of ``threshold`` allows are apart; for each run of the others,
Smith-Waterman alignment of words scores the passage if enough of the segment's words are in
it: a match is worth 1, a change or gap costs ``penalty``. A document and an item are reported
where the score is ``threshold`` of the segment's length or more: exact copies score 1, edited
and paraphrased ones less. So all pairs that score enough around a shared n-gram are found;
a copy of which no run of ``seed_words`` words is left is not.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, ASCII
letters in lower case. Null and empty texts hold no words; items (or segments) of fewer
words than a seed match nothing. Equal rows are reported once per id, text and item; a null
id is reported as null. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perflog.llm.runtime import bitmap, chunks, has_bit, pow2, ready, stage, text_hash, utf8
from perflog.llm.words import LOWER, NONWORD, U, Words

PROBES = (0, 15, 30, 44)


def item_segments(items: DataFrame, item_col: str, text_col: str, longest: int) -> DataFrame:
    """item, seg, words (64-bit hashes of the words) of every item; segments overlap by half."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            at, seg, words = [], [], []
            for lo, hi in chunks(offs):
                w = Words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], NONWORD, LOWER)
                edge = np.concatenate([[0], np.cumsum(w.count)])
                for i in range(hi - lo):
                    h = w.hash[edge[i]:edge[i + 1]]
                    for k, cut in enumerate(range(0, max(1, len(h) - longest // 2), longest // 2)):
                        at.append(lo + i)
                        seg.append(k)
                        words.append(h[cut:cut + longest].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(seg, pa.int32()), pa.array(words, pa.binary())],
                                             ["item", "seg", "words"])

    return items.select(F.col(item_col), F.col(text_col)).mapInArrow(run, f"item {kind}, seg int, words binary")


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of one word sequence, as ``Words.windows`` gives them."""
    w = Words.__new__(Words)
    w.hash, w.row = words, np.zeros(len(words), np.int64)
    return w.windows(n)[1]


def item_grams(segments: DataFrame, n: int) -> DataFrame:
    """item, seg, place, size (words of the segment) and h of every n-gram of every segment."""
    kind = segments.schema["item"].dataType.simpleString()

    def run(batches):
        for b in batches:
            parts = [grams(np.frombuffer(x.as_buffer(), U), n) for x in b.column(2)]
            count = [len(p) for p in parts]
            at = pa.array(np.repeat(np.arange(len(parts)), count))
            size = pa.array([len(x.as_buffer()) // 8 for x in b.column(2)], pa.int32())
            place = np.concatenate([np.arange(c) for c in count]) if parts else np.zeros(0)
            h = np.concatenate(parts) if parts else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(place.astype(np.int32)), size.take(at),
                                              pa.array(h.view(np.int64))], ["item", "seg", "place", "size", "h"])

    return segments.select("item", "seg", "words").mapInArrow(run, f"item {kind}, seg int, place int, size int, h long")


def bloom(df: DataFrame, n: int) -> np.ndarray:
    """Bits of the hashes in column h, four probes each; its size follows ``n`` up to 32 MB."""
    probes = df.select(F.explode(F.array(*[F.shiftrightunsigned("h", p) for p in PROBES])).alias("x"))
    return bitmap(probes, "x", pow2(64 * max(1, n), 1 << 16, 1 << 28))


def probed(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = has_bit(bits, h)
    for p in PROBES[1:]:
        ok[ok] = has_bit(bits, h[ok] >> U(p))
    return ok


def passages(docs: DataFrame, n: int, bits, vocabulary, reach: int) -> DataFrame:
    """id, text hash, first (word), words and the seeds found (place in the passage, hash) of every passage that holds one:
    ``reach`` words to both sides of seeds, overlapping ones joined. Words outside ``vocabulary`` match nothing and are 0."""
    kind = docs.schema["__id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(2))
            at_row, first, words, places, hashes = [], [], [], [], []
            for lo, hi in chunks(offs):
                w = Words(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], NONWORD, LOWER)
                at, h = w.windows(n)
                ok = probed(bits.value, h)
                at, h = at[ok], h[ok]
                if not len(at):
                    continue
                edge = np.concatenate([[0], np.cumsum(w.count)])
                row = w.row[at]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] - at[:-1] > 2 * reach)])
                cut = np.append(np.flatnonzero(new), len(at))
                for x, y in zip(cut[:-1], cut[1:]):
                    r = row[x]
                    start, stop = max(edge[r], at[x] - reach), min(edge[r + 1], at[y - 1] + n + reach)
                    at_row.append(lo + r)
                    first.append(start - edge[r])
                    part = w.hash[start:stop]
                    words.append(np.where(probed(vocabulary.value, grams(part, 1)), part, U(0)).tobytes())
                    places.append((at[x:y] - start).astype(np.int32))
                    hashes.append(h[x:y].view(np.int64))
            if at_row:
                take = pa.array(at_row, pa.int64())
                size = pa.array(np.cumsum([0, *map(len, places)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(first, pa.int64()), pa.array(words, pa.binary()),
                     pa.ListArray.from_arrays(size, pa.array(np.concatenate(places))), pa.ListArray.from_arrays(size, pa.array(np.concatenate(hashes)))],
                    ["id", "th", "first", "words", "places", "hashes"])

    return docs.select("__id", "__th", "__text").mapInArrow(
        run, f"id {kind}, th long, first long, words binary, places array<int>, hashes array<long>")


def align(pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float) -> np.ndarray:
    """Smith-Waterman score of each pair of word sequences (segment, passage), all pairs in step."""
    rows, cols = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a = np.zeros((len(pairs), rows), U)
    b = np.zeros((len(pairs), cols), U)
    for i, (x, y) in enumerate(pairs):
        a[i, :len(x)], b[i, :len(y)] = x | U(1), y | U(1)  # zero pads; it matches nothing below
    b[b == 0] = U(2)
    down = penalty * np.arange(cols, dtype=np.float32)
    above = np.zeros((len(pairs), cols + 1), np.float32)
    best = np.zeros(len(pairs), np.float32)
    for i in range(rows):
        diagonal = above[:, :-1] + np.where(b == a[:, i:i + 1], np.float32(1), np.float32(-penalty))
        t = np.maximum(0, np.maximum(diagonal, above[:, 1:] - penalty))
        # a gap in the segment: the best cell to the left, less the penalty of each step
        above[:, 1:] = np.maximum.accumulate(t + down, axis=1) - down
        best = np.maximum(best, above.max(axis=1))
    return best


def most_gaps(n: int, penalty: float, threshold: float) -> int:
    """Most words that an alignment of ``n`` words can leave out and still reach ``threshold``."""
    return int(min((1 - threshold) * n / penalty, 1 << 30)) + 1 if penalty > 0 else 1 << 30


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", seed_words: int = 3, longest: int = 128,
                  penalty: float = 0.5, threshold: float = 0.5, least_words: int = 8) -> DataFrame:
    """id, item, score (share of the segment's words that align, changes and gaps deducted), segment, first_word and n_words
    (the passage in the document), and __th (hash of the text), for every document and item whose score reaches ``threshold``;
    segments of fewer than ``least_words`` words must match exactly in number of words."""
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("__id"), text_hash(F.col(text_col)).alias("__th"), F.col(text_col).alias("__text"))
    segments = stage(item_segments(items, item_col, item_text_col, longest), "segments")
    every = stage(item_grams(segments, seed_words), "item-grams")
    # of equal n-grams of a segment, the first and last place bound the others
    seeds = every.groupBy("item", "seg", "h").agg(F.min("place").alias("p0"), F.max("place").alias("p1"))
    size = every.agg(F.max("size"), F.count(F.lit(1))).first()
    reach = (size[0] or 0) + most_gaps(size[0] or 0, penalty, threshold)
    bits = spark.sparkContext.broadcast(bloom(every.select("h"), size[1]))
    vocabulary = spark.sparkContext.broadcast(bloom(item_grams(segments, 1).select("h"), size[1] * 2))
    found = stage(passages(docs, seed_words, bits, vocabulary, reach).withColumn("pid", F.monotonically_increasing_id()), "passages")
    hits = found.select("pid", F.explode(F.arrays_zip("places", "hashes")).alias("s")).select(
        "pid", F.col("s.places").alias("p"), F.col("s.hashes").alias("h"))
    pairs = (hits.join(seeds, "h").select("pid", "item", "seg", F.explode(F.array_distinct(F.array(F.col("p") - F.col("p1"), F.col("p") - F.col("p0")))).alias("at"))
             .groupBy("pid", "item", "seg").agg(F.collect_set("at").alias("at")))
    both = (pairs.join(found.select("pid", "id", "th", "first", "words"), "pid")
            .join(segments.withColumnRenamed("words", "segment_words"), ["item", "seg"])
            .select("id", "th", "item", "seg", "first", "at", "words", "segment_words"))
    kinds = both.schema
    head = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in ("id", "th", "item", "seg"))

    def score(batches):
        for b in batches:
            jobs = []
            for i in range(b.num_rows):
                seg = np.frombuffer(b.column(7)[i].as_buffer(), U)
                words = np.frombuffer(b.column(6)[i].as_buffer(), U)
                first = b.column(4)[i].as_py()
                wide, slack = most_gaps(len(seg), penalty, threshold), len(seg) // 4 + 2
                at = np.sort(b.column(5)[i].values.to_numpy(zero_copy_only=False))
                cut = np.concatenate([[0], np.flatnonzero(np.diff(at) > wide) + 1, [len(at)]])
                for x, y in zip(at[cut[:-1]].tolist(), at[cut[1:] - 1].tolist()):
                    lo, hi = max(0, x - wide), min(len(words), y + len(seg) + wide)
                    # no more words match than the passage holds
                    if np.isin(seg, words[lo:hi]).sum() >= threshold * len(seg):
                        near = max(0, x - slack), min(len(words), y + len(seg) + slack)
                        jobs.append((hi - lo, i, seg, words[lo:hi], first + lo, words[near[0]:near[1]], first + near[0]))
            jobs.sort(key=lambda j: (j[0], j[1]))
            keep, scores, start, length = [], [], [], []
            while jobs:
                take = max(1, min(len(jobs), 200_000 // max(1, jobs[-1][0])))
                part, jobs = jobs[-take:], jobs[:-take]
                done = [(j, s) for j, s in zip(part, align([(j[2], j[3]) for j in part], penalty))
                        if s / len(j[2]) >= threshold and (len(j[2]) >= least_words or s >= len(j[2]))]
                # the narrower passage is reported where it scores as much
                for (j, s), same in zip(done, align([(j[2], j[5]) for j, _ in done], penalty) if done else []):
                    keep.append(j[1])
                    scores.append(float(s) / len(j[2]))
                    start.append(j[6] if same >= s else j[4])
                    length.append(len(j[5] if same >= s else j[3]))
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i).take(rows) for i in range(4)] + [
                pa.array(scores, pa.float64()), pa.array(start, pa.int64()), pa.array(length, pa.int64())],
                ["id", "th", "item", "seg", "score", "first_word", "n_words"])

    out = both.mapInArrow(score, head + ", score double, first_word long, n_words long")
    best = out.groupBy("id", "th", "item").agg(F.max(F.struct("score", F.col("seg").alias("segment"), "first_word", "n_words")).alias("s"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.round("s.score", 6).alias("score"), "s.segment", "s.first_word",
                       "s.n_words", F.col("th").alias("__th"))
