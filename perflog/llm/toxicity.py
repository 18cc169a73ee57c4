"""Toxicity by non-negative positive-unlabelled learning (operator 6).

Confirmed toxic documents are the positives; every other document of the training part is
unlabelled (it may be toxic or not), whatever its label. Linear numpy classifiers on the
presence of words are trained, each on its own bounded sample and in a task of its own, by
the non-negative risk estimator: with class prior p, positive loss R+ and losses as negative
R-, the risk is p R+(P) + max(0, R-(U) - p R-(P)); where the second part falls below zero
its gradient is followed upwards instead. The prior is the share of toxic rows among all labelled
training rows, counted over all of them. The score is the mean of the classifiers' probabilities.

Bounds (parameters): ``max_positive`` and ``max_unlabelled`` rows per classifier, drawn by hash;
``max_features`` words per classifier, those with the clearest difference between both samples.
Rows of the tables are all scored. A null text is empty and scores as one without known words.
Labels of ids that have no document are unused; contradicting labels of one id count as toxic.
Without positives every score is FLOOR. Repeated rows get the same score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perflog.llm.runtime import chunks, ready, stage, utf8
from perflog.llm.words import LOWER, NONWORD, Words

#: Score of everything when there is nothing to learn from.
FLOOR = 0.01


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def word_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each different word of every text, letters in lower case."""
    w = Words(data, offs, NONWORD, LOWER)
    if not len(w.row):
        return w.row, w.hash
    order = np.lexsort((w.hash, w.row))
    row, h = w.row[order], w.hash[order]
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
    return row[first], h[first]


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, max_features: int = 2000,
        least_ratio: float = 14.0, rounds: int = 1000, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Word hashes, their weights and the offset of one classifier by the non-negative risk."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    all_words = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    words, code = np.unique(all_words, return_inverse=True)
    in_p = np.bincount(code[positive[owner]], minlength=len(words))
    in_u = np.bincount(code[~positive[owner]], minlength=len(words))
    if not n_p or not n_u or not len(words):
        return np.zeros(0, np.uint64), np.zeros(0), float(np.log(FLOOR / (1 - FLOOR)))
    # likelihood-ratio test of equal rates in both samples
    rate_all = (in_p + in_u) / (n_p + n_u)

    def part(k, n, share):
        return k * np.log(np.maximum(k, 1e-12) / np.maximum(n * share, 1e-12))

    clear = 2 * (part(in_p, n_p, rate_all) + part(n_p - in_p, n_p, 1 - rate_all)
                 + part(in_u, n_u, rate_all) + part(n_u - in_u, n_u, 1 - rate_all))
    pick = np.argsort(-clear, kind="stable")[:max_features]
    pick = pick[clear[pick] > least_ratio]
    column = np.full(len(words), -1)
    column[pick] = np.arange(len(pick))
    keep = column[code] >= 0
    row, col = owner[keep], column[code[keep]]
    w, b = np.zeros(len(pick)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(pick) + 1), np.zeros(len(pick) + 1)
    weight_p = np.where(positive, prior / n_p, 0.0)
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=w[col], minlength=len(rows)) + b
        s = sigmoid(z)
        # sigmoid loss: as positive 1 - s, as negative s; bounded, so no single row can drive the offset
        negative = np.where(positive, -weight_p, 1 / n_u)
        rest = float((negative * s).sum())
        slope = s * (1 - s)
        g = (negative - weight_p) * slope if rest >= 0 else -negative * slope
        grad = np.append(np.bincount(col, weights=g[row], minlength=len(pick)) + decay * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad ** 2
        change = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return words[pick], w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, classifiers: int,
          max_positive: int, max_unlabelled: int, max_features: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Models from bounded hash-drawn samples; every classifier is fitted in its own task."""
    marks = (labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id"))
             .agg(F.max(label_col).alias("__y")).where(F.col("__y").isNotNull() & ~held_out(F.col("__id"))))
    n, k = marks.agg(F.count(F.lit(1)), F.sum((F.col("__y") > 0).cast("long"))).first()
    prior = min(0.5, max(1e-4, (k or 0) / n)) if n else 1e-4
    known = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    total = known.select(id_col).count()
    # a row enters each classifier's sample by a hash threshold that makes about the bound; the rank keeps the bound
    parts = F.explode(F.sequence(F.lit(0), F.lit(classifiers - 1)))
    draw = F.pmod(F.xxhash64(F.lit(11), "__id", "__part"), F.lit(1_000_000)) / 1e6
    toxic = marks.where(F.col("__y") > 0).select("__id", parts.alias("__part")).where(draw < 1.1 * max_positive / max(1, k or 0))
    drawn = known.select(F.col(id_col).alias("__id")).distinct().select("__id", parts.alias("__part")).where(
        draw < 1.1 * max_unlabelled / max(1, total))
    ids = toxic.withColumn("__p", F.lit(True)).unionByName(drawn.withColumn("__p", F.lit(False))).groupBy("__id", "__part").agg(
        F.max("__p").alias("__p"))
    # at most classifiers x (positives + unlabelled) ids: a bounded table, so it is what moves, not the texts
    bound = F.broadcast(ids.withColumn("__at", F.row_number().over(_by_hash())).where(
        F.col("__at") <= F.when(F.col("__p"), F.lit(max_positive)).otherwise(F.lit(max_unlabelled))).drop("__at"))
    sample = known.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(bound, "__id")

    def sets(batches):
        for b in batches:
            data, offs = utf8(b.column(1))
            for lo, hi in chunks(offs):
                row, h = word_sets(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary()), b.column(2).slice(lo, hi - lo),
                     b.column(3).slice(lo, hi - lo)], ["words", "p", "part"])

    def model(key, table):
        rows = sorted(zip(table.column("p").to_pylist(), table.column("words").to_pylist()), key=lambda x: (not x[0], x[1]))
        words, w, b = fit([np.frombuffer(x, np.uint64) for _, x in rows], np.array([p for p, _ in rows], bool), prior, max_features)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary()),
                         "weights": pa.array([np.asarray(w, float).tobytes()], pa.binary()), "offset": pa.array([float(b)])})

    fitted = (sample.select("__id", "__text", "__p", "__part").mapInArrow(sets, "words binary, p boolean, part int")
              .groupBy("part").applyInArrow(model, "part int, words binary, weights binary, offset double"))
    return [(np.frombuffer(r.words, np.uint64), np.frombuffer(r.weights, float), r.offset)
            for r in sorted(fitted.collect(), key=lambda r: r.part)]


def _by_hash():
    from pyspark.sql import Window
    return Window.partitionBy("__part", "__p").orderBy(F.xxhash64(F.lit(13), "__id"), "__id")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", classifiers: int = 4, max_positive: int = 1500,
                   max_unlabelled: int = 3000, max_features: int = 2000, extra: tuple[str, ...] = ()) -> DataFrame:
    """Id, held_out, score, predicted of every row (and the columns named in ``extra``)."""
    ready(docs.sparkSession)
    models = train(docs, labels, id_col, text_col, label_col, classifiers, max_positive, max_unlabelled, max_features)
    # classifiers x max_features weights: a bounded closure
    words = np.unique(np.concatenate([m[0] for m in models])) if models else np.zeros(0, np.uint64)
    table = np.zeros((len(words), max(1, len(models))))
    offset = np.full(max(1, len(models)), float(np.log(FLOOR / (1 - FLOOR))))
    for j, (h, w, b) in enumerate(models):
        table[np.searchsorted(words, h), j] = w
        offset[j] = b
    kinds = docs.select(F.col(id_col).alias("__id"), *extra).schema
    names = [f.name for f in kinds]

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(b.num_columns - 1))
            scores = []
            for lo, hi in chunks(offs):
                row, h = word_sets(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                hit = words[at] == h if len(words) else np.zeros(len(h), bool)
                z = np.stack([np.bincount(row[hit], weights=table[at[hit], j], minlength=hi - lo) + offset[j]
                              for j in range(len(offset))])
                scores.append(sigmoid(z).mean(axis=0))
            if scores:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(scores))], [*names, "score"])

    out = docs.select(F.col(id_col).alias("__id"), *extra, F.col(text_col).alias("__text")).mapInArrow(
        run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", score double")
    return out.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), *extra)
