"""Host-level quality rules (operator 1).

Text figures are counted once per document and stored without texts. Rule failures are
summed by host (map-side first, so a hot host ships one row per task). For every rule an
empirical beta prior is fitted to the hosts' rates by the method of moments; a host's
posterior mean shrinks its rate towards the prior, the more so the fewer documents it has.
Every rule, and the base rules taken together, has a limit of its own, relative to the fitted prior: ``factor`` times
the prior's mean, but ``floor`` at least and ``ceiling`` at most. A host is rejected where any posterior mean
exceeds its limit.
The verdict joins back to the documents by host: the side of the hosts is an aggregate whose
size Spark knows at run time, so it is broadcast where small and joined with split hot
partitions where not.

Null text has no words and fails. A null host is a host of its own. Repeated rows count as
often as they occur. With no documents there are no hosts and no rows. Fewer than two hosts,
or hosts that all have one rate, give a prior of strength ``PRIOR_MOST``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perflog.llm.runtime import chunks, per_row, ready, stage, utf8
from perflog.llm.words import SPACE, Words, covered

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RULES = ("short", "repeated", "duplicate_lines", "symbols")
#: Least and most strength (in documents) of the prior.
PRIOR_LEAST, PRIOR_MOST = 1.0, 1000.0


def _text_figures(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    w = Words(data, offs)
    space = SPACE[data]
    point = (data & 0xC0) != 0x80
    at, h = w.windows(3)
    repeated = np.zeros(len(offs) - 1, np.int64)
    if len(at):
        order = np.lexsort((h, w.row[at]))
        row, key = w.row[at][order], h[order]
        same = (row[1:] == row[:-1]) & (key[1:] == key[:-1])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        inside = covered(at[order[twice]], 3, len(w.row))
        repeated = np.bincount(w.row[inside], minlength=len(offs) - 1)
    lines = np.zeros(len(offs) - 1, np.int64)
    raw = data.tobytes()
    for i in range(len(lines)):
        text = raw[offs[i]:offs[i + 1]]
        if b"\n" in text:
            worded = [x for x in text.split(b"\n") if x.strip()]
            lines[i] = len(worded) - len(set(worded))
    return [w.count.astype(np.int64), per_row(point & ~space, offs), per_row(SYMBOLS[data], offs), lines, repeated]


def text_figures(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Id, host, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            data, offs = utf8(b.column(2))
            parts = [_text_figures(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]) for lo, hi in chunks(offs)]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1)] + [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)],
                    ["__id", "__host", *names])

    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, host_col)]
    return docs.select(F.col(id_col).alias("__id"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text")).mapInArrow(
        run, f"__id {kinds[0]}, __host {kinds[1]}, " + ", ".join(f"{n} long" for n in names))


def host_rates(figures: DataFrame, factor: float, floor: float, ceiling: float) -> DataFrame:
    """Per host: documents, posterior mean rates of every rule under an empirical beta prior, and whether all keep to their limits."""
    kinds = ("base", *RULES)
    hosts = figures.groupBy("__host").agg(F.count(F.lit(1)).alias("n_docs"),
                                          *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"n_{r}") for r in kinds])
    stats = hosts.agg(*[x for r in kinds for x in (
        F.avg(F.col(f"n_{r}") / F.col("n_docs")).alias(f"mean_{r}"),
        F.var_samp(F.col(f"n_{r}") / F.col("n_docs")).alias(f"var_{r}"))])
    joined = hosts.join(F.broadcast(stats))  # one row of moments

    def posterior(r):
        mean, var = F.col(f"mean_{r}"), F.col(f"var_{r}")
        strength = F.when(var > 0, mean * (1 - mean) / var - 1).otherwise(F.lit(PRIOR_MOST))
        strength = F.greatest(F.lit(PRIOR_LEAST), F.least(F.lit(PRIOR_MOST), strength))
        return (F.col(f"n_{r}") + mean * strength) / (F.col("n_docs") + strength)

    rates = joined.select("__host", "n_docs", *[posterior(r).alias(f"rate_{r}") for r in kinds], *[f"mean_{r}" for r in kinds])
    within = F.lit(True)
    for r in kinds:
        within = within & (F.col(f"rate_{r}") <= F.least(F.lit(ceiling), F.greatest(F.lit(floor), factor * F.col(f"mean_{r}"))))
    return rates.withColumn("host_kept", within).drop(*[f"mean_{r}" for r in kinds])


def apply_host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                     min_words: int = 50, max_repeat_percent: int = 50, max_symbol_percent: int = 10,
                     max_line_percent: int = 30, factor: float = 4.0, floor: float = 0.2, ceiling: float = 0.5) -> DataFrame:
    """Id, the text figures, base_failed, kept, and the host's posterior rates and verdict.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of the words in repeated
    3-word windows. Symbol and duplicate-line failures count for the host's rates only. kept: not base_failed, of a host that is kept."""
    ready(docs.sparkSession)
    f = text_figures(docs, id_col, text_col, host_col).withColumns({
        "fail_short": F.col("n_words") < min_words,
        "fail_repeated": 100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"),
        "fail_symbols": 100 * F.col("n_symbols") > max_symbol_percent * F.col("word_chars"),
        "fail_duplicate_lines": 100 * F.col("n_dup_lines") > max_line_percent * F.col("n_words"),
    }).withColumn("fail_base", F.col("fail_short") | F.col("fail_repeated"))
    f = stage(f, "text-figures")
    hosts = host_rates(f, factor, floor, ceiling)
    out = f.join(hosts.withColumnRenamed("__host", "__of"), F.col("__host").eqNullSafe(F.col("__of")), "left")
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      F.col("fail_base").alias("base_failed"),
                      (~F.col("fail_base") & F.col("host_kept")).alias("kept"), "host_kept",
                      F.col("n_docs").alias("host_docs"), *[F.round(f"rate_{r}", 9).alias(f"host_rate_{r}") for r in ("base", *RULES)])
