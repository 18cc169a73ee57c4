"""A corpus made ready for training: five of the operators of ``perflog.llm``, one after another.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame that is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``docs``. Null texts count as empty and pass all
filters; repeated rows are one group of the join. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perflog.llm.decontaminate import decontaminate
from perflog.llm.ngram_join import drop_copies
from perflog.llm.packing import pack
from perflog.llm.personal_data import redact
from perflog.llm.queries import table, vocabulary
from perflog.llm.runtime import stage, text_hash
from perflog.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for toxic."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    scored = score_toxicity(rows, table(spark, sf_dir, "labels"), extra=("__row",))
    return scored.where("predicted = 0").select("__row.*")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return drop_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, exact or edited."""
    leaks = decontaminate(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__i"), F.col("__th").alias("__t")).distinct()
    leaks = stage(leaks, "leaks")
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["__i"]) & (text_hash(docs["text"]) == leaks["__t"]), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows the new text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return pack(docs, vocabulary("word_bpe_49k.json"), length=2048)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs


#: Trained classifiers, alignment and packing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
