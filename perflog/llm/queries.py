"""Queries of the training-data operators: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perflog.llm import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if text:
            SQL[name] = text
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_host_rules", sql.HOST_RULES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.host_rules import apply_host_rules
    out = apply_host_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith("host_rate_")})


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), length=2048)


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.decontaminate import decontaminate
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("__th")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.toxicity import score_toxicity
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_ngram_join", sql.NGRAM_JOIN)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.ngram_join import link
    return link(table(spark, sf_dir, "documents")).drop("component")


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.personal_data import find_personal_data
    return find_personal_data(table(spark, sf_dir, "documents")).drop("found")


@query("op9_window_dedup", sql.WINDOW_DEDUP)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.window_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op10_tool_calls")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.tool_calls import SCHEMAS, as_tool_messages, link_calls
    return link_calls(as_tool_messages(table(spark, sf_dir, "conversations")), SCHEMAS)


@query("op11_collocations", sql.COLLOCATIONS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.collocations import mine_collocations
    return mine_collocations(table(spark, sf_dir, "documents"))


@query("op12_length_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.length_packing import pack
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), length=1024)


@query("op13_merkle_manifest", sql.MERKLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from perflog.llm.merkle import manifest_check
    return manifest_check(table(spark, sf_dir, "documents"))
