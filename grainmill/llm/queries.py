"""The queries of this subpackage: one for each operator, over its whole table, with production parameters; and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import decontam, html, langid, licenses, lm, mixing, simhash, suffix, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_all(_read(spark, sf_dir, "pages"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_all(_read(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_read(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, lm.train(docs, _read(spark, sf_dir, "labels"))).drop("text")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels"))).drop("text")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return langid.identify(docs, langid.train(docs)).drop("text")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.find(_read(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html, op2_topk, op3_simhash, op4_lm, op5_licenses, op6_toxicity, op7_language, op8_decontaminate, op9_suffix_dedup, op10_mix)
}

SQL: dict[str, str] = {"op2_topk": topk.sql(), "op4_lm": lm.sql(), "op8_decontaminate": decontam.sql(), "op9_suffix_dedup": suffix.sql(), "op10_mix": mixing.sql()}
