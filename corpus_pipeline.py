"""A cleaning pipeline for ``documents``: toxicity, near-dedup, passage dedup, decontamination, then mixing to target weights.

Each stage takes (spark, docs, sf_dir) and works on all rows of its ``docs``; ``run`` writes each stage's result to the shared folder as
Parquet and reads it again as the next one's input, so a lost executor costs a stage's tasks at most. What a stage read is deleted once its result is written.

The stages go by the columns of ``documents``: doc_id (an integer), text, lang, source, n_chars, and return no others, whatever else the input has; the last adds ``copy``.
Nulls, empty texts, repeated rows and empty tables are each operator's defined cases: rows without an id or a text pass the stages that can't judge them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import decontam, mixing, simhash, suffix, toxicity
from grainmill.session import attach, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    return toxicity.drop(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.dedup(docs).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur before are cut out of the texts."""
    return suffix.dedup(docs).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned out to the target weights of their sources."""
    return mixing.mix(docs).select(*COLUMNS, "copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Neither the classifier chain nor the fingerprints can be put in SQL; the tests compare with a version in plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents``."""
    attach(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k:
            _delete(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
