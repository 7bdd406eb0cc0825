"""A training corpus from documents: STAGES, each an operator of veridia.llm, one after the other.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as
the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridia.llm import decontaminate, lang_id, mixing, ngram_join, secrets
from veridia.llm.common import discard, materialise, remove, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts in which no language holds LEAST_SHARE of the letters."""
    return lang_id.accepted(docs, lang_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; every document stays."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their texts and how often they are taken (epochs)."""
    return mixing.mix(docs, whole=True).where("epochs > 0")


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark),
    ("secrets", secret),
    ("mixing", mixture),
]

#: Language labels come from a trained model, which SQL can't express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage wrote besides its rows, and the rows of the stage before it, is deleted once its rows are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = written()
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(spark, before, keep=docs)
        if last is not None:
            remove(last)
        last = docs
    return docs
