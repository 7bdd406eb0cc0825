"""The queries opN_<name> of the ten operators, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, cover_tree, decontaminate, lang_id, mixing, ngram_join, quality, secrets, token_counts, toxicity
from .common import crc_mod, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.learn(docs.where(crc_mod("doc_id", 3) != 1))
    found = lang_id.identify(docs, model)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    forest = quality.learn(docs, labels, "quality", crc_mod("doc_id", 5) != 0)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return quality.score(docs, forest).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.report(rows.unionByName(extra))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    classifier = toxicity.learn(docs, labels, "toxic", crc_mod("doc_id", 3) != 1)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return toxicity.score(docs, classifier).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_quality, op4_mixing, op5_embedding_dedup, op6_secrets, op7_chat, op8_token_counts, op9_ngram_join, op10_toxicity)}
ORACLE_SQL = {"op2_decontamination": decontaminate.REPORT_SQL, "op4_mixing": mixing.REPORT_SQL, "op5_embedding_dedup": cover_tree.REPORT_SQL, "op7_chat": chat.REPORT_SQL, "op9_ngram_join": ngram_join.REPORT_SQL}
