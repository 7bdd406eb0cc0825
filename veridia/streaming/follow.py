"""Keeps answers up to date while facts arrive: each micro-batch is appended to a fact table and the
asked concept is derived anew from the whole table, so that late facts and restarts do no harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veridia.kb import KnowledgeBase


def follow(stream: DataFrame, facts_path: str, answers_path: str, build: Callable[[KnowledgeBase, DataFrame], object], ask: Callable[[KnowledgeBase], DataFrame], checkpoint: str) -> StreamingQuery:
    """build(kb, facts): binds the facts so far and tells the axioms. ask(kb): the answers, written to
    answers_path/batch=<number>; a batch that is run again overwrites its own part."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{facts_path}/batch={number}")
        kb = KnowledgeBase(spark)
        build(kb, spark.read.parquet(facts_path).drop("batch"))
        ask(kb).write.mode("overwrite").parquet(f"{answers_path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
