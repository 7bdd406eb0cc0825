"""Generated facts for benches: a chain of parents that a friendship closes, with bystanders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def chain(spark: SparkSession, parents: int, friends: int = 0, gap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hasParent, hasFriend): i0 -> i1 -> ... -> i<parents>, with the edge out of i<gap> left out; the
    first is a friend of the last; each of the first ones has `friends` friends besides."""
    name = lambda c: F.concat(F.lit("i"), c.cast("string"))
    parent = spark.range(parents).where(F.lit(True) if gap is None else F.col("id") != gap)
    parent = parent.select(name(F.col("id")).alias("s"), name(F.col("id") + 1).alias("o"))
    closing = spark.range(1).select(F.lit("i0").alias("s"), F.lit(f"i{parents}").alias("o"))
    others = spark.range(parents * friends).select(name(F.floor(F.col("id") / max(1, friends))).alias("s"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("o"))
    return parent, closing.union(others)


def case_chain(spark: SparkSession, n: int) -> DataFrame:
    """(s, o): a root with an edge to each of i1 ... in, which form a chain."""
    i = spark.range(1, n + 1).select(F.col("id").cast("int").alias("i"))
    name = lambda c: F.concat(F.lit("i"), c.cast("string"))
    return i.select(F.lit("root").alias("s"), name(F.col("i")).alias("o")).union(i.where(F.col("i") < n).select(name(F.col("i")).alias("s"), name(F.col("i") + 1).alias("o")))
