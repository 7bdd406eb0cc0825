"""Conditions on values of a column as concepts: what a datatype restriction would say, as a filter
that reaches the scan.  Values between the bounds are in the concept, known other values are known to
be outside, missing values say nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split(df: DataFrame, key: Column, inside: Column) -> tuple[DataFrame, DataFrame]:
    """(in, out) individuals by a condition; rows where it is null are in neither."""
    named = df.select(key.cast("string").alias("ind"), inside.alias("inside")).where("ind is not null")
    return named.where("inside").select("ind"), named.where("not inside").select("ind")


def between(column: Column, low: object = None, high: object = None) -> Column:
    out = column.isNotNull()
    if low is not None:
        out = out & (column >= F.lit(low))
    if high is not None:
        out = out & (column <= F.lit(high))
    return F.when(column.isNotNull(), out)


def value_concept(kb, name: str, df: DataFrame, key: Column, condition: Column) -> None:
    """Tells the knowledge base which individuals satisfy the condition and which don't."""
    inside, outside = split(df, key, condition)
    kb.concept(name, inside).concept(name, outside, positive=False)


def one_of(*names: str):
    """A filter for an enumeration of individuals."""
    return lambda df: df.where(F.col("ind").isin(*names))
