"""External relations: catalog tables and SQL queries as concepts and roles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridia.plans.terms import Access, DLError


def validate(a: Access) -> Access:
    if not (a.table or a.query):
        raise DLError(f"the access of {a.name} has neither a table nor a query", 301)
    if a.arity not in (1, 2) or a.table and len(a.table) != a.arity + 1:
        raise DLError(f"the access of {a.name} doesn't fit its arity {a.arity}", 301)
    if a.arity == 2 and not a.positive:
        raise DLError(f"{a.name}: roles have no negative access", 301)
    return a


def retrieval(*queries: str) -> str:
    """Of queries by binding pattern the one without parameters; filters reach it by pushdown."""
    free = [q for q in queries if "?" not in re.sub(r"'[^']*'", "", q)]
    if not free:
        raise DLError("no query retrieves all values", 301)
    return free[0]


#: What a connection name stands for: a function of (session, table or None, query or None).
Reader = Callable[[SparkSession, str | None, str | None], DataFrame]


def jdbc_connection(url: str, **options: str) -> Reader:
    """Tables and queries of another database; filters on their columns are pushed down."""

    def read(spark: SparkSession, table: str | None, query: str | None) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, **({"query": query} if query else {"dbtable": table}), **options).load()

    return read


def _frame(spark: SparkSession, a: Access, reader: Reader | None = None) -> DataFrame:
    validate(a)
    if reader is not None:
        df = reader(spark, a.table[0] if a.table else None, a.query)
        return df.select(*a.table[1:]) if a.table else df
    if a.query:
        return spark.sql(a.query)
    return spark.table(a.table[0]).select(*a.table[1:])


def read_concept(spark: SparkSession, a: Access, reader: Reader | None = None) -> DataFrame:
    df = _frame(spark, a, reader)
    return df.select(F.col(df.columns[0]).cast("string").alias("ind")).distinct()


def read_role(spark: SparkSession, a: Access, reader: Reader | None = None) -> DataFrame:
    df = _frame(spark, a, reader)
    s, o = df.columns[:2]
    return df.select(F.col(s).cast("string").alias("s"), F.col(o).cast("string").alias("o")).distinct()


def jdbc_table(spark: SparkSession, url: str, name: str, view: str | None = None, **options: str) -> DataFrame:
    """A table of another database as a view that accesses can name; filters on its keys are pushed down."""
    df = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    df.createOrReplaceTempView(view or name)
    return df


def triple_store(instances: DataFrame, object_properties: DataFrame):
    """Binders for the three-table layout: concept(name) and role(name) as filtered scans."""

    def concept(name: str) -> DataFrame:
        return instances.where(F.col("classname") == name).select(F.col("subject").alias("ind"))

    def role(name: str) -> DataFrame:
        return object_properties.where(F.col("objpropname") == name).select(F.col("subject").alias("s"), F.col("object").alias("o"))

    return concept, role
