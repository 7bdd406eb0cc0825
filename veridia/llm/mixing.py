r"""Mixing sources to target weights (operator 4): Efraimidis-Spirakis sampling to word budgets.

Sources get shares of all words by weight; a source's target stops at `most` times its own words and
the excess is dealt out again by weight.  A source first gives as many complete epochs as fit into
its target; the rest is a fractional selection: each document draws the key -ln(u) / q, where u is
fixed by its id and q is its quality weight, and documents are taken in the order of their keys
until their words reach the remaining budget (the last one if at least half of it fits).

No source is gathered in one task: keys fall into BUCKETS ranges, words are summed for each source
and range, and only the range in which a source's budget ends is put in order row by row.

Defined results: null text has 0 words; a null source is a source, sorted last; rows that repeat an
id have the same key and each counts; rows without an id draw by their text; an empty table gives no rows; if all texts are empty, targets
are 0.  One row for each source comes to the driver, since the weights go by the sources' order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialise

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3
BUCKETS = 4096
#: Up to so many sources their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """The share of characters that are letters or white space, 0.05 at least."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - odd / F.greatest(F.lit(1), F.length(text))), F.lit(1.0))


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> dict[str | None, float]:
    """The words each source should give: min(most * size, level * weight), with the level that makes them add up."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, rest = float(sum(sizes.values())), sum(weight.values())
    out: dict[str | None, float] = {}
    for s in sorted(order, key=lambda s: most * sizes[s] / weight[s]):  # ties stay in the sources' order
        cap = float(most * sizes[s])
        share = left * weight[s] / rest if rest else 0.0
        out[s] = cap if cap <= share else share
        if cap <= share:  # full: what it can't take goes to the others
            left -= cap
            rest -= weight[s]
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, quality: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", whole: bool = False) -> DataFrame:
    """For each row: id_col, source, size, source_size, target, epochs, taken. With whole=True all columns of docs, and those
    five; where a name is in both, the mix's column is kept."""
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), text, F.lit(""))), 1, 12), 16, 10).cast("double")
    u = (draw + 1.0) / F.lit(float(1 << 48) + 1.0)
    q = quality if quality is not None else quality_weight(text)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words_in(text).alias("size"), (-F.log(u) / q).alias("key"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []))
    sized = materialise(sized.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("key"))) * BUCKETS)).cast("int")), "mix")
    by_source = {r["source"]: r["size"] for r in sized.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    target = targets(by_source, weights, most)
    plan = []
    for s, size in by_source.items():
        epochs = min(most, math.floor(target[s] / size)) if size else 0
        plan.append((s, size, target[s], epochs, max(0.0, target[s] - epochs * size)))
    plans = spark.createDataFrame(plan, "source string, source_size bigint, target double, epochs bigint, budget double")
    plans = F.broadcast(plans) if len(plan) <= BROADCAST_SOURCES else plans

    def with_plan(df: DataFrame, plans: DataFrame) -> DataFrame:
        right = plans.withColumnRenamed("source", "plan_source")
        return df.join(right, df["source"].eqNullSafe(right["plan_source"])).drop("plan_source")

    # where each source's budget ends: the first range whose words, with those before, reach it
    sums = with_plan(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), plans.select("source", "budget"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = sums.withColumn("upto", upto).where("upto >= budget").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    ends = ends.select("source", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before"))
    ends = spark.createDataFrame([tuple(r) for r in ends.collect()], "source string, end_bucket int, before bigint")  # one row for each source
    ends = F.broadcast(ends) if len(plan) <= BROADCAST_SOURCES else ends
    right = ends.withColumnRenamed("source", "end_source")
    rows = with_plan(sized, plans)
    rows = rows.join(right, rows["source"].eqNullSafe(right["end_source"]), "left").drop("end_source")
    at = F.coalesce("end_bucket", F.lit(BUCKETS))
    sure = rows.where(F.col("bucket") != at).withColumn("extra", (F.col("bucket") < at).cast("bigint"))
    inside = rows.where(F.col("bucket") == at)
    so_far = F.sum("size").over(Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("extra", (F.col("before") + so_far - F.col("size") / 2 <= F.col("budget")).cast("bigint"))
    out = sure.unionByName(inside).withColumn("taken", (F.col("epochs") + F.col("extra")) * F.col("size"))
    mixed = ["size", "source_size", "target", (F.col("epochs") + F.col("extra")).alias("epochs"), "taken"]
    if whole:
        own = [c for c in docs.columns if c not in ("size", "source_size", "target", "epochs", "taken")]
        return out.select(*[F.col(f"row.`{c}`").alias(c) for c in own], *mixed)
    return out.select(F.col("id").alias(id_col), "source", *mixed)


def report(docs: DataFrame, **how) -> DataFrame:
    return mix(docs, **how).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12)) AS BIGINT) + 1.0::DOUBLE) / 281474976710657.0::DOUBLE)
                  / coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - length(regexp_replace(text, '[\p{L}\x20\x09-\x0D]+', '', 'g'))::DOUBLE / greatest(1, length(text))), 1.0::DOUBLE) AS key
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0) AS caps_before, coalesce(sum(weight) OVER o, 0) AS weights_before
      FROM w WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (total - caps_before) / (weights - weights_before) AS level FROM f),
lv AS (SELECT (SELECT level FROM g WHERE 3.0::DOUBLE * source_size > level * weight ORDER BY 3.0::DOUBLE * source_size / weight, source IS NULL, source LIMIT 1) AS level),
t AS (SELECT source, source_size, CASE WHEN lv.level IS NULL THEN 3.0::DOUBLE * source_size ELSE least(3.0::DOUBLE * source_size, lv.level * weight) END AS target FROM g, lv),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.*, e.source_size, e.target, e.epochs, greatest(0, e.target - e.epochs * e.source_size) AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 4) AS target, CAST((epochs + CASE WHEN upto - size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""
