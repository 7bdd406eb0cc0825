r"""Benchmark decontamination (operator 2), with DataFrame functions only.

A window is `window` consecutive words of a benchmark item (all words of a shorter item).  A document
word is hit if it lies inside an occurrence of a window.  The join is a prefix-filtered containment
join: a window is a set of shingles with offsets; shingles are ordered by how rare they are in the
documents; since a window must be contained entirely, its necessary prefix is its rarest shingle
alone.  Documents meet windows only in that shingle; the shingle's offset gives the only start that
is possible (positional bound), which must leave room for the whole window (length bound); the words
around the match are then compared one by one.

The scan of the documents makes one pass: texts are cut into words and shingles, and a shingle
leaves the scan only if an item has it, with the words around it.  The item shingles are broadcast
if a count shows that there are at most BROADCAST_SHINGLES of them and joined by a shuffle otherwise.

Defined results: null or wordless texts have 0 words and no hits; null or wordless items have no
windows; repeated document rows are rows of their own; items that repeat an id count once; an item
whose id is null hits words but isn't listed; without items nothing is contaminated.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digest, file_backed, materialise

WINDOW = 10
SHINGLE = 5
BROADCAST_SHINGLES = 500_000
SHA = "decontaminate_sha"
#: Keys that the places of one shingle are spread over where they meet the windows.
SALTS = 8
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, NOT_WORD), "")


def shingles_of(words: Column, size: int) -> Column:
    """Hashes of all runs of `size` words, in order."""
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(F.array().cast("array<bigint>"))


def windows_of(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, win (the words), k (shingle size), h (array: the hash of the shingle at each offset)."""
    cut = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.lit(window), F.size("words"))
    wins = cut.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("win")).distinct()
    k = F.least(F.lit(shingle), F.size("win"))
    at = F.sequence(F.lit(1), F.size("win") - k + 1)
    return wins.select("item", "win", k.alias("k"), F.transform(at, lambda i: F.xxhash64(F.slice("win", i, k))).alias("h"))


def matches(docs: DataFrame, windows: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document (h null) and one for each place where it has a shingle of an item:
    rid, id_col, n, pos, k, h, around (the words from pos - window on), materialised."""
    known = windows.select("k", F.explode("h").alias("h")).distinct()
    sizes = {r["k"]: r["n"] for r in known.groupBy("k").agg(F.count("*").alias("n")).collect()}  # at most SHINGLE rows
    if sum(sizes.values()) <= BROADCAST_SHINGLES:
        known = F.broadcast(known)
    # the row number stands beside the words so that the optimizer can't copy their expression upwards, into the loop over shingles
    cut = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), words_of(F.col(text_col).cast("string")).alias("words"))
    cut = cut.select("rid", "id", "words", F.size("words").alias("n"))
    head = F.array(F.lit(None).cast("bigint"))
    all_h = cut.select("rid", "id", "words", "n", F.concat(head, *[shingles_of(F.col("words"), k) for k in sorted(sizes)]).alias("all_h"))
    each = all_h.select("rid", "id", "words", "n", F.posexplode("all_h").alias("p", "h"))
    # p counts through the head and the shingles of each size: get the size and the position back
    pos, k, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for size in sorted(sizes):
        count = F.greatest(F.lit(0), F.col("n") - (size - 1))
        here = (F.col("p") >= before) & (F.col("p") < before + count)
        pos, k, before = F.when(here, F.col("p") - before).otherwise(pos), F.when(here, F.lit(size)).otherwise(k), before + count
    if sizes:
        # a null h never joins: the row of the document itself stays by the left join's condition
        found = each.join(known.select(F.col("h").alias("known_h"), F.col("k").alias("known_k")), F.col("h") == F.col("known_h"), "left").where(F.col("h").isNull() | (F.col("known_k") == k))
    else:
        found = each.where(F.col("h").isNull())
    low = F.greatest(pos - window, F.lit(0))
    around = F.when(F.col("h").isNotNull(), F.slice("words", low + 1, 3 * window))
    out = found.select("rid", "id", "n", F.when(F.col("h").isNotNull(), pos).alias("pos"), "h", around.alias("around"))
    return materialise(out, "decontaminate")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of docs: rid (a number of this reading), id_col, n_words, n_hit, items (sorted ids of the items with occurring
    windows), spans (merged runs of hit words: from, to), contaminated."""
    windows = windows_of(items, window, shingle, item_col, item_text)
    m = matches(docs, windows, window, id_col, text_col)
    found = m.where("h is not null")
    # rarity over all documents, of the shingles that items have
    rarity = found.groupBy("h").agg(F.count("*").alias("df"))
    offset = windows.select("item", "win", F.posexplode("h").alias("offset", "h")).join(rarity, "h", "left")
    prefix = offset.groupBy("item", "win").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("rarest")).where("rarest.df > 0")
    prefix = prefix.select("item", "win", F.size("win").alias("len"), F.col("rarest.h").alias("h"), F.col("rarest.offset").alias("offset"))
    start = F.col("pos") - F.col("offset")
    # a common word that is an item has places in many documents: they are spread over SALTS keys
    salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    bounded = found.withColumn("salt", F.pmod(F.xxhash64("rid", "pos"), F.lit(SALTS))).join(salted, ["h", "salt"]).where((start >= 0) & (start + F.col("len") <= F.col("n")))
    low = F.greatest(F.col("pos") - window, F.lit(0))
    exact = bounded.where(F.slice("around", start - low + 1, F.col("len")) == F.col("win"))
    span = F.struct(start.alias("from"), (start + F.col("len")).alias("to"))
    rows = m.where("h is null").select("rid", "id", "n", F.lit(None).cast("struct<from:int,to:int>").alias("span"), F.lit(None).cast("string").alias("item"))
    rows = rows.union(exact.select("rid", "id", "n", span.alias("span"), "item"))
    by_doc = rows.groupBy("rid").agg(F.first("id").alias("id"), F.max("n").alias("n"), F.collect_set("span").alias("spans"), F.collect_set("item").alias("items"))
    state = "struct<hit:bigint,last:int>"
    covered = F.aggregate(
        F.sort_array("spans"),
        F.expr(f"cast(named_struct('hit', 0, 'last', 0) as {state})"),
        lambda s, x: F.struct((s["hit"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], s["last"]))).cast("bigint").alias("hit"), F.greatest(x["to"], s["last"]).alias("last")),
        lambda s: s["hit"],
    )
    out = by_doc.select("rid", F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_words"), covered.alias("n_hit"), F.sort_array("items").alias("items"), F.sort_array("spans").alias("spans"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without the rows that have a word of a window; other rows and all columns stay. The decision
    depends on the text alone and is joined back by its digest, so two readings need the same texts but not the same splits."""
    docs, text_col = file_backed(docs), how.get("text_col", "text")
    known = docs.select(digest(text_col).alias("sha"), F.col(text_col))
    hit = materialise(contamination(known, items, **how | {"id_col": "sha"}).where("contaminated").select(F.col("sha").alias(SHA)).distinct(), "contaminated")
    return docs.withColumn(SHA, digest(text_col)).join(hit, SHA, "left_anti").drop(SHA)


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The digest of `contamination`: items as their number and the sha256 of their ids."""
    found = contamination(docs, items, **how)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


REPORT_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s
        FROM (SELECT item, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
place AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
          FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, win.k AS k, item FROM place JOIN win USING (k, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
