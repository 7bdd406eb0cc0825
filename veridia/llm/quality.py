"""Quality classifier (operator 3): histogram gradient-boosted trees over document statistics.

Statistics of whole texts (`features`) are binned by quantiles; trees are grown level by level from
gradient histograms and kept as complete binary trees in flat arrays, so that scoring is a few numpy
gathers for all rows and trees at once.  The model is fitted on a bounded, repeatable sample of
the labelled rows; scoring reads every row once, without a shuffle.

Defined results: null text counts as empty; empty texts get the score of their statistics (zeros);
several labels of one document count by their mean; null labels are left out; of several labelled rows
with one id the one with the smallest statistics is learned from; where nothing can be
learned, the score is the share of label 1, or 0.5; rows are scored independently.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, uniform

#: At most about so many labelled rows are learned from; a documented bound.
TRAIN_ROWS = 12_000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.12
THRESHOLD = 0.3

FEATURES = [
    "bytes", "words", "lines", "mean_word", "space_share", "digit_share", "upper_share", "symbol_share", "mark_share",
    "pipe_share", "other_share", "letter_share", "entropy", "distinct_words", "top_word", "distinct_pairs", "distinct_lines",
    "words_a_line", "short_lines", "long_words", "symbol_words", "compressed", "sentence_ends", "top_symbol",
]

_CLASS = np.full(256, 5, dtype=np.int64)  # other symbols
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[97:123] = 3
_CLASS[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4
_CLASS[124] = 6
_CLASS[128:] = 7
_SYMBOLS = np.flatnonzero(_CLASS == 5)
_ODD = re.compile(rb"[^\x30-\x39A-Za-z\x80-\xff\s.,;:!?'\"()|-]{2,}")


def features(texts: list[bytes | None]) -> np.ndarray:
    """texts x FEATURES."""
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float64)
    squeeze = zstandard.ZstdCompressor(level=1)
    for i, x in enumerate(texts):
        if not x:
            continue
        each = np.bincount(np.frombuffer(x, dtype=np.uint8), minlength=256)
        space, digit, upper, lower, mark, symbol, pipe, other = np.bincount(_CLASS, weights=each, minlength=8) / len(x)
        words, lines = x.split(), x.split(b"\n")
        n = max(1, len(words))
        p = each[each > 0] / len(x)
        pairs = set(zip(words, words[1:]))
        most = max(Counter(words).values(), default=0)
        out[i] = (
            np.log1p(len(x)), np.log1p(len(words)), np.log1p(len(lines)), (1 - space) * len(x) / n, space, digit, upper, symbol, mark,
            pipe, other, lower + upper + other, -(p * np.log2(p)).sum(), len(set(words)) / n, most / n, len(pairs) / n, len(set(lines)) / len(lines),
            np.log1p(len(words) / len(lines)), sum(len(y) < 20 for y in lines) / len(lines), sum(len(w) > 20 for w in words) / n, len(_ODD.findall(x)) / n,
            len(squeeze.compress(x)) / len(x), (x.count(b". ") + x.count(b".\n") + x.endswith(b".")) / n, each[_SYMBOLS].max() / len(x),
        )
    return out


@dataclass
class Forest:
    """Complete binary trees: children of node i are 2i+1 and 2i+2. feature, threshold: trees x inner nodes; leaf: trees x leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while inner and node.size and node[0] < inner:  # all rows go down one level a turn
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Logistic loss; y between 0 and 1."""
    inner = 2**depth - 1
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], axis=1)
    n_features = x.shape[1]
    margin = np.full(len(y), base)
    all_feature, all_threshold, all_leaf = [], [], []
    slot = np.arange(n_features) * BINS + binned  # of each row and feature in one node's histogram
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (n_features * BINS) + slot).ravel()
            size = count * n_features * BINS
            hist = [np.bincount(at, weights=np.repeat(v, n_features), minlength=size).reshape(count, n_features, BINS).cumsum(axis=2) for v in (g, h)]
            (gl, hl), (gt, ht) = hist, (a[:, :, -1:] for a in hist)
            part = lambda a, b: a * a / (b + 1.0)
            gain = np.where((hl > 2) & (ht - hl > 2), part(gl, hl) + part(gt - gl, ht - hl) - part(gt, ht), 0)
            best = gain.reshape(count, -1).argmax(axis=1)
            f, b = best // BINS, best % BINS
            ok = gain.reshape(count, -1).max(axis=1) > 1e-6
            here = first + np.arange(count)
            feature[here] = f
            threshold[here] = [edges[k][c] if good and c < len(edges[k]) else np.inf for k, c, good in zip(f, b, ok)]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_of = node - inner
        leaf = -rate * np.bincount(leaf_of, weights=g, minlength=inner + 1) / (np.bincount(leaf_of, weights=h, minlength=inner + 1) + 1.0)
        margin += leaf[leaf_of]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_leaf.append(leaf)
    return Forest(base, np.array(all_feature), np.array(all_threshold), np.array(all_leaf))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, label, text of the documents of about `rows` labelled ids at most, chosen by a hash of the id. usable: a
    condition on id_col. The ids, as many as `rows` says, are broadcast, so no other document leaves its scan."""
    given = labels.where(usable).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("label is not null and id is not null")
    n = given.count()
    chosen = given.where(uniform("id") < min(1.0, rows / max(1, n))).groupBy("id").agg(F.avg("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("id", "label", "text")


def learn(docs: DataFrame, labels: DataFrame, label_col: str, usable, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Statistics are taken where a text is read; one row of FEATURES numbers for each of about `rows` ids comes to the driver."""
    sample = labelled_sample(docs, labels, label_col, usable, rows, id_col, text_col)
    kind = sample.schema["id"].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            x = features(batch.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["id", "label", "x"])

    measured = sample.mapInArrow(lean(measure), f"id {kind}, label double, x array<double>")
    found = measured.groupBy("id").agg(F.min(F.struct("label", "x")).alias("row")).select("row.label", "row.x").toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), len(FEATURES))
    y = found["label"].to_numpy(dtype=np.float64)
    order = np.lexsort((y, *x.T))  # the rows come in any order, sums of floating-point numbers depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(forest)  # TREES x 2^DEPTH numbers

    def mark(batches):
        for batch in batches:
            s = shipped.value.score(features(batch.column(1).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(lean(mark), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
