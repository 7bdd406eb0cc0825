"""Toxicity (operator 10): weak supervision.

1. Lexicons: whole words and word beginnings whose document frequency among rows marked toxic stands
   out (log odds with a significance bound, a greedy cover).  Each lexicon is mined by itself: from one
   family of features (words, short, long, longest beginnings) and one part of the sample (either half
   or the whole).  A list of known insults and patterns (phrases, an insult after an address,
   exclamation marks, shouting) stand beside them.
2. Each lexicon, list or pattern is a voter: toxic, clean or no vote for a text.
3. A generative label model estimates by expectation maximisation how each voter votes for toxic and
   for clean texts.  Voters that depend on each other given the class are joined to a forest (the
   strongest conditional mutual information first); a voter's votes then have a table for each vote
   of the one above it, so copies of a voter add no evidence.
4. A linear classifier over presence features (entries, and whether a lexicon has any) is trained on the
   model's posterior labels, never on the given ones.

Everything is fitted on a bounded, repeatable sample of the labelled ids.  Features are taken where a
text is read; the driver gets at most ABLE features for each lexicon and a bit for each row and one of
them.  Scoring reads each row once, without a shuffle.

Defined results: null text counts as empty; empty texts get the classifier's score without features;
where nothing can be learned only the known insults and patterns speak; of several labelled rows with
one id one is learned from; rows are scored independently.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_words, lean, materialise, remove, slices
from .quality import labelled_sample

#: At most about so many labelled ids are learned from; a documented bound.
TRAIN_ROWS = 12_000
#: Presence features of each kind (words, and beginnings of each length in bytes) are hashed into so many slots.
SLOTS = 1 << 18
PREFIXES = tuple(range(3, 11))
#: Kinds of features that a lexicon is mined from: 0 are words, k the k-th of PREFIXES.
FAMILIES = ((0,), (1, 2, 3), (4, 5, 6), (7, 8))
HALVES = 2
PARTS = HALVES + 1  # the last is the whole sample
#: Features that a lexicon is chosen from, and that it has, at most.
ABLE, KEPT = 512, 128
THRESHOLD = 0.7
#: Each toxic text is to be covered by so many entries of a lexicon; a clean text weighs so much against one.
COVER, PENALTY = 3, 2.0
#: Toxic texts that an entry is in at least, as a number and as a share of those of its part of the sample.
LEAST, LEAST_SHARE = 2, 0.006
#: Conditional mutual information from which on two voters are joined.
DEPENDS = 0.005
#: Insults that are known beforehand.
INSULTS = ["clown", "disgusting", "dumb", "fool", "hate", "idiot", "loser", "moron", "pathetic", "scum", "shut up", "stupid", "trash", "ugly", "useless", "worthless"]
PATTERNS = ("phrase", "address", "exclaims", "shouts")

_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[97:123] = False
_NOT_LETTER[128:] = False
_PHRASE = re.compile(r"\b(?:" + "|".join(x.replace(" ", r"\s+") for x in INSULTS if " " in x) + r")\b")
_ADDRESS = re.compile(r"\b(?:you|you\s+are|such|such\s+an?|an?)\s+(?:" + "|".join(x for x in INSULTS if " " not in x) + r")\b")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")


def _hash_of(word: str) -> int:
    h, _ = hash_words([word.encode()], _NOT_LETTER)
    return int(h[0] % np.uint64(SLOTS))


LISTED = np.array(sorted({_hash_of(x) for x in INSULTS if " " not in x}), dtype=np.int64)


def presence(texts: list[bytes]) -> list[np.ndarray]:
    """For each lower-case text the sorted slots of its words and their beginnings; kind k has SLOTS from k * SLOTS on."""
    words, at, heads = hash_words(texts, _NOT_LETTER, PREFIXES)
    slots = [(h % np.uint64(SLOTS)).astype(np.int64) + k * SLOTS for k, h in enumerate((words, *heads))]
    has = [np.ones(len(words), bool), *(h != 0 for h in heads)]
    return [np.unique(np.concatenate([s[a:b][k[a:b]] for s, k in zip(slots, has)])) for a, b in zip(at, at[1:])]


def surface(texts: list[str]) -> np.ndarray:
    """texts x PATTERNS: is the pattern there?"""
    out = np.zeros((len(texts), len(PATTERNS)), dtype=np.int8)
    for i, x in enumerate(texts):
        low, marks = x.lower(), x.count("!")
        listed = [w for w in INSULTS if w.split(" ")[0] in low]  # the expressions run only where they can match
        phrase, address = any(" " in w for w in listed) and _PHRASE.search(low), any(" " not in w for w in listed) and _ADDRESS.search(low)
        out[i] = (bool(phrase), bool(address), marks * 200 > len(x), marks > 0 and len(_SHOUT.findall(x)) > 2)
    return out


@dataclass
class Classifier:
    """slots: which hashed features count, sorted; weight: one for each; marks: one for each of PATTERNS;
    member: lexicons x slots, which entries a lexicon has; group: one weight for each lexicon that has a hit."""

    slots: np.ndarray
    weight: np.ndarray
    marks: np.ndarray
    bias: float
    member: np.ndarray
    group: np.ndarray

    def score(self, found: list[np.ndarray], marks: np.ndarray) -> np.ndarray:
        out = self.bias + marks @ self.marks
        for i, f in enumerate(found):
            if len(self.slots) and len(f):
                hit = np.flatnonzero(f[np.minimum(np.searchsorted(f, self.slots), len(f) - 1)] == self.slots)
                if len(hit):
                    out[i] += self.weight[hit].sum() + self.group[self.member[:, hit].any(axis=1)].sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def choose(hit: np.ndarray, clean: np.ndarray, least: float = LEAST) -> np.ndarray:
    """Which features make a lexicon. hit: toxic texts x features; clean: clean texts that have each.
    A greedy cover: the next one adds most toxic texts not yet covered COVER times, less PENALTY for each clean one."""
    kept: list[int] = []
    open_, hit = np.full(len(hit), float(COVER), dtype=np.float32), hit.astype(np.float32)
    while len(kept) < KEPT and hit.shape[1]:
        gain = np.minimum(open_, 1) @ hit - PENALTY * clean
        gain[kept] = -1
        k = int(gain.argmax())
        if gain[k] < least:
            break
        kept.append(k)
        open_ = np.maximum(open_ - hit[:, k], 0)
    return np.array(sorted(kept), dtype=np.int64)


def forest(v: np.ndarray, p: np.ndarray) -> tuple[list[int], np.ndarray]:
    """For each voter the voter above it (-1: none), those with a conditional mutual information given the class of at
    least DEPENDS and the strongest first; and the correlations of the voters given the class."""
    n, voters = v.shape
    one = [(v == k).astype(float) for k in (-1, 0, 1)]
    info, rest = np.zeros((voters, voters)), np.zeros_like(v, dtype=float)
    for w in (1 - p, p):
        total = max(w.sum(), 1e-9)
        single = [(w[:, None] * x).sum(axis=0) / total for x in one]
        for a in range(3):
            for b in range(3):
                both = (one[a] * w[:, None]).T @ one[b] / total
                with np.errstate(divide="ignore", invalid="ignore"):
                    info += total / n * np.where(both > 0, both * np.log(both / np.outer(single[a], single[b])), 0)
        rest += w[:, None] * (v - (w @ v) / total)
    spread = rest.std(axis=0)
    scale = np.outer(spread, spread)
    correlated = np.where(scale > 1e-9, (rest.T @ rest / n) / np.maximum(scale, 1e-9), 0)
    above, inside = [-1] * voters, list(range(voters))
    pairs = sorted(((-info[i, j], i, j) for i in range(voters) for j in range(i) if info[i, j] >= DEPENDS))
    near: dict[int, list[int]] = {i: [] for i in range(voters)}
    for _, i, j in pairs:  # Kruskal
        a, b = inside[i], inside[j]
        if a != b:
            near[i].append(j)
            near[j].append(i)
            inside = [a if x == b else x for x in inside]
    seen: set[int] = set()
    for root in range(voters):
        todo = [root] if root not in seen else []
        while todo:
            i = todo.pop()
            seen.add(i)
            for j in near[i]:
                if j not in seen:
                    above[j] = i
                    todo.append(j)
    return above, correlated


def label_model(v: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each text, P(vote | class) of each voter, and the voters' correlations given the class.
    v: texts x voters, 1 toxic, -1 clean, 0 no vote."""
    voters = v.shape[1]
    kinds = np.stack([v == k for k in (-1, 0, 1)], axis=2).astype(float)
    votes = v.sum(axis=1, dtype=np.float64)  # at first those with most votes are toxic, as many as the prior says
    p = 1 / (1 + np.exp(-np.clip(1.5 * (votes - np.quantile(votes, 1 - prior)) + 0.5, -4, 4))) if len(v) else votes
    above, correlated = [-1] * voters, np.eye(voters)
    code = v.astype(np.int64) + 1
    for r in range(rounds):
        if r in (2, 8, 16):  # at first of the majority's classes, then of settled ones
            above, correlated = forest(v, p)
        margin = np.full(len(v), np.log(prior / (1 - prior)))
        rate = np.stack([(kinds * w[:, None, None]).sum(axis=0) + 0.5 for w in (1 - p, p)])
        rate /= rate.sum(axis=2, keepdims=True)
        for j in range(voters):
            if above[j] < 0:
                margin += np.log(rate[1, j, code[:, j]] / rate[0, j, code[:, j]])
            else:
                cell = code[:, above[j]] * 3 + code[:, j]
                table = np.stack([(np.bincount(cell, weights=w, minlength=9).reshape(3, 3) + 2 * rate[k, j]) for k, w in enumerate((1 - p, p))])
                table /= table.sum(axis=2, keepdims=True)
                margin += np.log(table[1].ravel()[cell] / table[0].ravel()[cell])
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    return p, rate, correlated


def train_linear(x: np.ndarray, p: np.ndarray, rounds: int = 600, ridge: float = 3e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by accelerated gradient steps."""
    if not len(p):
        return np.zeros(x.shape[1]), -2.0
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float32)
    w = last = np.zeros(x.shape[1])
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 0
    top = np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest singular value
        top = x.T @ (x @ top)
        top /= np.linalg.norm(top) + 1e-30
    step = 4 / (float(np.linalg.norm(x @ top)) ** 2 * 1.05 / len(x) + 1e-9)
    for t in range(rounds):
        ahead = (w + (t / (t + 3)) * (w - last)).astype(np.float32)
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30))) - p) / len(x) + pull * ahead
        last, w = w, ahead - step * g
    return w[:-1], float(w[-1])


def fit(hit: np.ndarray, able: np.ndarray, lexicon: list[np.ndarray], marks: np.ndarray, y: np.ndarray, half: np.ndarray) -> Classifier:
    """hit: texts x able (slots, sorted); lexicon: for each family and part which of able it may have, mined from its own part."""
    listed = np.searchsorted(able, LISTED)
    toxic = y >= 0.5
    if not toxic.any():
        return Classifier(LISTED, np.full(len(LISTED), 4.0), np.array([4.0, 4.0, 0.0, 0.0]), -2.5, np.zeros((0, len(LISTED)), bool), np.zeros(0))
    voters, entries = [np.where(hit[:, listed].any(axis=1), 1, 0), *marks.T], [listed]
    for number, may in enumerate(lexicon):
        own = (half == number % PARTS) | (number % PARTS == HALVES)
        kept = may[choose(hit[own & toxic][:, may], hit[own & ~toxic][:, may].sum(axis=0), max(LEAST, LEAST_SHARE * (own & toxic).sum()))] if len(may) else may
        if len(kept):
            entries.append(kept)
            voters.append(np.where(hit[:, kept].any(axis=1), 1, -1))
    prior = float(np.clip(toxic.mean(), 0.01, 0.5))
    p, _, _ = label_model(np.column_stack(voters).astype(np.int8), prior)
    kept = np.unique(np.concatenate(entries))
    member = np.array([np.isin(kept, e) for e in entries])
    groups = np.column_stack([hit[:, e].any(axis=1) for e in entries])
    weight, bias = train_linear(np.column_stack([hit[:, kept], marks, groups]), p)
    n = len(kept)
    return Classifier(able[kept], weight[:n], weight[n : n + len(PATTERNS)], bias, member, weight[n + len(PATTERNS) :])


def learn(docs: DataFrame, labels: DataFrame, label_col: str, usable, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    sample = labelled_sample(docs, labels, label_col, usable, rows, id_col, text_col)
    kind = sample.schema["id"].dataType.simpleString()

    def measure(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            found = [f for a, b in slices(texts) for f in presence([x.lower().encode() for x in texts[a:b]])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(found, pa.list_(pa.int32())), pa.array(list(surface(texts)), pa.list_(pa.int8()))], names=["id", "label", "half", "slots", "marks"])

    parted = sample.select("id", "label", F.pmod(F.xxhash64("id"), F.lit(HALVES)).cast("int").alias("half"), "text")
    measured = parted.mapInArrow(lean(measure), f"id {kind}, label double, half int, slots array<int>, marks array<tinyint>")
    one = measured.groupBy("id").agg(F.min(F.struct("label", "half", "marks", "slots")).alias("row")).select("id", "row.*")
    sample = materialise(one, "toxicity")  # about `rows` rows

    def count(batches):
        top = SLOTS * (1 + len(PREFIXES))
        total = {}
        for batch in batches:
            for label, half, slots in zip(*(batch.column(k).to_pylist() for k in range(3))):
                total.setdefault((half, label >= 0.5), np.zeros(top, np.int32))[slots] += 1
        for (half, toxic), n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), half, np.int32)), pa.array(at), pa.array(np.where(toxic, n[at], 0).astype(np.int64)), pa.array(np.where(toxic, 0, n[at]).astype(np.int64))], names=["half", "slot", "toxic", "clean"])

    # of each part and family the ABLE features that stand out most
    counted = sample.select("label", "half", "slots").mapInArrow(lean(count), "half int, slot bigint, toxic bigint, clean bigint").groupBy("half", "slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = counted.unionByName(counted.groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).withColumn("half", F.lit(HALVES)))
    size = sample.select("label", F.explode(F.array("half", F.lit(HALVES))).alias("half")).groupBy("half").agg(F.sum((F.col("label") >= 0.5).cast("int")).alias("n_toxic"), F.sum((F.col("label") < 0.5).cast("int")).alias("n_clean"))
    family = F.lit(len(FAMILIES))
    for k, kinds in enumerate(FAMILIES):
        family = F.when(F.floor(F.col("slot") / SLOTS).isin(*kinds), F.lit(k)).otherwise(family)
    sure = F.log((F.col("toxic") + 0.25) / (F.col("n_toxic") + 1)) - F.log((F.col("clean") + 0.25) / (F.col("n_clean") + 1)) - 2 * F.sqrt(1 / (F.col("toxic") + 0.25) + 1 / (F.col("clean") + 0.25))
    rated = counted.where(F.col("toxic") >= LEAST).join(F.broadcast(size), "half").withColumn("family", family).withColumn("sure", sure).where("sure > 0.5")
    best = Window.partitionBy("half", "family").orderBy(F.desc(F.col("sure") + F.log(F.col("toxic") + 1)), "slot")
    chosen = rated.withColumn("k", F.row_number().over(best)).where(F.col("k") <= ABLE).select("half", "family", "slot").collect()
    able = np.unique(np.concatenate([LISTED, np.array([r["slot"] for r in chosen], dtype=np.int64)]))
    lexicon = [np.searchsorted(able, np.array(sorted(r["slot"] for r in chosen if (r["family"], r["half"]) == (f, h)), dtype=np.int64)) for f in range(len(FAMILIES)) for h in range(PARTS)]

    def bits(batches):
        for batch in batches:
            slots = [np.array(x, dtype=np.int64) for x in batch.column(3).to_pylist()]
            has = [np.packbits(np.isin(able, x, assume_unique=True)).tobytes() for x in slots]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(has, pa.binary())], names=["label", "half", "marks", "has"])

    rows_ = sample.select("label", "half", "marks", "slots").mapInArrow(lean(bits), "label double, half int, marks array<tinyint>, has binary").collect()
    rows_ = sorted(rows_, key=lambda r: (bytes(r["has"]), r["label"], r["half"], r["marks"]))  # sums depend on the order
    remove(sample)
    hit = np.unpackbits(np.frombuffer(b"".join(bytes(r["has"]) for r in rows_), np.uint8).reshape(len(rows_), -1), axis=1)[:, : len(able)] if rows_ else np.zeros((0, len(able)), np.uint8)
    marks = np.array([r["marks"] for r in rows_], dtype=np.int8).reshape(len(rows_), len(PATTERNS))
    return fit(hit, able, lexicon, marks, np.array([r["label"] for r in rows_], dtype=float), np.array([r["half"] for r in rows_], dtype=int))


def score(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, predicted for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(classifier)  # at most KEPT numbers for each lexicon

    def mark(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            texts = [t or "" for t in texts]
            s = np.array([x for a, b in slices(texts) for x in shipped.value.score(presence([t.lower().encode() for t in texts[a:b]]), surface(texts[a:b]))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["id", "score", "predicted"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(lean(mark), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
