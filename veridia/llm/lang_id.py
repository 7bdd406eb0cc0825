r"""Language ID (operator 1): script ranges narrow candidates, Viterbi labels spans.

A word is a run of letters.  Its score for a language is the sum of the log probabilities of the
three-letter windows centred on its letters (the edges of the word count as a mark), smoothed, from
counts over a bounded sample of labelled rows.  The script of a word's first letter leaves only
languages that are written in that script.  Viterbi over the words of a text, with a penalty for
each switch of language, labels spans; the text's language is the one whose spans hold most letters
and its score is their share of the letters.

Defined results: null text or a text without a letter has `und` and score 0; so has everything where
no row can be learned from; every language that some row names can be predicted (more than MOST_LANGUAGES
are an error, none is left out); words in a script that no learned language uses take the label of their
neighbours; ties go to the language that sorts first; rows are independent of each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, uniform

UNKNOWN = "und"
BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
#: At most about so many labelled rows of each language are learned from; a documented bound.
TRAIN_ROWS_A_LANGUAGE = 4000
#: Characters whose letter windows, and whose words, are worked on at once.
PART, TOGETHER = 1 << 18, 2 << 20
#: A text of more characters is worked on in portions of about PART characters; its labels are the same.
LONG = 1 << 20
#: The model is BUCKETS numbers for each language and is broadcast; with more languages `learn` raises an error.
MOST_LANGUAGES = 2_000
#: Texts in which no language holds so much of the letters are rejected as filters go.
LEAST_SHARE = 0.4
#: A language uses a script if at least this share of its letters is written in it.
SCRIPT_SHARE = 0.01
#: First code points of ranges and the script from there on (fixed values).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1300, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"),
    (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0x20000, "han"), (0x30000, "other"),
]
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})

_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter, and the number of its script."""
    if not _tables:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        edges = np.array([a for a, _ in SCRIPTS])
        which = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS], dtype=np.uint8)
        _tables.extend([letter, which[np.searchsorted(edges, np.arange(0x110000), side="right") - 1]])
    return _tables[0], _tables[1]


@dataclass
class Words:
    """All words of some texts. first, last: of each word in the shared buffer; offset: of each text."""

    codes: np.ndarray
    windows: np.ndarray
    first: np.ndarray
    last: np.ndarray
    script: np.ndarray
    at: np.ndarray
    offset: np.ndarray


def find_words(texts: list[str | None]) -> Words:
    letter, script = _letters()
    low = [x or "" for x in texts]
    joined = "\n".join(low) + "\n"
    folded = joined.lower()
    if len(folded) != len(joined):  # a few characters grow in lower case: keep positions
        folded = "".join(c.lower() if len(c.lower()) == 1 else c for c in joined)
    codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[codes]
    edge = np.diff(is_letter.astype(np.int8), prepend=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    marked = np.where(is_letter, codes, 0).astype(np.uint64)
    h = marked * np.uint64(0x9E3779B97F4A7C15)
    h[1:] += marked[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
    h[:-1] += marked[1:] * np.uint64(0x165667B19E3779F9)
    windows = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int32)
    offset = np.concatenate([[0], np.cumsum([len(x) + 1 for x in low])])
    return Words(codes, windows, first, last, script[codes[first]] if len(first) else np.zeros(0, np.uint8), np.searchsorted(first, offset), offset)


def portions(text: str, most: int | None = None):
    """(from, to) of pieces of a text of about `most` characters, cut after white space, or where there is none
    for as many characters again, before a character that isn't a letter, so that no word is cut."""
    most, start = most or PART, 0
    while len(text) - start > most:
        end = start + most
        near = next((k + 1 for k in range(end, min(end + most, len(text))) if text[k].isspace()), None)
        end = near or next((k for k in range(end, len(text)) if not text[k].isalpha()), len(text))
        yield start, end
        start = end
    if start < len(text):
        yield start, len(text)


@dataclass
class Model:
    langs: list[str]
    log_p: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # scripts x languages

    def scores(self, w: Words) -> np.ndarray:
        """words x languages; -inf for a language that the word's script rules out."""
        out, a = np.zeros((len(w.first), len(self.langs)), np.float32), 0
        while a < len(out):  # words of about PART characters together; a longer word by pieces
            start = int(w.first[a])
            b = max(a + 1, int(np.searchsorted(w.last, start + PART, side="right")))
            if w.last[b - 1] - start > PART:
                pieces = range(start, int(w.last[a]), PART)
                out[a] = sum(self.log_p[w.windows[x : min(x + PART, int(w.last[a]))]].sum(axis=0, dtype=np.float64) for x in pieces)
            else:
                total = np.zeros((int(w.last[b - 1]) - start + 1, len(self.langs)))
                np.cumsum(self.log_p[w.windows[start : w.last[b - 1]]], axis=0, dtype=np.float64, out=total[1:])
                out[a:b] = total[w.last[a:b] - start] - total[w.first[a:b] - start]
            a = b
        can = self.allowed[w.script]
        return np.where(can | ~can.any(axis=1, keepdims=True), np.where(can, out, 0), -np.inf).astype(np.float32)


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word. All texts advance together, one word a step, longest first."""
    n_words = np.diff(at)
    order = np.argsort(-n_words, kind="stable")
    start, length = at[:-1][order], n_words[order]
    steps = int(length[0]) if len(length) else 0
    alive = len(length) - np.searchsorted(length[::-1], np.arange(steps), side="right")
    n_lang = scores.shape[1]
    back = np.empty(scores.shape, dtype=np.int16)
    own = np.arange(n_lang, dtype=np.int16)[None, :]
    best = np.zeros((len(length), n_lang), dtype=np.float32)
    rows = np.arange(len(length))
    for t in range(steps):
        k = alive[t]
        v, at_t = best[:k], start[:k] + t
        if t:
            top = v.argmax(axis=1)
            jump = (v[rows[:k], top] - penalty)[:, None]
            stay = v >= jump
            back[at_t] = np.where(stay, own, top[:, None].astype(np.int16))
            np.maximum(v, jump, out=v)
        v += scores[at_t]
        if t % 64 == 0:  # keeps 32-bit sums exact enough on very long texts
            v -= v.max(axis=1, keepdims=True)
    label = np.zeros(len(scores), dtype=np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at_t = start[:k] + t
        label[at_t] = state[:k]
        if t:
            state[:k] = back[at_t, state[:k]]
    return label


def learn(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", rows_a_language: int = TRAIN_ROWS_A_LANGUAGE) -> Model:
    """Counts letter windows for each language over a bounded, repeatable sample of the labelled rows of docs."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} languages, which a model can't hold")
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, rows_a_language / counts[k]))])
    sample = labelled.where(uniform("id") < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", "text")
    width = BUCKETS + len(SCRIPT_NAMES)

    def count(batches):
        total = np.zeros((len(langs), width), dtype=np.int64)
        number = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            lang, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = [(k, x[a:b]) for k, x in zip(lang, text) for a, b in portions(x, LONG)]
            for a, b in slices([x for _, x in cut], LONG):
                w = find_words([x for _, x in cut[a:b]])
                which = np.repeat(np.array([number[k] for k, _ in cut[a:b]]), np.diff(w.offset))
                letter, script = _letters()
                inside = letter[w.codes]
                np.add.at(total, (which[inside], w.windows[inside]), 1)
                np.add.at(total, (which[inside], BUCKETS + script[w.codes[inside]].astype(np.int64)), 1)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * width + j, pa.int64()), pa.array(total[i, j], pa.int64())], names=["slot", "n"])

    total = np.zeros(len(langs) * width, dtype=np.float64)
    # at most languages x (BUCKETS + scripts) rows come back, however many documents there are
    found = sample.mapInArrow(lean(count), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    total[found["slot"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    total = total.reshape(len(langs), width)
    windows, scripts = total[:, :BUCKETS], total[:, BUCKETS:]
    p = (windows + 0.1) / (windows.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)
    allowed = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True))
    return Model(langs, np.ascontiguousarray(np.log(p).T, dtype=np.float32), np.ascontiguousarray(allowed.T))


def label_long(text: str, model: Model, penalty: float = SWITCH_PENALTY) -> tuple[str, float, list[tuple[int, int, str]]]:
    """What label_texts finds, with the scores of one portion of the text at a time; of each word stay its place, the best
    language before it and a bit for each language: whether a path stays in it."""
    firsts, lasts, tops, stays, best = [], [], [], [], np.zeros(len(model.langs), np.float32)
    done = 0
    for a, b in portions(text):
        w = find_words([text[a:b]])
        scores = model.scores(w)
        top, stay = np.zeros(len(scores), np.int16), np.ones(scores.shape, bool)
        for i in range(len(scores)):
            if done:
                top[i] = best.argmax()
                jump = best[top[i]] - np.float32(penalty)
                stay[i] = best >= jump
                np.maximum(best, jump, out=best)
            best += scores[i]
            if done % 64 == 0:
                best -= best.max()
            done += 1
        firsts.append(w.first + a)
        lasts.append(w.last + a)
        tops.append(top)
        stays.append(np.packbits(stay, axis=1))
    if not model.langs or not done:
        return UNKNOWN, 0.0, []
    label, state, at = np.empty(done, np.int16), int(best.argmax()), done
    for top, packed in zip(reversed(tops), reversed(stays)):
        stay = np.unpackbits(packed, axis=1, count=len(model.langs))
        for i in range(len(top) - 1, -1, -1):
            at -= 1
            label[at] = state
            if not stay[i, state]:
                state = int(top[i])
    return _summary(label, np.concatenate(firsts), np.concatenate(lasts), model)


def _summary(label: np.ndarray, first: np.ndarray, last: np.ndarray, model: Model) -> tuple[str, float, list[tuple[int, int, str]]]:
    """The language, score and spans of one text from the languages of its words."""
    runs = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(label)]
    spans = [(int(first[x]), int(last[y - 1]), model.langs[label[x]]) for x, y in zip(runs, runs[1:])]
    share = np.bincount(label, weights=last - first, minlength=len(model.langs))
    k = int(share.argmax())
    return model.langs[k], float(share[k] / share.sum()), spans


def label_texts(texts: list[str | None], model: Model, penalty: float = SWITCH_PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text its language, score and spans (from, to, language; code points)."""
    long = [i for i, x in enumerate(texts) if x and len(x) > LONG]
    if long:
        out = label_texts([None if x and len(x) > LONG else x for x in texts], model, penalty)
        for i in long:
            out[i] = label_long(texts[i], model, penalty)
        return out
    scores, first, last, starts, offset, base = [np.zeros((0, len(model.langs)), np.float32)], [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)], 0
    for a, b in slices(texts, PART):  # the buffers of a part, many bytes for each character, go before the next one's come
        w = find_words(texts[a:b])
        scores.append(model.scores(w))
        first.append(w.first)
        last.append(w.last)
        starts.append(w.at[:-1] + base)
        offset.append(w.offset[:-1])
        base += len(w.first)
    scores, first, last, offset = np.concatenate(scores), np.concatenate(first), np.concatenate(last), np.concatenate(offset)
    at = np.concatenate([*starts, [base]]).astype(np.int64)
    if not model.langs or not len(first):
        return [(UNKNOWN, 0.0, [])] * len(texts)
    label = viterbi(scores, at, penalty)
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        out.append(_summary(label[a:b], first[a:b] - offset[i], last[a:b] - offset[i], model) if a < b else (UNKNOWN, 0.0, []))
    return out


def accepted(docs: DataFrame, model: Model, least: float = LEAST_SHARE, penalty: float = SWITCH_PENALTY, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text has no letter or no language that holds `least` of its letters."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p, model.allowed))

    def keep(batches):
        model = Model(*shipped.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            found = [x for a, b in slices(texts, TOGETHER) for x in label_texts(texts[a:b], model, penalty)]
            yield batch.filter(pa.array([k != UNKNOWN and s >= least for k, s, _ in found], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' columns id_col plus lang_pred, score and spans (array of from, to, lang)."""
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_p, model.allowed))  # languages x 256 KB
    span = pa.struct([("from", pa.int64()), ("to", pa.int64()), ("lang", pa.string())])

    def label(batches):
        model = Model(*shipped.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [x for a, b in slices(texts, TOGETHER) for x in label_texts(texts[a:b], model, penalty)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([[{"from": a, "to": b, "lang": k} for a, b, k in x[2]] for x in found], pa.list_(span))],
                names=["id", "lang_pred", "score", "spans"],
            )

    schema = f"id {kind}, lang_pred string, score double, spans array<struct<from:bigint,to:bigint,lang:string>>"
    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(lean(label), schema).withColumnRenamed("id", id_col)
