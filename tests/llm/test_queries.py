"""Every registered query of the ten operators, run as it is over the smallest tables, against its SQL or against a
plain computation row by row."""

import hashlib
import math
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from test_operators import base_spans

from veridia.llm import lang_id, quality, toxicity
from veridia.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, SF).select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_secrets(spark, texts):
    rows = QUERIES["op6_secrets"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))


def test_token_counts(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    rows = QUERIES["op8_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
        assert len(tokenizer.encode(text[: r["limit_chars"]], add_special_tokens=False).ids) <= 2048


def test_language(spark, duck, texts):
    """Learning, script ranges, scores and Viterbi, all letter by letter in plain Python."""
    m, letter = (1 << 64) - 1, [False, True]

    def words(text):
        out, own = [], []
        for i, ch in enumerate(text):
            if ch.isalpha():
                own.append((i, ch))
            elif own:
                out.append(own)
                own = []
        return out + ([own] if own else [])

    def script(ch):
        return [s for a, s in lang_id.SCRIPTS if a <= ord(ch)][-1]

    def window(a, b, c):
        h = (b * 0x9E3779B97F4A7C15 + a * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & m
        return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 & m) >> 48

    def windows(word):
        codes = [0, *(ord(ch.lower()) if len(ch.lower()) == 1 else ord(ch) for _, ch in word), 0]
        return [window(*codes[k : k + 3]) for k in range(len(word))]

    langs = dict(duck.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL").fetchall())
    counts, scripts = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for i, lang in langs.items():
        if not held(i, 3, 1):
            for w in words(texts[i]):
                for x in windows(w):
                    counts[lang][x] += 1
                for _, ch in w:
                    scripts[lang][script(ch.lower() if len(ch.lower()) == 1 else ch)] += 1
    names = sorted(counts)
    total = {k: sum(counts[k].values()) for k in names}
    assert letter
    for r in QUERIES["op1_language_id"](spark, SF).collect():
        assert r["held_out"] == held(r["doc_id"], 3, 1)
        found = words(texts[r["doc_id"]] or "")
        if not found:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        best, back = None, []
        for w in found:
            own = {k: sum(math.log((counts[k][x] + 0.1) / (total[k] + 0.1 * lang_id.BUCKETS)) for x in windows(w)) for k in names}
            first = w[0][1].lower() if len(w[0][1].lower()) == 1 else w[0][1]
            can = [k for k in names if scripts[k][script(first)] >= max(1, lang_id.SCRIPT_SHARE * sum(scripts[k].values()))]
            own = {k: (own[k] if k in can else -math.inf) if can else 0.0 for k in names}
            if best is None:
                best = own
            else:
                top = max(names, key=lambda k: best[k])
                step = {k: k if best[k] >= best[top] - lang_id.SWITCH_PENALTY else top for k in names}
                back.append(step)
                best = {k: max(best[k], best[top] - lang_id.SWITCH_PENALTY) + own[k] for k in names}
        path = [max(names, key=lambda k: best[k])]
        for step in reversed(back):
            path.append(step[path[-1]])
        share = defaultdict(int)
        for w, k in zip(found, reversed(path)):
            share[k] += len(w)
        most = max(share.values())
        assert share[r["lang_pred"]] / sum(share.values()) == pytest.approx(r["score"], abs=0.02) and share[r["lang_pred"]] >= 0.95 * most


def test_quality(spark, duck, texts):
    """The query's scores from a forest learned and walked in plain Python on the same labels."""
    labels = dict(duck.execute("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall())
    taught = sorted(i for i in labels if i in texts and not held(i, 5, 0))
    x = quality.features([(texts[i] or "").encode() for i in taught])
    y = np.array([float(labels[i]) for i in taught])
    order = np.lexsort((y, *x.T))
    forest = quality.fit(x[order], y[order])

    def walk(row):
        s = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + (2 if row[f[i]] > t[i] else 1)
            s += leaf[i - len(f)]
        return 1 / (1 + math.exp(-s))

    for r in QUERIES["op3_quality"](spark, SF).collect():
        want = walk(quality.features([(texts[r["doc_id"]] or "").encode()])[0])
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 5, 0)


def test_toxicity(spark, duck, texts):
    """The query's scores are sums of weights over the words and beginnings of words, found one by one."""
    from pyspark.sql import functions as F

    from veridia.llm.common import crc_mod, hash_words

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    c = toxicity.learn(docs, labels, "toxic", crc_mod("doc_id", 3) != F.lit(1))
    place = {int(s): k for k, s in enumerate(c.slots)}
    for r in QUERIES["op10_toxicity"](spark, SF).collect():
        text, slots, seen = texts[r["doc_id"]] or "", set(), set()
        low = text.lower().encode()
        for w in "".join(chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in low).split(" "):
            raw = w.encode("latin-1")
            if not raw or raw in seen:
                continue
            seen.add(raw)
            h, _, heads = hash_words([raw], toxicity._NOT_LETTER, toxicity.PREFIXES)
            for kind, n in enumerate((len(raw), *toxicity.PREFIXES)):
                if not kind or len(raw) > n:
                    slots.add(int((h[0] if not kind else heads[kind - 1][0]) % np.uint64(toxicity.SLOTS)) + kind * toxicity.SLOTS)
        hit = [place[s] for s in slots if s in place]
        margin = c.bias + sum(c.weight[k] for k in hit) + sum(g for g, m in zip(c.group, c.member) if any(m[k] for k in hit))
        margin += float(toxicity.surface([text])[0] @ c.marks)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, margin)))), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(r["doc_id"], 3, 1)


def test_rows_keep_their_identity_when_splits_change(spark, tmp_path):
    """What a stage decides must hold for the same rows if the cluster splits the files otherwise in between."""
    from veridia.llm import decontaminate, ngram_join, secrets

    rows = [(i % 70, f"w{i % 90} a b c d e f g{i % 90} " + ("secret=abcdefgh" if i % 9 == 0 else ""), i, "x", "y") for i in range(300)]
    schema = "doc_id bigint, text string, rid bigint, findings string, sha string"
    spark.createDataFrame(rows, schema).repartition(12).write.parquet(str(tmp_path / "docs"))
    items = spark.createDataFrame([(1, "w7 a b c d e f g7")], "item_id bigint, text string")
    for stage in (ngram_join.one_of_each, lambda d: decontaminate.clean(d, items), secrets.redact):
        results = []
        for before, after in (("1", "1"), ("1", "40"), ("40", "2")):
            spark.conf.set("spark.sql.files.minPartitionNum", before)
            made = stage(spark.read.parquet(str(tmp_path / "docs")))
            spark.conf.set("spark.sql.files.minPartitionNum", after)
            assert made.columns == [c.split()[0] for c in schema.split(", ")]
            results.append(sorted(map(tuple, made.select("doc_id", "text", "findings", "sha").collect())))
            spark.conf.unset("spark.sql.files.minPartitionNum")
        assert results[0] == results[1] == results[2] and results[0]
