"""The corpus pipeline against its stages by brute force, and the registered queries."""

import random

import pytest

import corpus_pipeline
from test_operators import brute_join, contamination_of, prose
from veridia.llm import lang_id, mixing, secrets
from veridia.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    rows = []
    for i in range(120):
        lang = rnd.choice(["en", "fr", "de"])
        rows.append([i, prose(rnd, lang, 40), lang, f"s{i % 4}", 0])
    for i in range(10):
        rows[50 + i][1] = rows[5][1] + (" more" if i % 2 else "")
    item = prose(rnd, "en", 15)
    for i in (70, 71):
        rows[i][1] += " " + item
    rows[80][1] += " token = abcdef0123456789"
    rows += [[200, None, None, None, None], [201, "123", "en", "s1", 3], [202, "", "en", "s1", 0]]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, item


def test_stages(spark, folder):
    sf_dir, rows, item = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    model = lang_id.learn(docs)
    want = {r[0]: r[1] for r in rows if (x := lang_id.label_texts([r[1]], model)[0])[0] != "und" and x[1] >= lang_id.LEAST_SHARE}
    steps = [lambda d: d]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        if name == "ngram_join":
            want = {i: want[i] for i in {c for _, n, c in brute_join(list(want.items()))}}
        elif name == "decontamination":
            want = {i: x for i, x in want.items() if not contamination_of(x, [(1, item)])[1]}
            assert 70 not in want and 71 not in want
        elif name == "secrets":
            want = {i: x.replace("token = abcdef0123456789", "[SECRET]") for i, x in want.items()}
        if name != "mixing":
            assert docs.columns == columns and {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
    assert steps and "[SECRET]" in want[80]
    sizes: dict = {}
    source = {r[0]: r[3] for r in rows}
    for i, x in want.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(x.split())
    target = mixing.targets(sizes)
    got = docs.collect()
    assert {r["doc_id"] for r in got} <= set(want) and all(r["text"] == want[r["doc_id"]] for r in got)
    assert set(columns) <= set(got[0].asDict())
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - target[s]) <= 45
    ran = {(r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert ran == {(r["doc_id"], r["taken"]) for r in got}


def test_pipeline_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontamination", "secrets", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None and secrets.RULES
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
