import os
import random
import re

import pytest
import sentencepiece

import corpus_pipeline
from tideline.llm import decontaminate, langid, queries, sentencepieces
from tests.llm.test_decontaminate import lcs, words
from tests.llm.test_nearcopies import roots_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_match_brute_force(spark):
    """Every stage against plain Python on the smallest tables; language ID is held to labels, as its model is its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = langid.fit(docs)
    rejected = {r.id for r in langid.predict(docs, model).filter("rejected").collect()}
    assert len(rejected) <= 0.01 * len(rows)
    rows = [r for r in rows if r["doc_id"] not in rejected]

    best = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
    kept = {i for _, i in best.values()}
    rows = [r for r in rows if r["doc_id"] in kept]

    roots, _, _ = roots_of([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r, root in zip(rows, roots) if root == r["doc_id"]]

    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = set()
    for r in rows:
        text = words(r["text"])
        have = set(text)
        if any(sum(w in have for w in t) >= decontaminate.VERBATIM * len(t) and lcs(t, text) == len(t) and " ".join(t) in " ".join(text) for t in items):
            leaks.add(r["doc_id"])

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    before = {r["doc_id"] for r in rows}
    assert leaks and not leaks & set(got) and set(got) <= before
    assert len(before - leaks - set(got)) <= 0.01 * len(before)  # copies with small changes
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL_PATH)
    for r in rows:
        if r["doc_id"] in got:
            row = got[r["doc_id"]]
            assert row.ids == library.encode(r["text"] or "") and row.text == r["text"] and row.n_tokens == len(row.ids)


NAMES = ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens", "__k", "__id", "row", "lowered", "whole"]
SCHEMA = ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in NAMES)


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), *"ABCDEFG")


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [row(1, None), row(None, "the same text"), row(None, "the same text"), row(3, ""), row(4, "x" * 30000, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = f"{tmp_path}/{len(data)}-{name}"
            stage(spark, docs, SF).write.parquet(out)
            docs = spark.read.parquet(out)
            assert docs.columns[: len(NAMES)] == NAMES
            assert all(tuple(r)[5:12] == tuple("ABCDEFG") for r in docs.collect())
    assert docs.count() == 0


def test_stages_drop_rows_and_not_ids(spark):
    """Rows without an id, or with the id of a row that goes, stay if they are clean."""
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    a, b, c, d = (prose(90) for _ in range(4))
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    left = lambda stage, rows: sorted(x.text for x in stage(spark, spark.createDataFrame(rows, SCHEMA), SF).collect())
    near = [row(1, a), row(None, a.upper()), row(None, b), row(9, a + " tail"), row(9, c), row(1, d)]
    assert left(corpus_pipeline.near, near) == sorted([a, b, c, d])
    assert left(corpus_pipeline.near, [row(None, a), row(None, a), row(None, a + " tail")]) in ([a], [a + " tail"])
    leaks = [row(None, f"{prose(20)} {leak} {prose(20)}"), row(None, a), row(5, leak), row(5, b), row(5, b), row(6, c), *(row(100 + i, prose(60)) for i in range(30))]
    found = left(corpus_pipeline.decontaminated, leaks)
    assert len(found) == 34 and found.count(b) == 2 and a in found and c in found
    exact = [row(5, a), row(5, b), row(None, a + " "), row(None, c), row(None, c), row(5, c)]
    assert left(corpus_pipeline.exact, exact) == sorted([a + " ", b, c])


def test_every_operator_has_one_query():
    found = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES)
    assert found == list(range(1, 11)) and [n for n, _ in corpus_pipeline.STAGES][0] == "language_id"
