import random
import re

import numpy as np

from tideline.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def corpus():
    r = random.Random(8)
    common = ["the", "of", "and", "to", "in"]
    fresh = lambda n: [r.choice(common) if r.random() < 0.4 else "".join(r.choices("abcdeéfghij", k=6)) for _ in range(n)]
    items = [(i, " ".join(fresh(r.randrange(16, 60))) + ".") for i in range(40)] + [(40, None), (41, ""), (42, "the of and to in the of")]
    docs, planted = [], set()
    for d in range(300):
        text = fresh(r.randrange(20, 400))
        kind = d % 6
        if kind < 3:
            item = r.randrange(40)
            body = items[item][1].split()
            if kind == 1:  # shouted
                body = [w.upper() + "!!" for w in body]
            if kind == 2:  # every fifth word replaced, the answer left
                body = [w if i % 5 or i >= len(body) - 6 else "changed" for i, w in enumerate(body)]
            at = r.randrange(len(text))
            text[at:at] = body
            planted.add((d, item))
        docs.append((d, " ".join(text)))
    return items, docs + [(900, None), (901, ""), (None, items[3][1]), (902, items[3][1]), (902, items[3][1]), (903, "x" * 9000)], planted | {(None, 3), (902, 3)}


def test_finds_planted_items_and_nothing_else(spark):
    items, docs, planted = corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame(items + items[:2], "item_id int, text string")
    for block_items in (256, 15):
        got = D.contaminated(d, b, block_items=block_items).collect()
        assert {(r.id, r["item"]) for r in got} - {(x, 42) for x in range(1000)} == planted
        assert len([r for r in got if r.id == 902]) == 2
        assert {r.kind for r in got} == {"verbatim", "paraphrase"}


def test_retrieval_recall_against_brute_force(spark):
    items, docs, planted = corpus()
    texts = {i: words(t) for i, t in docs if i is not None}
    brute = {(d, i) for d, w in texts.items() for i, t in items[:40] if lcs(words(t), w) >= D.VERBATIM * len(words(t))}
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:40], "item_id int, text string")).collect()
    found = {(r.id, r["item"]) for r in got}
    assert len(brute) > 90 and len(brute & found) >= 0.9 * len(brute)


def test_common_length():
    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = r.integers(0, 6, r.integers(1, 80)).astype(np.uint64), r.integers(0, 6, r.integers(0, 150)).astype(np.uint64)
        assert D.common_length(a, b) == lcs(a.tolist(), b.tolist())


def test_rows_are_judged_one_by_one(spark):
    """Rows that share an id, or the lack of one, with a leak stay; every column comes through."""
    items, docs, planted = corpus()
    leaks = {d for d, _ in planted}
    rows = [(None if i is not None and i % 7 == 0 else i and i % 10, t, i in leaks, "x", "y") for i, t in docs if i != 902]
    df = spark.createDataFrame(rows, "doc_id long, text string, leak boolean, lowered string, item string")
    for block_items in (256, 5):
        left = D.clean(df, spark.createDataFrame(items[:42], "item_id int, text string"), block_items=block_items)
        assert left.columns == df.columns
        key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
        assert sorted((tuple(r) for r in left.collect()), key=key) == sorted((r for r in rows if not r[2]), key=key)


def test_equal_items_all_match(spark):
    items, docs, _ = corpus()
    both = [(1, items[5][1]), (2, items[5][1]), *items[10:30]]
    got = D.contaminated(spark.createDataFrame([(7, "x y " + items[5][1]), *docs[-40:]], "doc_id long, text string"), spark.createDataFrame(both, "item_id int, text string")).collect()
    assert {r["item"] for r in got if r.id == 7} == {1, 2}


def test_empty_tables(spark):
    items, docs, _ = corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert D.contaminated(d.limit(0), b).count() == 0
    assert D.contaminated(d, b.limit(0)).count() == 0


def test_long_items_lose_no_copy(spark):
    """A full block of items of several hundred words, each copied whole, against brute force."""
    r = random.Random(11)
    known = ["".join(r.choices("abcdefghij", k=5)) for _ in range(6000)]
    prose = lambda n: [known[int(len(known) * r.random() ** 2)] for _ in range(n)]
    items = [(i, " ".join(prose(480))) for i in range(120)] + [(120, " ".join(prose(D.RANK * D.PASSAGE + 100)))]
    docs = [(i, " ".join(prose(150) + t.split() + prose(150))) for i, t in items] + [(1000 + d, " ".join(prose(300))) for d in range(120)]
    brute = {(d, i) for d, w in docs for i, t in items if t in w}
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert len(brute) == 121 and {(x.id, x["item"]) for x in found} == brute


def test_single_passages_of_long_items(spark):
    r = random.Random(12)
    prose = lambda n: ["".join(r.choices("abcdefghij", k=5)) for _ in range(n)]
    long = [prose(480) for _ in range(5)]
    items = [(i, " ".join(w)) for i, w in enumerate(long)] + [(9, " ".join(prose(40)))]
    docs = [(i, " ".join(prose(150) + w[96 * i : 96 * i + 96] + prose(150))) for i, w in enumerate(long)]
    docs += [(10, " ".join(prose(100) + long[0] + prose(100))), (11, " ".join(prose(90) + long[1][60:80] + prose(90))), (12, " ".join(prose(90) + items[5][1].split()[:20] + prose(90)))]
    docs += [(100 + d, " ".join(prose(60))) for d in range(40)]  # words of a tenth of the documents weigh nothing
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(x.id, x["item"], x.kind) for x in got} == {(i, i, "passage") for i in range(5)} | {(10, 0, "verbatim")}
    assert all(0.15 < x.share < 0.6 for x in got if x.kind == "passage")
