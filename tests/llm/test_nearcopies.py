import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.test_simhash import brute as fingerprint
from tideline.llm import nearcopies
from tideline.llm.common import settings


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    rows, least = [], 0
    for family in range(60):
        base = [word() for _ in range(r.randrange(60, 400))]
        rows.append((least, " ".join(base)))
        for k in range(1, 4):
            other = list(base)
            for at in r.sample(range(len(other)), max(1, len(other) * k // 100)):
                other[at] = word()
            rows.append((least + k, " ".join(other).upper() if k == 2 else "\n".join(other)))
        least += 4
    return rows + [(1000, None), (1001, " "), (1002, "one two"), (1003, "One  two"), (None, "all by itself, a text without an id"), (1004, "x" * 9000)]


def roots_of(rows):
    """Least id of each row's component: Jaccard of 0.8 or 4 bits of SimHash."""
    sets, prints = [shingles(t) for _, t in rows], [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    jaccard = simhash = 0
    for i in range(len(rows)):
        for j in range(i):
            near, alike = (prints[i] ^ prints[j]).bit_count() <= 4, 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0
            jaccard, simhash = jaccard + alike, simhash + (alike and near)
            if near or alike:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    return [least[find(i)] for i in range(len(rows))], jaccard, simhash


def test_stage_links_what_is_four_fifths_alike(spark):
    rows = corpus()
    want, jaccard, simhash = roots_of(rows)
    assert jaccard > 100 and simhash < jaccard / 2  # most lie beyond 4 bits
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component_id for r in nearcopies.near_components(docs).collect()}
    assert got == {i: c for (i, _), c in zip(rows, want)}
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == {i for (i, _), c in zip(rows, want) if i == c}


def test_links_that_miss_the_least_of_a_key(spark):
    """A chain: each is alike to the next only, so the star on the least node is not enough."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(400)]
    rows = [(k, " ".join(words[k * 20 : k * 20 + 200])) for k in range(10)]
    want, jaccard, _ = roots_of(rows)
    assert jaccard == 9 and set(want) == {0}
    assert {x.component_id for x in nearcopies.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_bit_maps_lose_no_link(spark):
    """Pairs at and below the similarity, sets of one and of thousands of shingles: what is linked always passes."""
    r = random.Random(2)
    for n in (5, 6, 30, 400, 3000):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts = [" ".join(base)]
        for k in (0, 1, 2, n // 100, n // 60, n // 40, n // 8):
            other = list(base)
            for at in r.sample(range(n), min(n, k)):
                other[at] = "changed"
            texts.append(" ".join(other))
        grams, edge = nearcopies.shingle_sets(pa.array(texts).cast(pa.binary()))
        maps = nearcopies.bit_maps(grams, edge)
        sets = [shingles(t) for t in texts]
        rows = [(i, len(sets[0]), len(sets[i]), maps[0].tolist(), maps[i].tolist()) for i in range(len(texts))]
        df = spark.createDataFrame(rows, "i int, n_a long, n_b long, bits_a array<long>, bits_b array<long>")
        passed = {x.i for x in df.filter(nearcopies._may_link(0.8)).collect()}
        linked = {i for i, s in enumerate(sets) if 5 * len(s & sets[0]) >= 4 * len(s | sets[0])}
        assert linked <= passed and (n != 400 or len(passed) < len(texts))


def test_sets_are_exact():
    texts = [None, "", "a b", "a b c d e f", "A b C d e f", "a b a b a b a b a b a b a b"]
    grams, edge = nearcopies.shingle_sets(pa.array(texts).cast(pa.binary()))
    assert np.diff(edge).tolist() == [len(shingles(t)) for t in texts]
    assert grams[edge[3] : edge[4]].tolist() == grams[edge[4] : edge[5]].tolist()


def test_empty_table(spark):
    assert nearcopies.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_that_sizes_and_maps_rule_out_need_no_sets(spark):
    maps = spark.createDataFrame([(1, 10, [0] * 8), (2, 10, [1] + [0] * 7), (3, 5, [0] * 8), (4, 10, [-1] * 8)], "node long, n long, bits array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 4)], "a long, b long")
    assert [tuple(r) for r in nearcopies._allowed(pairs, maps, 0.8).collect()] == [(1, 2)]


def test_only_texts_of_candidates_are_shuffled(spark):
    """Whatever joins Spark chooses: rows that neither are candidates nor go must not be moved."""
    r = random.Random(9)
    rows = [(i, " ".join("".join(r.choices("abcdefghijklmnop", k=8)) for _ in range(120))) for i in range(1500)]
    rows += [(2000 + i, rows[i][1] + " end") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()

    def written():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    def shuffled(do):
        before = written()
        return do(), written() - before

    size = sum(len(t) for _, t in rows)
    source = nearcopies._source(docs, "doc_id", "text", nearcopies.F.lit(0).cast("long"))
    node = {x.id: x.node for x in source.collect()}
    pairs = spark.createDataFrame([(node[i], node[2000 + i]) for i in range(6)] + [(node[0], node[1])], "a long, b long")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        linked, moved = shuffled(lambda: {(x.a, x.b) for x in nearcopies._alike(pairs, source, 0.8).collect()})
        assert linked == {(node[i], node[2000 + i]) for i in range(6)}
        assert moved < size / 10
        kept, all_moved = shuffled(lambda: {x.doc_id for x in nearcopies.drop_near(docs).collect()})
    assert kept == set(range(1500))
    # 32 keys, maps and bits of a row go over shuffles, but no text does a second time.
    assert all_moved < 1.3 * size


def test_filter_passes_all_its_keys_and_few_others(spark):
    keys = spark.range(0, 30000, 3).toDF("k")
    rows = spark.range(60000).toDF("row")
    for words in (nearcopies.FILTER_WORDS, 1, 64):
        limit, nearcopies.FILTER_WORDS = nearcopies.FILTER_WORDS, words
        try:
            passes = nearcopies._Filter(keys)
        finally:
            nearcopies.FILTER_WORDS = limit
        may, not_in = ({x.row for x in passes.join(rows, "row", how).collect()} for how in ("left_semi", "left_anti"))
        assert set(range(0, 30000, 3)) <= may and may | not_in == set(range(60000)) and not may & not_in
        if words == limit:
            assert len(may) < 10600
    assert not nearcopies._Filter(keys.limit(0)).join(rows, "row", "left_semi").count()
