import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import substrings


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    places = {}
    for n, ((i, t), w) in enumerate(zip(rows, words)):
        for s in range(len(w) - 19):
            places.setdefault(tuple(w[s : s + 20]), []).append((i is None, i or 0, s, t, n))
    gone = [set() for _ in rows]
    for found in places.values():
        # Rows equal in id and text share their places; texts of one id are ordered by a hash the test needn't know.
        least = min(f[:3] for f in found)
        for f in found:
            if f[:3] != least:
                gone[f[4]].update(range(f[2], f[2] + 20))
    return [(i, len(w), len(g), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in g).encode()).hexdigest()) for (i, _), w, g in zip(rows, words, gone)]


def rows(seed):
    r = random.Random(seed)
    letters = ["a", "A", "ü", "b", "c d"]
    passage = " ".join(f"w{r.randrange(99)}" for _ in range(60))
    out = [(None, passage), (3, None), (4, ""), (5, " \t\n "), (6, passage), (6, passage), (7, "x " + passage + "\nend"), (8, "loop " * 300), (9, "one two"), (10, " ".join(["deep"] * 20)), (2, "z" * 9000 + " " + passage[50:])]
    for i in range(11, 50):
        parts = [" ".join(r.choices(letters, k=r.randrange(40))), passage[r.randrange(100) :], " ".join(f"u{r.randrange(4)}" for _ in range(r.randrange(80)))]
        r.shuffle(parts)
        out.append((i, "\t".join(parts)))
    return out


@pytest.mark.parametrize("seed,group,sampled,piece", [(1, 1 << 20, 64, 1 << 20), (2, 8, 8, 600), (3, 64, 64, 3000)])
def test_same_as_brute_force(spark, seed, group, sampled, piece):
    data = rows(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, id int, words string").repartition(5)
    got = substrings.cut_repeats(df, piece_bytes=piece, group=group, sampled=sampled).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(brute(data), key=key)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_one_run_of_words_in_every_text(spark):
    """Five words in all texts, each time among others: their prefix is crowded and has to grow, and nothing is removed but real repeats."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    data = [(i, " ".join([*(word() for _ in range(25)), "one run of five words", *(word() for _ in range(25))])) for i in range(300)]
    data += [(1000 + i, data[i][1] + " tail") for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {(x.id, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.cut_repeats(df, piece_bytes=4000, group=16, sampled=16).collect()}
    assert got == set(brute(data)) and sum(x[2] for x in got) == 20 * 55


def test_prefixes_grow_until_a_group_fits():
    texts = [f"the same start {i} {i} " + " ".join(f"u{i}x{k}" for k in range(30)) for i in range(50)]
    piece = substrings.Piece(np.arange(50), np.arange(50), pa.array(texts).cast(pa.binary()))
    live = np.ones(len(piece.left), bool)
    (a, _), (b, _), _ = [(v[c >= 40], c) for v, c in piece.sample(1)]
    assert len(a) == 2 and len(b) == 0  # "the same" and "same start" are crowded, no four words are
    buckets = lambda heavy: sorted(len(substrings.unpack(x["starts"], np.uint32)) for x in piece.groups(0, live, heavy, 1 << 30))
    none = np.zeros(0, np.uint64)
    assert buckets([none, none, none])[-1] == 50 and buckets([a, none, none])[-1] == 1


def test_nodes_are_those_of_equal_paths():
    r = np.random.default_rng(3)
    paths = r.integers(0, 2, (substrings.DEPTH, 400))
    paths[4:] = 7
    leaves, node = substrings.deep_nodes(lambda x, d: paths[d][x], 400)
    by = {}
    for i in range(400):
        by.setdefault(tuple(paths[:, i]), set()).add(i)
    found = {}
    for leaf, n in zip(leaves.tolist(), node.tolist()):
        found.setdefault(n, set()).add(leaf)
    assert sorted(map(sorted, found.values())) == sorted(sorted(x) for x in by.values() if len(x) > 1)


def test_paths_that_differ_in_any_word_have_other_edges():
    words = [f"w{i}" for i in range(20)]
    texts = [" ".join(words)] + [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(20)] + [" ".join(words)]
    piece = substrings.Piece(np.arange(22), np.arange(22), pa.array(texts).cast(pa.binary()))
    edges = np.stack(piece.edges(np.arange(22)))
    assert len({tuple(e) for e in edges.T}) == 21 and (edges[-1, 1:21] != edges[-1, 0]).all()  # by the second hash alone, too


def test_other_ids_raise(spark):
    with pytest.raises(TypeError):
        substrings.cut_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_empty_table(spark):
    assert substrings.cut_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
