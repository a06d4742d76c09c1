import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import lm


def brute(rows, order=3):
    def tokens(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + ["</s>"]

    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    c = Counter()
    texts = 0
    for i, t in rows:
        if held(i):
            continue
        texts += 1
        seq = ["<s>", *tokens(t)]
        for k in range(1, order + 1):
            for e in range(1, len(seq)):
                if e - k + 1 >= 0:
                    c[tuple(seq[e - k + 1 : e + 1])] += 1
    n = sum(v for k, v in c.items() if len(k) == 1)
    v = sum(1 for k in c if len(k) == 1)
    kept = {k: x for k, x in c.items() if len(k) > 1 and x >= lm.CUT}
    after = Counter()
    for k, x in kept.items():
        after[k[:-1]] += x
    out = []
    for i, t in rows:
        seq = ["<s>", *tokens(t)]
        base = score = known = 0
        for e in range(1, len(seq)):
            known += c[(seq[e],)] > 0
            p = (c[(seq[e],)] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                gram = tuple(seq[max(0, e - k + 1) : e + 1])
                if len(gram) == k:
                    p = (kept.get(gram, 0) + lm.STRENGTH[k] * p) / (after[gram[:-1]] + lm.STRENGTH[k])
            score += math.log10(p)
        out.append((i, held(i), len(seq) - 1, known, n, base, score))
    return out


def rows():
    r = random.Random(1)
    words = ["a", "B", "été", "d d", "E"]
    out = [(None, "a b"), (1, None), (2, ""), (3, " \n\t "), (4, "zz"), (4, "zz"), (5, "A" * 5000), (6, " ".join(r.choices(words, k=4000)))]
    return out + [(i, " ".join(r.choices(words, k=r.randrange(12)))) for i in range(7, 60)]


@pytest.mark.parametrize("order,block", [(3, 1 << 20), (2, 2000), (3, 500)])
def test_scores_match_brute_force(spark, order, block):
    data = rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in data], "doc_id long, text string, block int, held_out string")
    key = lambda x: tuple((v is None, v or 0) for v in x)
    got = sorted((tuple(r) for r in lm.score_texts(df, order=order, block_bytes=block).collect()), key=key)
    want = sorted(brute(data, order), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def automaton(texts):
    """The automaton of a block whose texts are all training ones, with plain counts; and the block."""
    block = lm.Block(pa.array(texts).cast(pa.binary()))
    count = block.training(np.ones(len(texts), bool))
    words = count[1].astype(float)
    histories, arcs = {}, {}
    for k, rows in ((2, block.pairs), (3, np.column_stack([block.pairs[block.triples[:, 0]], block.triples[:, 1]]))):
        kept = count[k] >= lm.CUT
        history, of = np.unique(rows[kept][:, :-1], axis=0, return_inverse=True)
        histories[k] = history, np.bincount(of.ravel(), weights=count[k][kept])
        arcs[k] = rows[kept], count[k][kept]
    distinct = (words > 0).sum()
    return lm.Automaton((words + 0.5) / (words.sum() + 0.5 * (distinct + 1)), histories, arcs), block


def test_probabilities_add_up():
    made, block = automaton([t or "" for _, t in rows()])
    seen = np.unique(block.index[1])
    unknown = 10 ** made.base[block.seq[0]]  # the start is no word: it weighs what an unknown word does
    root = (10 ** made.base[seen]).sum() + unknown
    assert root == pytest.approx(1)
    assert len(made.fail) > 10
    for state in range(len(made.fail)):
        total = (10 ** made.step(np.full(len(seen), state), seen)[0]).sum()
        down, at = 1.0, state
        while at:
            down, at = down * 10 ** made.penalty[at], made.fail[at]
        assert total + down * unknown == pytest.approx(1)


def test_arcs_and_failure_arcs_are_followed():
    made, block = automaton(["a b c", "a b c", "a b d", "x b d", "x b d"])
    number = {w: int(np.flatnonzero(block.words == h)[0]) for w, h in zip("abcdx", lm.word_hashes(np.frombuffer(b"abcdx", np.uint8), np.arange(5), np.arange(1, 6)))}
    a, b, c, d = (number[w] for w in "abcd")
    ab, only_b = made.state(np.array([[a, b], [c, b]]))
    assert ab >= made.after and only_b == made.one[b] and made.fail[ab] == made.one[b] and made.fail[made.one[b]] == 0
    arc = {(int(x) >> 32, int(x) & 0xFFFFFFFF): i for i, x in enumerate(made.arc)}
    gained, state = made.step(np.array([ab, ab]), np.array([c, d]))
    assert gained[0] == made.weight[arc[ab, c]] and (ab, d) not in arc  # "a b d" stands once
    assert gained[1] == made.penalty[ab] + made.weight[arc[only_b, d]] and state[1] == made.state(np.array([[b, d]]))[0]
    # Spoiling an arc or a failure arc changes just the texts that go through it.
    before = made.traverse(block)
    made.weight[arc[ab, c]] -= 1
    assert np.allclose(before - made.traverse(block), [1, 1, 0, 0, 0])
    made.penalty[ab] -= 5
    assert np.allclose(before - made.traverse(block), [1, 1, 5, 0, 0])


def test_stretches_carry_the_state():
    r = random.Random(3)
    texts = [" ".join(r.choices("abcde", k=n)) for n in (0, 1, 2, 3, 7, 300, 2000)]
    made, block = automaton(texts)
    whole = made.traverse(block, stretch=1 << 30)
    for stretch in (1, 2, 3, 64):
        assert np.allclose(made.traverse(block, stretch=stretch), whole)
    count = block.training(np.ones(len(texts), bool))
    assert np.allclose(made.traverse(block, {k: np.flatnonzero(count[k] >= lm.CUT) for k in (2, 3)}), whole)  # arcs by number


def test_a_text_that_stands_twice_scores_apart(spark):
    r = random.Random(9)
    known = ["".join(r.choices("abcdefgh", k=4)) for _ in range(3000)]
    data = [(i, " ".join(r.choices(known, k=60))) for i in range(400)]
    data += [(1000 + i, data[i][1]) for i in range(40)]
    got = {x.id: (x.score - x.base_score) / x.n_tokens for x in lm.score_texts(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    twice = [got[i] for i in range(40) if not fold(i) and not fold(1000 + i)]
    assert len(twice) > 15 and min(twice) > max(got[i] for i in range(40, 400))


def test_empty_table(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_numbers_and_orders_without_sorting_all():
    r = np.random.default_rng(9)
    for n in (0, 1, 5000):
        values = r.integers(0, 300, n).astype(np.uint64) << np.uint64(54)
        for got, want in zip(lm._numbered_often(values), lm._numbered(values), strict=True):
            assert got.dtype == want.dtype and np.array_equal(got, want)
        place, whole = r.integers(0, 40, n), r.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1)
        assert np.array_equal(lm._by_place(place, whole), np.lexsort((whole, place)))
        wide = place << 30  # no room for both in 64 bits
        assert np.array_equal(lm._by_place(wide, whole), np.lexsort((whole, wide)))
