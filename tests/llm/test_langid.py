import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import langid as L


def brute_model(texts):
    """Kneser-Ney with dictionaries; a function from (history, symbol) to probability."""
    grams = Counter()
    for t in texts:
        s = [0] * (L.ORDER - 1) + t
        for i in range(L.ORDER - 1, len(s)):
            grams[tuple(s[i - L.ORDER + 1 : i + 1])] += 1
    levels = {L.ORDER: grams}
    for n in range(L.ORDER - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    floor = 1 / (len(levels[1]) + 1)
    facts = {}
    for n, c in levels.items():
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        total, followers = defaultdict(int), defaultdict(int)
        for g, v in c.items():
            total[g[:-1]] += v
            followers[g[:-1]] += 1
        facts[n] = (one / (one + 2 * two) if one else 0.5, total, followers)

    def p(history, symbol, n=L.ORDER):
        if not n:
            return floor
        h = tuple(history[len(history) - n + 1 :]) if n > 1 else ()
        d, total, followers = facts[n]
        low = p(history, symbol, n - 1)
        if h not in total:
            return low
        return max(levels[n][h + (symbol,)] - d, 0) / total[h] + d * followers[h] / total[h] * low

    return p


def syms(text):
    out = []
    for c in text:
        s = ord(c.lower()) if c.isalpha() else 0
        if s or not out or out[-1]:
            out.append(s)
    return out


def test_model_matches_brute_force():
    r = random.Random(1)
    train = {"x": ["".join(r.choices("abc d", k=40)) for _ in range(9)], "y": ["".join(r.choices("bcdé E1", k=40)) for _ in range(9)]}
    parts = [L.kneser_ney(*L.symbols(*L.batch_bytes(pa.array(t)))) for t in train.values()]
    model = L.Model(list(train), parts)
    brute = [brute_model([syms(t) for t in ts]) for ts in train.values()]
    texts = ["abc", "zz", "é", "", "  ", "Abc d9e 日本 é", "".join(r.choices("abcdé zq", k=70))]
    got, counts, letters = model.entropies(pa.array(texts))
    for t, row, n, has in zip(texts, got, counts, letters):
        s = [0] * (L.ORDER - 1) + syms(t)
        assert n == len(s) - L.ORDER + 1 and has == any(c.isalpha() for c in t)
        for k, p in enumerate(brute):
            want = -sum(np.log(p(s[:i], s[i])) for i in range(L.ORDER - 1, len(s))) / max(1, n)
            assert row[k] == pytest.approx(want, rel=1e-4, abs=1e-6)
    # Probabilities of all symbols and the unknown one add up to one at most.
    assert sum(brute[0]([0, 97, 98], c) for c in {0, 97, 98, 99, 100}) <= 1.0001


def labelled():
    r = random.Random(3)
    make = {"aa": ["the", "house", "with", "thing"], "bb": ["der", "über", "schule", "nicht"], "cc": ["où", "être", "maison", "quelle"]}
    return [(i, " ".join(r.choices(make[k], k=r.randrange(5, 60))), k, "x") for i in range(300) for k in [r.choice(list(make))]]


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(900, None, "aa", "x"), (901, "12 34", "bb", "x"), (902, "", None, "x"), (None, "the house", None, "x"), (903, "the thing " * 4000, None, "x"), (904, "qxzj wvkq " * 40, None, "x"), (5, "the house", "aa", "x"), (5, "the house", "aa", "x")]
    df = spark.createDataFrame(labelled() + odd, "doc_id long, text string, lang string, lang_pred string")
    model = L.fit(df)
    got = L.predict(df, model).join(df.select("doc_id", "lang").distinct(), L.F.col("id") == df.doc_id, "left").collect()
    held = [r for r in got if r.id is not None and r.id < 300 and r.lang and r.id != 5]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held) and all(0 <= r.score <= 1 for r in got)
    by = {r.id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (900, 901, 902))
    assert by[None].lang_pred == "aa" and by[903].lang_pred == "aa" and not by[903].rejected and by[904].rejected
    assert not any(r.rejected for r in held)
    kept = L.predict(df, model, keep=df.columns)
    assert kept.columns == df.columns and kept.count() == df.count() - 4


def test_rejection_follows_left_out_texts():
    """Brute force of the rule, texts of two languages and other letters, and long and short clean ones."""
    r = random.Random(5)
    words = {"aa": ["the", "house", "with", "thing", "over", "water"], "bb": ["der", "schule", "nicht", "auf", "haus", "zwei"]}
    prose = lambda k, n: " ".join(r.choices(words[k], k=n))
    train = {k: [prose(k, 60) for _ in range(40)] for k in words}
    model = L.Model(list(train), [L.kneser_ney(*L.symbols(*L.batch_bytes(pa.array(t)))) for t in train.values()])
    left = [(k, prose(k, r.randrange(1, 200))) for k in words for _ in range(100)]
    e, n, _, v = model.entropies(pa.array([t for _, t in left]), True)
    model.calibrate(e, np.array([["aa", "bb"].index(k) for k, _ in left]), n, v)
    logs = model.log_probabilities(*(lambda s: (s[0], L.own_positions(s[1])[0]))(L.symbols(*L.batch_bytes(pa.array([left[0][1]])))))
    assert v[0] == pytest.approx(logs.astype(float).var(0), rel=1e-4) and e[0] == pytest.approx(-logs.mean(0), rel=1e-5)
    clean = [prose(k, m) for k in words for m in (1, 2, 5, 30, 300, 3000) for _ in range(20)]
    odd = ["".join(r.choices("qxzjkvy ", k=m)) for m in (60, 400, 4000)] + ["éà ôù " * 50, "THE" + "%x$q# " * 90]
    e, n, letters = model.entropies(pa.array(clean + odd))
    best, score, rejected = model.decide(e, n, letters)
    want = [low > model.mean[b] + L.REJECT_SIGMAS * (model.texts[b] ** 2 + model.symbols[b] ** 2 / m) ** 0.5 for low, b, m in zip(e.min(1), e.argmin(1), n)]
    assert rejected.tolist() == want and not any(want[: len(clean)]) and all(want[len(clean) :])
    assert score == pytest.approx([1 / sum(np.exp((row.min() - x) * m) for x in row) for row, m in zip(e, n)])


def test_equal_entropies_go_to_the_first(spark):
    rows = [(i, "same words here", k) for i in range(1, 60) for k in ("bb", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x.lang_pred for x in L.predict(df, L.fit(df)).collect()} == {"aa"}


def test_sample_is_bounded_and_fair(spark):
    """The least hashes of the ids of each language, a fifth of them left out, against a plain count."""
    rows = labelled()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, x string")
    model = L.fit(df, sample_rows=20)
    hashed = {x.doc_id: x.h for x in df.select("doc_id", L.F.xxhash64(L.F.col("doc_id").cast("string")).alias("h")).collect()}
    held = {x.doc_id for x in df.filter(L.held_out("doc_id")).collect()}
    for k, lang in enumerate(model.langs):
        chosen = sorted((i for i, _, g, _ in rows if g == lang and i not in held), key=lambda i: (hashed[i], i))[:20]
        texts = [t for place, i in enumerate(chosen, 1) for j, t, _, _ in rows if j == i and place % L.CALIBRATE_EVERY != 1]
        brute = L.kneser_ney(*L.symbols(*L.batch_bytes(pa.array(texts))))
        assert np.exp(model.floor[k]) == pytest.approx(brute["floor"], rel=1e-5) and len(chosen) == 20


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predict(df, L.fit(df)).collect()] == [("und", 0.0)]
    assert L.predict(df.limit(0), L.fit(df.limit(0))).count() == 0
