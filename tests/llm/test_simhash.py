import random
import re

import numpy as np
import xxhash

from tideline.llm import simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(codes, radius=4):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    distinct = sorted(set(codes))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {c: find(c) for c in codes}


def texts():
    r = random.Random(3)
    words = ["Alpha", "béta", "gamma", "DELTA", "eps", "zeta x", "\u0085y"]
    base = " ".join(r.choices(words, k=300))
    out = [None, "", " \t\n\x0b\x0c\r", "one", "One  TWO", base, base.upper(), base + " tail", base.replace("gamma", "gama", 1), "x" * 70_000, base * 60]
    out += [" ".join(r.choices(words, k=r.randrange(1, 30))) for _ in range(60)]
    return out


def test_fingerprints_and_components_match_brute_force(spark):
    rows = [(i if i % 13 else None, t, "clash", 1) for i, t in enumerate(texts())] + [(7, "One  TWO", "clash", 1)] * 2
    for group_rows in (10**6, 3):  # the second splits every group again
        got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string, key int"), group_rows=group_rows).collect()
        assert sorted((r.id is None, r.id or 0, r.fp % 2**64) for r in got) == sorted((i is None, i or 0, brute(t)) for i, t, *_ in rows)
        roots = brute_components([brute(t) for _, t, *_ in rows])
        least = {}
        for i, t, *_ in rows:
            c = roots[brute(t)]
            least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
        assert all(r.component_id == least[roots[r.fp % 2**64]] for r in got)


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_finds_all_links_in_dense_and_sparse_groups():
    r = np.random.default_rng(5)
    seeds = r.integers(0, 2**63, 30, dtype=np.uint64)
    codes = np.unique(np.concatenate([seeds, *(seeds ^ (np.uint64(1) << r.integers(0, 64, 30).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 30).astype(np.uint64)) for _ in range(30))]))
    a, b = simhash.GrayIndex(np.zeros(len(codes), np.int64), codes).forest(4)
    mine = brute_components([0])
    root = {int(c): int(c) for c in codes}
    root |= {int(x): int(y) for x, y in zip(a, b)}
    want = brute_components([int(c) for c in codes])
    groups = lambda f: sorted(sorted(c for c in root if f[c] == k) for k in set(f.values()))
    assert mine and groups(root) == groups(want)


def test_oversized_groups_lose_no_link(spark):
    r = random.Random(9)
    codes = []
    for _ in range(40):
        base = r.getrandbits(64)
        codes += [base] + [base ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 6))) for _ in range(6)]
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in sorted(set(codes))]
    keys = simhash.block_keys(spark.createDataFrame(signed, "fp long"), 4, 0).collect()
    by = {}
    for k in keys:
        by.setdefault(k.key, set()).add(k.fp % 2**64)
    met = {(a, b) for g in by.values() for a in g for b in g if a < b}
    near = {(a, b) for a in set(codes) for b in set(codes) if a < b and (a ^ b).bit_count() <= 4}
    assert near and near <= met
