import hashlib
import random
import re

import pytest

from tideline.llm import exact_dedup as E


def rows():
    r = random.Random(2)
    texts = ["a b", "ab", "a\tb\n", "a b", "", " \r\n\x0b\x0c", "x" * 50_000, "x " * 50_000, "a b", "日 本", "日本"] + ["".join(r.choices("pq ", k=5)) for _ in range(80)]
    out = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(200, None, "c", 1), (None, "ab", "c", 1), (None, None, "c", 1), (1, "ab", "c", 1), (1, "ab", "c", 1)]
    r.shuffle(out)
    return out


def brute(data):
    by = {}
    for i, t, *_ in data:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return {k: (min(v), len(v)) for k, v in by.items()}


@pytest.mark.parametrize("capacity", [1 << 16, 3])
def test_groups_match_brute_force(spark, capacity):
    data = rows()
    want = brute(data)
    df = spark.createDataFrame(data, "doc_id long, text string, h string, length long")
    got = E.exact_groups(df, capacity=capacity).collect()
    assert len(got) == len(data)
    shas = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    kept = {}
    for r in got:
        (_, none, i), n = shas[r.text_sha256]
        assert r.group_size == n and r.keep_id == (None if none else i)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(want)
    left = E.drop_copies(df)
    assert left.columns == df.columns and left.count() == len(want)


def test_directory_doubles_and_shares_buckets(spark):
    # 40 hashes in the first quarter, 3 each in the others: only the first needs more bits than two.
    hashes = [(q << 62) + (i << 40) for q, n in ((0, 40), (1, 3), (2, 3), (3, 3)) for i in range(n)]
    signed = [(h - (1 << 64) if h >> 63 else h,) for h in hashes]
    rows, depth = E.grow_directory(spark.createDataFrame(signed, "h long"), 10)
    assert depth > 16  # the first quarter's keys differ from bit 17 on
    found = {r.slot: (r.bucket, r.local_depth) for r in rows.collect()}
    slots = {h >> (64 - depth) for h in hashes}
    assert set(found) == slots
    upper = [found[s] for s in slots if s >> (depth - 1)]
    assert set(upper) == {(1 << (depth - 1), 1)}  # two slots share a bucket one bit deep
    for s, (bucket, local) in found.items():
        assert s >> (depth - local) << (depth - local) == bucket
        assert sum(h >> (64 - local) == bucket >> (depth - local) for h in hashes) <= 10


def test_index_buckets_hold_their_capacity(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(i, "one text") for i in range(400)], "doc_id long, text string")
    index = E.ExtendibleIndex.build(df, capacity=50)
    sizes = [r["count"] for r in index.entries.groupBy("bucket").count().collect()]
    assert sum(sizes) == 401 and max(sizes) <= 50 and len(sizes) > 8
    assert {r.n for r in index.entries.collect()} == {1, 400}


def test_rows_come_out_of_the_index(spark):
    """What the entries say is what is returned."""
    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    build = E.ExtendibleIndex.build

    class Spoilt:
        @staticmethod
        def build(*args, **kw):
            index = build(*args, **kw)
            index.entries = index.entries.withColumn("n", E.F.col("n") + 100)
            return index

    real, E.ExtendibleIndex = E.ExtendibleIndex, Spoilt
    try:
        assert sorted(r.group_size for r in E.exact_groups(df).collect()) == [101, 102, 102]
    finally:
        E.ExtendibleIndex = real


def test_clashing_names_and_string_ids(spark):
    names = ["doc_id", "text", "__k", "__id", "__h", "__n", "__len", "__first", "bucket", "slot", "rank", "kept"]
    df = spark.createDataFrame([("b", "x y", 7, *"ABCDEFGHI"), ("a", "xy ", 8, *"ABCDEFGHI"), (None, "xy ", 9, *"ABCDEFGHI"), ("c", None, 10, *"ABCDEFGHI")], ", ".join(f"{n} {'int' if n == '__k' else 'string'}" for n in names))
    left = E.drop_copies(df)
    assert left.columns == names and sorted(tuple(r)[:3] for r in left.collect()) == [("a", "xy ", 8), ("c", None, 10)]
    assert all(tuple(r)[3:] == tuple("ABCDEFGHI") for r in left.collect())
    assert {(r.id, r.keep_id, r.kept) for r in E.exact_groups(df).collect()} == {("b", "a", False), ("a", "a", True), (None, "a", False), ("c", "c", True)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert E.exact_groups(df).count() == 0 and E.drop_copies(df).count() == 0
