import random

import pytest

from tideline.operators import manifest, order
from tideline.plans.engine import Engine, InvalidArgument, NotFound, Options
from tideline.streaming import changelog


def test_model(spark, tmp_path):
    """Random writes, flushes and a compaction against a dict at several snapshots."""
    r = random.Random(11)
    path = f"{tmp_path}/db"
    with pytest.raises(InvalidArgument):
        Engine.open(spark, path)
    db = Engine.open(spark, path, Options(create_if_missing=True, auto_compact=False))
    states, model, seq = {0: {}}, {}, 0
    for step in range(4):
        ops = [(r.randrange(4) and 1, b"k%02d" % r.randrange(25), b"v%d" % r.randrange(999)) for _ in range(30)]
        last = db.batch(ops)
        for op, k, v in ops:
            seq += 1
            model[k] = v if op else None
            states[seq] = dict(model)
        assert last == seq
        if step in (0, 2):
            db.flush()
    live = lambda s: {k: v for k, v in s.items() if v is not None}
    scan = lambda s: {bytes(x.k): bytes(x.v) for x in db.scan(snapshot=s).collect()}
    for s in (0, 17, 60, seq):
        assert scan(s) == live(states[s])
    db.flush()
    db.compact(oldest_snapshot=60)
    assert db.drop_obsolete() and db.files().count() == 1
    for s in (60, 75, seq):
        assert scan(s) == live(states[s])
    again = Engine.open(spark, path)
    assert again.last_sequence() == seq
    for k in (b"k00", b"k07", b"k24"):
        if k in model:
            assert again.get(k) == model[k]
    with pytest.raises(NotFound):
        again.get(b"absent")
    keys = sorted(live(model))
    assert bytes(again.seek(b"k05").first().k) == next(k for k in keys if k >= b"k05")
    assert bytes(again.seek_before(b"k05").first().k) == [k for k in keys if k < b"k05"][-1]
    assert again.put(b"new", b"1") == seq + 1 and again.get(b"new") == b"1" and again.delete(b"new") == seq + 2 and again.get(b"new") is None
    assert '"ordering": "bytewise"' in again.describe() and again.scores().count() == 6
    with pytest.raises(InvalidArgument):
        Engine.open(spark, path, Options(error_if_exists=True))


def test_flushes_and_compacts_by_itself(spark, tmp_path):
    """A small write buffer: writes flush, runs go to the level that the files allow, levels are compacted by score,
    deletes go at the bottom, and every live value stays."""
    r = random.Random(5)
    db = Engine.open(spark, f"{tmp_path}/db", Options(create_if_missing=True, write_buffer=600))
    model = {}
    for _ in range(7):
        ops = [(r.randrange(5) and 1, b"\xc3k\xff%02d" % r.randrange(40), b"v%d" % r.randrange(99)) for _ in range(45)]
        db.batch(ops)
        model |= {k: v if op else None for op, k, v in ops}
    files = db.live()
    assert not db._live_logs() and any(e["level"] > 0 for e in files) and sum(e["level"] == 0 for e in files) < 4
    for level in {e["level"] for e in files} - {0}:
        spans = sorted((bytes(e["smallest"]), bytes(e["largest"])) for e in files if e["level"] == level)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    live = {k: v for k, v in model.items() if v is not None}
    assert {bytes(x.k): bytes(x.v) for x in db.scan().collect()} == live
    db.compact()
    assert {bytes(x.k) for x in db.log().collect()} == set(live)  # deletes are gone from the only run
    low = Engine.open(spark, f"{tmp_path}/other", Options(create_if_missing=True))
    low.put(b"b", b"1")
    low.flush()
    low.put(b"b", b"2")
    low.flush()
    assert sorted(e["level"] for e in low.live()) == [1, 2] and low.get(b"b") == b"2"


def test_walks_both_ways(spark, tmp_path):
    db = Engine.open(spark, f"{tmp_path}/db", Options(create_if_missing=True))
    keys = sorted([b"", b"\0", b"a", b"a\0", b"a\xff", b"\xc3\xa9", b"\xff", b"\xff\xff"])
    db.batch([(1, k, b"v") for k in keys] + [(1, b"gone", b"v"), (0, b"gone", None)])
    one = lambda df: [bytes(x.k) for x in df.collect()]
    assert one(db.first()) == keys[:1] and one(db.last()) == keys[-1:]
    assert [bytes(x.k) for x in db.reverse().orderBy("pos").collect()] == keys[::-1]
    for i, k in enumerate(keys[:4]):
        assert one(db.next(k)) == keys[i + 1 : i + 2] and one(db.prev(k)) == (keys[i - 1 : i] if i else [])
    assert one(db.next(keys[-1])) == [] and one(db.seek(b"gone")) == [b"\xc3\xa9"]
    got = {bytes(x.k): (x.prev and bytes(x.prev), x.next and bytes(x.next)) for x in db.neighbours().collect()}
    assert [got[k][1] for k in keys[:-1]] == keys[1:] and got[keys[-1]][1] is None
    targets = [b"\0\0", b"b", b"\xff\xff\xff"]
    t = spark.createDataFrame([(bytearray(x),) for x in targets], "t binary")
    assert {bytes(x.t): x.found and bytes(x.found) for x in db.seek_many(t).collect()} == {b"\0\0": b"a", b"b": b"\xc3\xa9", b"\xff\xff\xff": None}
    assert {bytes(x.t): bytes(x.found) for x in db.seek_many(t, before=True).collect()} == {b"\0\0": b"\0", b"b": b"a\xff", b"\xff\xff\xff": b"\xff\xff"}


def test_missing_table_is_refused(spark, tmp_path):
    import shutil

    db = Engine.open(spark, f"{tmp_path}/db", Options(create_if_missing=True))
    db.put(b"a", b"b")
    db.flush()
    number = db.files().first().number
    shutil.rmtree(tmp_path / "db" / "tables" / str(number))
    with pytest.raises(InvalidArgument, match="missing"):
        Engine.open(spark, f"{tmp_path}/db")


def test_overlap_edges(spark):
    files = spark.createDataFrame([(0, 1, 5, 0, 10), (0, 2, 5, 10, 20), (0, 3, 5, 22, 30), (0, 4, 5, 28, 40)], "level int, number long, file_size long, smallest long, largest long")
    closed = lambda lo, hi: sorted(r.number for r in manifest.overlap_closure(files, lo, hi).collect())
    assert closed(5, 5) == [1, 2] and closed(21, 21) == [] and closed(30, None) == [3, 4] and closed(None, None) == [1, 2, 3, 4]
    ranges = spark.createDataFrame([(1, 10, 10), (2, 21, 21), (3, None, 0), (4, None, None), (5, 99, 100)], "range_id int, lo long, hi long")
    got = sorted((r.range_id, r.number) for r in manifest.overlaps(files, ranges, bins=3).collect())
    assert got == [(1, 1), (1, 2), (3, 1), (4, 1), (4, 2), (4, 3), (4, 4)]
    levels = {r.range_id: r.level for r in manifest.output_level(files.filter("number = 1"), ranges).collect()}
    assert levels == {1: 0, 2: 2, 3: 0, 4: 0, 5: 2}


def test_replay_edges(spark):
    events = spark.createDataFrame([(1, 0, 7, 1), (2, 0, 7, 0), (2, 0, 7, 1), (3, 1, 8, 1), (4, 1, 8, 0)], "edit_no long, level int, number long, kind int")
    assert [(r.level, r.number) for r in manifest.replay(events).collect()] == [(0, 7)]
    empty = manifest.level_scores(spark.createDataFrame([], "level int, file_size long"))
    assert [r.score for r in empty.orderBy("level").collect()] == [0.0] * 6
    assert manifest.pick_compaction(spark.createDataFrame([], "level int, file_size long")).first().level == 0


def test_seek_and_positions_random(spark):
    r = random.Random(3)
    keys = sorted({r.randrange(500) for _ in range(120)})
    k = spark.createDataFrame([(x,) for x in keys], "k long")
    t = spark.createDataFrame([(x,) for x in range(-3, 505, 4)], "t long")
    at = {x.t: x.found for x in order.seek(k, "k", t, "t").collect()}
    before = {x.t: x.found for x in order.seek(k, "k", t, "t", before=True).collect()}
    assert all(at[x] == next((y for y in keys if y >= x), None) for x in at)
    assert all(before[x] == next((y for y in reversed(keys) if y < x), None) for x in before)
    assert [(x.prev, x.next) for x in order.neighbours(k, "k").orderBy("k").collect()] == list(zip([None, *keys], [*keys[1:], None]))


def test_positions_of_any_type_and_hot_keys(spark):
    """Binary and string keys, nulls, empty ones, and a key of most rows, against Python's sort."""
    r = random.Random(4)
    rows = [(bytes(r.randrange(256) for _ in range(r.randrange(4))), "".join(r.choices("aéz日", k=r.randrange(3))), i) for i in range(400)] + [(b"hot", "hot", 1000 + i) for i in range(600)] + [(None, None, 2000)]
    df = spark.createDataFrame([(k if k is None else bytearray(k), s, i) for k, s, i in rows], "b binary, s string, i long").repartition(7)

    def check(order_by, key):
        want = {x[2]: n for n, x in enumerate(sorted(rows, key=key), 1)}
        assert {x.i: x.pos for x in order.positions(df, *order_by).collect()} == want

    check(("b", "-i"), lambda x: (x[0] is not None, x[0] or b"", -x[2]))
    check(("-s", "i"), lambda x: (x[1] is None, [-ord(c) for c in x[1] or ""] + [1], x[2]))
    ranges = order.Ranges(df, "b", "-i", count=8)
    held = [x["count"] for x in df.withColumn("_range", ranges.column()).groupBy("_range").count().collect()]
    assert len(held) == len(ranges.bounds) + 1 and max(held) < 300  # the hot key is cut by what follows it


def test_stream(spark, tmp_path):
    log = tmp_path / "log"
    rows = [(1, 5, 1, "new"), (1, 3, 1, "old"), (2, 4, 0, None)]
    spark.createDataFrame(rows, "k long, seq long, op int, v string").write.parquet(str(log))
    stream = changelog.newest_stream(changelog.stream_log(spark, str(log), "k long, seq long, op int, v string"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("newest").start()
    query.processAllAvailable()
    spark.createDataFrame([(2, 2, 1, "late")], "k long, seq long, op int, v string").write.mode("append").parquet(str(log))
    query.processAllAvailable()
    query.stop()
    assert sorted((r.k, r.op, r.v) for r in spark.table("newest").collect()) == [(1, 1, "new"), (2, 0, None)]
    got = []
    changelog.apply_stream(changelog.stream_log(spark, str(log), "k long, seq long, op int, v string"), lambda b: got.append(b.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(got) == 4


def test_overlap_sums_make_no_pairs(spark, monkeypatch):
    """Files and bytes by range and level, against plain lists: shared keys, open, inverted and repeated ranges, no level."""
    r = random.Random(8)
    files = [(r.choice([0, 1, 2, 3, None]), n, r.choice([5, 1000, None]), low, low + r.randrange(30)) for n, low in enumerate(r.randrange(60) for _ in range(150))]
    spans = [(n % 70, *[None if r.random() < 0.1 else r.randrange(-5, 100) for _ in range(2)]) for n in range(90)]
    f = spark.createDataFrame(files, "level int, number long, file_size long, smallest long, largest long")
    s = spark.createDataFrame(spans, "range_id int, lo long, hi long")

    def want(files):
        out = {}
        for i, lo, hi in spans:
            for level, _, size, low, high in files:
                if (lo is None or hi is None or lo <= hi) and (lo is None or high is not None and lo <= high) and (hi is None or low is not None and low <= hi):
                    n, b = out.get((i, level), (0, 0))
                    out[i, level] = n + 1, b + (size or 0)
        return out

    got = lambda f, **k: {(x.range_id, x.level): (x.files, x.bytes) for x in manifest.overlap_sums(f, s, **k).collect()}
    odd = [(1, 900, 7, 50, 40), (None, 901, 7, None, 10), (2, 902, 7, 10, None), (3, 903, 7, None, None)]
    assert got(f.unionByName(spark.createDataFrame(odd, f.schema))) == want(files + odd)
    monkeypatch.setattr(manifest, "overlaps", None)  # pairs are made of files without keys in order alone
    assert got(f) == got(f, bins=7) == want(files)
    assert got(f.limit(0)) == {}
    assert manifest.output_level(f, s).count() == len(spans)
