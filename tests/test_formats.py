import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import codec
from tideline.functions.codec import Corruption
from tideline.operators import layout
from tideline.sources import kvlog, recovery, store
from tideline.sources.files import HadoopFiles, MemoryFiles


def some_keys(seed, n, longest=6, letters=bytes(range(256))):
    r = random.Random(seed)
    return [bytes(r.choices(letters, k=r.randrange(longest + 1))) for _ in range(n)]


def test_separators_lie_between_and_are_short():
    """Random keys of few and of all byte values: the separator is at or after start and before limit, and no shorter key
    of its kind would do."""
    for seed, letters in ((1, b"\x00\x01\x02"), (2, b"\xfd\xfe\xff"), (3, bytes(range(256))), (4, "aéﬁ日".encode())):
        keys = some_keys(seed, 400, 6, letters)
        for a, b in zip(keys, keys[1:]):
            start, limit = min(a, b), max(a, b)
            got = codec.separator(start, limit)
            assert got == start if start == limit else start <= got < limit
            assert len(got) <= len(start)
            cut = codec.shared(start, limit)
            raised = [start[:cut] + bytes([start[cut] + 1])] if cut < min(len(start), len(limit)) and start[cut] < 255 and start[cut] + 1 < limit[cut] else [start]
            assert got == raised[0]
            after = codec.successor(start)
            assert after >= start and len(after) <= max(1, len(start)) and (after > start or set(start) <= {255})


def test_column_forms_equal_the_codecs(spark):
    """Prefixes, separators and successors of binary columns, beyond ASCII, with 0xff, empty and null keys."""
    keys = some_keys(7, 300, 5, b"\x00a\xc3\xa9\xfe\xff") + [b"", b"\xff" * 4, "aÿ".encode(), "aﬁ".encode(), "né".encode(), "nèa".encode()]
    rows = list(zip(keys, keys[1:] + keys[:1]))
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in rows] + [(None, bytearray(b"x"))], "a binary, b binary")
    got = df.select("a", "b", layout.common_prefix(F.col("a"), F.col("b")).alias("p"), layout.separator(F.col("a"), F.col("b")).alias("s"), layout.successor(F.col("a")).alias("n")).collect()
    for r in got:
        if r.a is None:
            assert r.p == 0 and r.n is None
            continue
        a, b = bytes(r.a), bytes(r.b)
        assert r.p == codec.shared(a, b) and bytes(r.s) == codec.separator(a, b) and bytes(r.n) == codec.successor(a)


def test_blocks_are_cut_by_bytes(spark):
    """Keys that share part of a character, and deletes without a value."""
    keys = sorted({"nèa".encode(), "nèb".encode(), "né".encode(), b"\xff", b"\xff\xff"})
    df = spark.createDataFrame([("r", bytearray(k), None if i % 2 else bytearray(b"v")) for i, k in enumerate(keys)], "run string, key binary, value binary")
    entries = [(k, b"" if i % 2 else b"v") for i, k in enumerate(keys)]
    (row,) = layout.block_cuts(df, "run", 1 << 20).collect()
    assert row.bytes == len(kvlog.write_block(entries, 16)) and row.entries == len(keys) and bytes(row.last_key) == b"\xff\xff"
    assert len(layout.block_cuts(df, "run", 1).collect()) == len(keys)
    sizes = layout.block_sizes(df, "run", per_block=2).orderBy("block").collect()
    assert [x.bytes for x in sizes] == [len(kvlog.write_block(entries[i : i + 2], 16)) for i in (0, 2, 4)]


def test_varints_and_slices():
    for n in (0, 127, 128, 16383, 16384, 2**28 - 1, 2**28, 2**32 - 1, 2**56 - 1):
        data = codec.put_varint(n)
        assert codec.get_varint(data) == (n, len(data)) and codec.varint_size(n) == len(data)
    assert codec.get_slice(codec.put_slice(b"abc")) == (b"abc", 4)
    for bad in (b"", b"\x80", b"\x80" * 11):
        with pytest.raises(Corruption):
            codec.get_varint(bad)
    with pytest.raises(Corruption):
        codec.get_slice(b"\x05ab")


def test_internal_keys():
    assert codec.parse_internal_key(codec.internal_key(b"k", 7, 1)) == (b"k", 7, 1)
    assert codec.parse_internal_key(codec.internal_key(b"", codec.MAX_SEQUENCE, 0)) == (b"", codec.MAX_SEQUENCE, 0)
    with pytest.raises(Corruption):
        codec.internal_key(b"k", codec.MAX_SEQUENCE + 1, 1)
    with pytest.raises(Corruption):
        codec.parse_internal_key(b"short")


def test_checksums_and_hash():
    """The published check values, and long data against a byte by byte division."""
    assert codec.crc32c(b"123456789") == 0xE3069283 and codec.crc32c(b"") == 0
    assert codec.crc32(b"123456789") == 0xCBF43926
    r = random.Random(3)
    for n in (codec.LONG - 1, codec.LONG, codec.LONG + 1, 4096, 5003, 32761, 70000):
        data = r.randbytes(n)
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (codec.CRC32C_POLYNOMIAL if crc & 1 else 0)
        assert codec.crc32c(data) == crc ^ 0xFFFFFFFF
    assert codec.murmur3(b"", 0) == 0 and codec.murmur3(b"test", 0) == 0xBA6BD213 and codec.murmur3(b"Hello, world!", 0) == 0xC0363E43
    keys = some_keys(5, 500, 19)
    assert codec.murmur3_many(keys).tolist() == [codec.murmur3(k) for k in keys]


def test_bloom():
    keys = some_keys(8, 600, 9)
    bloom = codec.bloom_build(keys)
    asked = keys + [b"absent %d" % i for i in range(2000)]
    one = [codec.bloom_match(bloom, k) for k in asked]
    assert codec.bloom_match_many(bloom, asked).tolist() == one and all(one[: len(keys)]) and sum(one[len(keys) :]) < 100
    assert not codec.bloom_match(b"", b"x") and codec.bloom_match(b"\0\0\x1f", b"x")
    assert codec.bloom_match_many(b"", [b"x"]).tolist() == [False] and codec.bloom_match_many(b"\0\0\x1f", [b"x"]).tolist() == [True]
    assert codec.bloom_probes(3) == 2 and codec.bloom_probes(10) == 6


def test_log_round_trip():
    """Records around the bounds of a log block, empty ones, and many of random lengths."""
    r = random.Random(1)
    room = kvlog.BLOCK - kvlog.HEADER
    around = [[r.randbytes(n)] for k in range(-9, 10) for n in (room + k, 2 * room + k)]
    filled = [[r.randbytes(room - kvlog.HEADER - k), b"next"] for k in range(12)]
    for records in (*around, *filled, [b""], [b"", b"x", b""], [r.randbytes(r.randrange(300)) for _ in range(2000)]):
        data = kvlog.write_log(records)
        assert list(kvlog.read_log(data)) == records
    data = bytearray(kvlog.write_log([b"abc"]))
    data[-1] ^= 1
    with pytest.raises(Corruption):
        list(kvlog.read_log(bytes(data)))
    assert list(kvlog.read_log(kvlog.write_log([b"abc"]) + b"\0\0")) == [b"abc"]


def test_batches():
    ops = [(1, b"k", b"v"), (0, b"gone", b""), (1, b"", b"")]
    assert kvlog.read_batch(kvlog.write_batch(9, ops)) == (9, ops)
    wrong = bytearray(kvlog.write_batch(9, ops))
    wrong[8] = 5
    for bad in (bytes(wrong), b"short"):
        with pytest.raises(Corruption):
            kvlog.read_batch(bad)
    batch = kvlog.Batch().put(b"k", b"v").delete(b"gone").append(kvlog.Batch().put(b"", b""))
    assert batch.ops == ops and len(batch) == 3 and batch.size == len(kvlog.write_batch(9, ops))
    batch.clear()
    assert len(batch) == 0 and batch.size == 12


def test_blocks():
    for seed, interval in ((1, 1), (2, 3), (3, 16)):
        entries = [(k, v) for k, v in zip(sorted(some_keys(seed, 90, 7, b"abc\xff")), some_keys(seed + 9, 90, 40))]
        data = kvlog.write_block(entries, interval)
        assert list(kvlog.read_block(data)) == entries and len(data) >= 4 * -(-90 // interval) + 4
    assert list(kvlog.read_block(kvlog.write_block([], 4))) == []
    for bad in (b"", b"\0\0\0\0", data[:-1]):
        with pytest.raises(Corruption):
            list(kvlog.read_block(bad))


def versions(seed, n):
    """Internal keys with several versions, sorted as tables are, and their values; some compress and some don't."""
    r = random.Random(seed)
    keys = sorted(set(some_keys(seed, n, 5)))
    rows = [(k, s) for k in keys for s in sorted(r.sample(range(1, 200), r.choice((1, 1, 2, 40 if r.random() < 0.02 else 1))), reverse=True)]
    return [(codec.internal_key(k, s, int(r.random() < 0.8)), r.randbytes(r.randrange(30)) if r.random() < 0.5 else b"same " * r.randrange(12)) for k, s in rows]


@pytest.mark.parametrize("compression", [kvlog.PLAIN, kvlog.SNAPPY])
@pytest.mark.parametrize("bits", [0, 10])
def test_tables(compression, bits):
    """Scans, gets at snapshots, seeks both ways, against a plain list; through filters and index, whatever is compressed."""
    entries = versions(11, 3000)
    data = kvlog.write_table(entries, 700, 4, bits, compression)
    table = kvlog.Table(data)
    plain = [(*codec.parse_internal_key(k), v) for k, v in entries]
    assert list(table.scan()) == plain and len(table.index) > 20 and (table.filters is not None) == bool(bits)
    if compression:
        assert len(data) < len(kvlog.write_table(entries, 700, 4, bits))
    r = random.Random(1)
    asked = [k for k, *_ in r.sample(plain, 150)] + some_keys(99, 150, 5)
    for key in asked:
        snapshot = r.choice((codec.MAX_SEQUENCE, 100, 5))
        want = next(((s, o, v) for k, s, o, v in plain if k == key and s <= snapshot), None)
        table.blocks_read = 0
        assert table.get(key, snapshot) == want and table.blocks_read <= 2
        at = [x for x in plain if x[0] >= key]
        assert next(table.seek(key), None) == (at[0] if at else None)
        before = [x for x in plain if x[0] < key]
        assert table.seek_before(key) == (before[-1] if before else None)
    if bits:
        table.blocks_read = 0
        absent = [k for k in some_keys(98, 500, 6) if k not in {x[0] for x in plain}]
        for key in absent:
            table.get(key)
        assert table.blocks_read < 0.1 * len(absent)  # filters rule out most
    assert kvlog.Table(data, policy="of another kind").filters is None


def test_broken_tables():
    data = kvlog.write_table(versions(12, 300), 700, 4, 10, kvlog.SNAPPY)
    for bad in (data[:-1], data[: len(data) // 2], b""):
        with pytest.raises(Corruption):
            kvlog.Table(bad)
    hurt = bytearray(data)
    hurt[9] ^= 1
    with pytest.raises(Corruption):
        list(kvlog.Table(bytes(hurt)).scan())
    raw = np.random.default_rng(1).integers(0, 4, 200_000, np.uint8).tobytes() + random.Random(1).randbytes(70_000)
    assert kvlog._unframed(kvlog._frames(raw)) == raw and len(kvlog._frames(raw)) < len(raw)
    for bad in (b"no frame", kvlog._frames(raw)[:-5], kvlog._frames(raw)[:200] + b"\x17" + kvlog._frames(raw)[201:]):
        with pytest.raises(Corruption):
            kvlog._unframed(bad)
    block = bytearray(kvlog.write_table([(codec.internal_key(b"k", 1, 1), b"v")]))
    size = len(kvlog.write_block([(codec.internal_key(b"k", 1, 1), b"v")], 16))
    block[size] = 7  # a type of compression that there isn't
    block[size + 1 : size + 5] = codec.put_fixed(codec.crc32(bytes(block[: size + 1])), 4)
    with pytest.raises(Corruption, match="compression 7"):
        list(kvlog.Table(bytes(block)).scan())


def test_edits():
    edit = kvlog.Edit("bytewise", 3, 9, 77, 0, [(1, b"p")], [(0, 5)], [(2, 8, 100, b"a", b"z")])
    assert kvlog.Edit.decode(edit.encode()) == edit
    assert kvlog.Edit.decode(b"") == kvlog.Edit()
    for bad in (b"\x63", b"\x06\x07\x01", b"\x05\x01\x00"):
        with pytest.raises(Corruption):
            kvlog.Edit.decode(bad)


def test_scans(spark, tmp_path):
    ops = [(1, b"a", b"1"), (0, b"b", b"")]
    (tmp_path / "1.log").write_bytes(kvlog.write_log([kvlog.write_batch(5, ops), kvlog.write_batch(7, ops[:1])]))
    got = kvlog.scan_logs(spark, f"{tmp_path}/*.log").collect()
    assert sorted((bytes(r.key), r.seq, r.op, bytes(r.value)) for r in got) == [(b"a", 5, 1, b"1"), (b"a", 7, 1, b"1"), (b"b", 6, 0, b"")]
    entries = [(codec.internal_key(b"k", s, 1), b"v%d" % s) for s in (256, 255, 5)] + [(codec.internal_key(b"m", 9, 0), b"")]
    (tmp_path / "2.ldb").write_bytes(kvlog.write_table(entries, bits_per_key=10, compression=kvlog.SNAPPY))
    assert [(bytes(r.key), r.seq) for r in kvlog.scan_tables(spark, f"{tmp_path}/*.ldb").collect()] == [(b"k", 256), (b"k", 255), (b"k", 5), (b"m", 9)]
    got = kvlog.get_from_tables(spark, f"{tmp_path}/*.ldb", [b"k", b"l", b"m"], 255).collect()
    assert [(bytes(r.key), r.seq, r.op) for r in got] == [(b"k", 255, 1), (b"m", 9, 0)]
    got = kvlog.seek_in_tables(spark, f"{tmp_path}/*.ldb", b"l").collect()
    assert {(bytes(r.key), r.seq, r.side) for r in got} == {(b"m", 9, "at"), (b"k", 5, "before")}
    edits = [kvlog.Edit(added=[(0, 1, 10, b"a", b"c")]), kvlog.Edit(deleted=[(0, 1)], added=[(1, 2, 20, b"a", b"d")])]
    (tmp_path / "MANIFEST-000001").write_bytes(kvlog.write_log([e.encode() for e in edits]))
    got = kvlog.scan_manifests(spark, f"{tmp_path}/MANIFEST-*").collect()
    assert [(r.edit_no, r.level, r.number, r.kind) for r in got] == [(0, 0, 1, 1), (1, 0, 1, 0), (1, 1, 2, 1)]


@pytest.mark.parametrize("kind", ["hadoop", "memory"])
def test_file_environments(spark, tmp_path, kind):
    files = MemoryFiles() if kind == "memory" else HadoopFiles(spark, f"{tmp_path}/files")
    assert files.list() == []
    files.write("one", b"\x00\xff")
    files.write("two", b"")
    files.write("one", b"again")
    assert files.list() == ["one", "two"] and files.read("one") == b"again" and files.size("two") == 0 and files.exists("two")
    files.rename("one", "two")
    assert files.list() == ["two"] and files.read("two") == b"again"
    files.remove("two")
    for call in (files.read, files.remove):
        with pytest.raises(FileNotFoundError):
            call("two")


def test_stores_are_written_and_recovered(spark, tmp_path):
    r = random.Random(6)
    rows = [(bytearray(r.choice(b"ab\xc3\xff").to_bytes(1) + r.randbytes(1)), s, int(r.random() < 0.8)) for s in range(1, 400)]
    rows = [(k, s, o, bytearray(b"v%d" % s) if o else None) for k, s, o in rows]
    df = spark.createDataFrame(rows, "k binary, seq long, op int, v binary")
    files = HadoopFiles(spark, str(tmp_path))
    state = store.write_store(files, df.filter("seq <= 300"), df.filter("seq > 300"), file_bytes=2000, bits_per_key=10, compression=kvlog.SNAPPY, block_bytes=500)
    spans = [(low[:-8], high[:-8]) for *_, low, high in state.added]
    assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # tables of a level share no key
    assert files.list()[0] == "000001.ldb" and {"CURRENT", "MANIFEST-%06d" % (len(spans) + 2)} < set(files.list())
    found = recovery.recover(spark, str(tmp_path))
    assert sorted((bytes(x.key), x.seq, x.op, bytes(x.value)) for x in found.entries.collect()) == sorted((bytes(k), s, o, bytes(v or b"")) for k, s, o, v in rows)
    assert found.last_sequence == 399 and found.files.count() == len(spans)
    # A snapshot of the state is a manifest that says the same.
    store.snapshot(files, recovery.snapshot_edit(recovery.read_edits(spark, str(tmp_path))), 50)
    assert recovery.manifest_name(spark, str(tmp_path)) == "MANIFEST-000050"
    assert recovery.recover(spark, str(tmp_path)).entries.count() == 399


def test_history_of_edits_in_many_manifests(spark, tmp_path):
    """Manifests of a bounded size, each encoded by a task: the driver never holds all edits."""
    r = random.Random(7)
    rows = [(n, r.randrange(7), r.randrange(90), r.randrange(2), n, bytearray(b"a"), bytearray(b"\xff")) for n in range(1, 1500)]
    events = spark.createDataFrame(rows, "edit_no long, level int, number long, kind int, file_size long, smallest binary, largest binary")
    written = store.write_history(HadoopFiles(spark, str(tmp_path)), events.repartition(5), 1, file_bytes=8192)
    assert written > 3 and {f"MANIFEST-{n:06d}" for n in range(1, written + 1)} == {p.name for p in tmp_path.glob("MANIFEST*")}
    found = kvlog.scan_manifests(spark, f"{tmp_path}/MANIFEST-*").orderBy("file", "edit_no").collect()
    assert [(f.last_sequence, f.level, f.number, f.kind) for f in found] == [x[:4] for x in rows]
    assert all(f.file_size == f.last_sequence and bytes(f.largest) == b"\xff" for f in found if f.kind)
    assert store.write_history(HadoopFiles(spark, f"{tmp_path}/none"), events.filter("level > 7"), 1) == 0
