import pytest

from tideline.functions import codec
from tideline.functions.codec import Corruption
from tideline.operators import manifest, read
from tideline.sources import kvlog, recovery
from pyspark.sql import functions as F


def folder(path, prev=0):
    key = lambda k, s, op=1: codec.internal_key(k, s, op)
    (path / "000005.ldb").write_bytes(kvlog.write_table([(key(b"a", 2), b"a2"), (key(b"a", 1), b"a1"), (key(b"b", 3), b"b3")], bits_per_key=10))
    (path / "000004.log").write_bytes(kvlog.write_log([kvlog.write_batch(1, [(1, b"old", b"x")])]))
    (path / "000006.log").write_bytes(kvlog.write_log([kvlog.write_batch(4, [(0, b"a", b""), (1, b"c", b"c5")]), kvlog.write_batch(6, [(1, b"", b"empty key")])]))
    edits = [kvlog.Edit("bytewise", 4, 5, 0, 0), kvlog.Edit(added=[(0, 7, 9, b"x", b"y")]), kvlog.Edit(log_number=6, next_file=7, last_sequence=3, prev_log=prev, deleted=[(0, 7)], added=[(0, 5, 99, b"a", b"b")], pointers=[(1, b"p")])]
    (path / "MANIFEST-000003").write_bytes(kvlog.write_log([e.encode() for e in edits]))
    (path / "CURRENT").write_bytes(b"MANIFEST-000003\n")
    return edits


def test_recovers_tables_and_logs(spark, tmp_path):
    edits = folder(tmp_path)
    got = recovery.recover(spark, str(tmp_path))
    assert (got.log_number, got.prev_log, got.next_file, got.last_sequence) == (6, 0, 7, 6)
    log = got.entries.select(F.col("key").alias("k"), "seq", "op", F.col("value").alias("v"))
    assert sorted((bytes(r.k), bytes(r.v)) for r in read.latest(log).collect()) == [(b"", b"empty key"), (b"b", b"b3"), (b"c", b"c5")]
    assert sorted((bytes(r.k), bytes(r.v)) for r in read.latest(log, 2).collect()) == [(b"a", b"a2")]
    whole = recovery.snapshot_edit(edits)
    assert kvlog.Edit.decode(whole.encode()) == whole == recovery.snapshot_edit([whole]) and [f[1] for f in whole.added] == [5]


def test_previous_log_is_replayed_too(spark, tmp_path):
    folder(tmp_path, prev=4)
    assert recovery.recover(spark, str(tmp_path)).entries.filter("seq = 1").count() == 2


@pytest.mark.parametrize("harm,said", [("CURRENT", "newline"), ("table", "missing"), ("comparator", "ordered"), ("scalar", "next_file")])
def test_refuses_broken_folders(spark, tmp_path, harm, said):
    folder(tmp_path)
    if harm == "CURRENT":
        (tmp_path / "CURRENT").write_bytes(b"MANIFEST-000003")
    elif harm == "table":
        (tmp_path / "000005.ldb").unlink()
    else:
        edit = kvlog.Edit("other", 1, 1, 1) if harm == "comparator" else kvlog.Edit(log_number=1)
        (tmp_path / "MANIFEST-000003").write_bytes(kvlog.write_log([edit.encode()]))
    with pytest.raises(Corruption, match=said):
        recovery.recover(spark, str(tmp_path))


def test_filter_blocks_and_internal_separators():
    keys = [(offset, b"k%d" % i) for i, offset in enumerate((0, 100, 2100, 9000, 9000))]
    data = codec.filter_block(keys)
    assert all(codec.filter_may_match(data, o, k) for o, k in keys)
    assert not codec.filter_may_match(data, 4500, b"k0") and codec.filter_may_match(data, 99999, b"k0")
    a, b = codec.internal_key(b"abcdef", 5, 1), codec.internal_key(b"abzz", 9, 1)
    assert codec.separator_internal(a, b) == codec.internal_key(b"abd", codec.MAX_SEQUENCE, 1)
    assert codec.separator_internal(a, a) == a and codec.successor_internal(a) == codec.internal_key(b"b", codec.MAX_SEQUENCE, 1)


def test_file_names_round_trip(spark):
    df = spark.createDataFrame([(1,), (999999,), (1234567,)], "n long")
    for kind in ("manifest", "log", "table", "temp"):
        name = manifest.format_name(F.col("n"), kind)
        number, got = manifest.parse_name(F.col("name"))
        rows = df.select("n", name.alias("name")).select("n", number.alias("number"), got.alias("kind")).collect()
        assert all(r.number == r.n and r.kind == kind for r in rows)
