import base64
import hashlib
import random

import pytest

from tideline.llm import warc as W


def rows():
    r = random.Random(5)
    bodies = ["", "<p>é</p>", "a\r\n\r\nWARC/1.0\r\n\r\n", "\n\nfiledesc://x 1 2 3 4\n", "x" * 100_000] + ["".join(r.choices("ab\r\n ", k=r.randrange(60))) for _ in range(60)]
    out = [(i, f"http://e.org/{i} ?q=é#key=7", b, "clash") for i, b in enumerate(bodies)]
    return out + [(900, None, None, "c"), (901, "", bodies[1], "c"), (None, "u", bodies[1], "c"), (None, "u", "only null", "c"), (5, "u", bodies[5], "c")]


def test_round_trip_matches_brute_force(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "page_id long, url string, html string, digest string")
    W.write_arcs(df, f"{tmp_path}/arc")
    W.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    least = {}
    for i, _, b, _ in data:
        least[b or ""] = min((x for x in (least.get(b or ""), i) if x is not None), default=None)
    want = []
    for i, _, b, _ in data:
        raw, first = (b or "").encode(), least[b or ""]
        copy = i != first
        want.append((str("-" if i is None else i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if copy else "response", str(first) if copy else None))
    got = [(r.key, r.bytes, r.digest, r.record_type, r.refers_to) for r in W.warc_rows(spark, f"{tmp_path}/warc").collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_both_versions_and_bad_archives():
    for version in (1, 2):
        records = [("http://a/ b", b"one"), (None, b""), ("http://c", b"x\n" * 5)]
        data = W.arc_header(version, "n.arc") + b"\n".join(W.arc_record(version, u, p, "n.arc", "20010203") for u, p in records) + b"\n"
        got = list(W.read_arc(data))
        assert [p for _, p in got] == [p for _, p in records] and len(got[0][0]) == len(W.ARC_FIELDS[version].split())
        with pytest.raises(W.ArchiveError):
            list(W.read_arc(data[:-4]))
    assert W.warc_date("20010203") == "2001-02-03T00:00:00Z"
    with pytest.raises(W.ArchiveError):
        list(W.read_arc(b"http://no version block\n"))
    whole = W.warc_record({"WARC-Type": "response"}, b"abc") + b"\r\n\r\n"
    assert [b for _, b in W.read_warc(whole * 2)] == [b"abc"] * 2
    with pytest.raises(W.ArchiveError):
        list(W.read_warc(whole[:-6]))


def test_archives_are_split_by_size(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "u", "z" * 500) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    W.write_arcs(df, f"{tmp_path}/arc")
    assert spark.read.format("binaryFile").load(f"{tmp_path}/arc/part-*").count() == 1
    assert W.arc_rows(spark, f"{tmp_path}/arc", True).count() == 50


def test_empty_table(spark, tmp_path):
    W.write_arcs(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/arc")
    W.convert(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    assert W.warc_rows(spark, f"{tmp_path}/warc").count() == 0
