import random
import re

from tideline.llm import secrets as S


def brute(text):
    text = text or ""
    out = []
    for k, p, ok in (
        (0, r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8),
        (1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        (2, r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text) if ok(m)]
    return sorted(out)


def texts():
    r = random.Random(7)
    parts = ["token", "API_KEY", "apikey", "PassWord", "secret", "=", ": ", " ", "\"", "'", "abcdefgh", "0123456789abcdef" * 2, "AKIA", "ABCDEFGH1234", "\x01", "\x02", "日", "é", "\n", "x", "passwd"]
    out = [None, "", "token = \"abc\"", "k" * 40_000, "token=" + "a" * 30_000, "AKIA" + "Z" * 12, "AKIA" + "Z" * 11, "f" * 31, "f" * 32, "ſecret: abcdefghij", "toKen: abcdefghij"]
    return out + ["".join(r.choices(parts, k=r.randrange(1, 40))) for _ in range(400)]


def test_spans_match_brute_force(spark):
    data = [(i, t, "clash") for i, t in enumerate(texts())]
    df = spark.createDataFrame(data, "i int, text string, spans string")
    got = {r.i: [(s.start, s.kind, s.stop) for s in r.found] for r in df.select("i", S.find_spans(S.text_or_empty()).alias("found")).collect()}
    assert got == {i: brute(t) for i, t, _ in data} and any(got.values())


def test_many_matches_in_one_text(spark):
    """More matches than a chunk has pieces; offsets go on over chunks."""
    text = " é".join(f"AKIA{'ABCDEFGHIJKL'}{i:04d}" for i in range(700)) + " " + "f" * 40
    df = spark.createDataFrame([(1, text)], "i int, text string")
    got = df.select(S.find_spans(S.text_or_empty()).alias("found")).first().found
    assert [(s.start, s.kind, s.stop) for s in got] == brute(text) and len(got) == 701


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    secret = "token: abcdefgh12 ftp://me:secret@host"
    first = [(1, secret), (2, secret), (3, "clean"), (None, None), (2, secret)]
    df = spark.createDataFrame(first, "doc_id long, text string")
    rows = S.scan_versions(df, S.BlobLedger(spark, path, S.BASE_RULES))
    assert sorted((r.path is None, r.path or 0, len(r.spans)) for r in rows.collect()) == [(False, 1, 1), (False, 2, 1), (False, 2, 1), (False, 3, 0), (True, 0, 0)]
    ledger = S.BlobLedger(spark, path, S.BASE_RULES)
    assert ledger.read().count() == ledger.batches().count() == 3
    # A batch with one new blob: only that is scanned.
    more = spark.createDataFrame([*first, (9, "api_key=zzzzzzzzz")], "doc_id long, text string")
    assert S.scan_versions(more, ledger).count() == 6 and ledger.batches().count() == 4
    # Rules are added: each blob is scanned again, by these alone, and all findings come back to all paths.
    wider = S.BlobLedger(spark, path)
    assert wider.read().count() == 0
    got = {r.path: [(s.start, s.kind, s.stop) for s in r.spans] for r in S.scan_versions(more, wider).collect()}
    assert got[1] == got[2] == [(0, 0, 17), (18, 4, 34)] and got[9] == [(0, 0, 17)] and got[3] == []
    assert [sorted(r.scanned) for r in wider.batches().collect()].count(["pem@1", "url@1"]) == 4 and wider.batches().count() == 8
    # A rule's new version replaces what the old one found; findings of the others stay.
    changed = S.BlobLedger(spark, path, (S.Rule(0, 2, S.ASSIGN, lambda p: S.F.lit(False), S.ASSIGN), *S.RULES[1:]))
    got = {r.path: [(s.start, s.kind, s.stop) for s in r.spans] for r in S.scan_versions(more, changed).collect()}
    assert got[1] == [(18, 4, 34)] and got[9] == [] and wider.read().count() == 4
    # Nothing new: nothing is appended.
    before = changed.batches().count()
    assert S.scan_versions(more, changed).count() == 6 and changed.batches().count() == before


def test_query_is_incremental(spark, tmp_path, monkeypatch):
    """The query's second round finds blobs of the first in the ledger and runs only the added rules on them."""
    rows = [(i, f"token = abcdefgh{i % 40:02d} http://a:b{i % 40}@c", f"src{i % 8}") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    real = S.BlobLedger.scan
    monkeypatch.setattr(S.BlobLedger, "scan", lambda self, *a: (real(self, *a), seen.append(self))[0])
    got = S.op9_secret_scan(spark, str(tmp_path)).collect()
    assert len(got) == 120 and all(r.n_assign == 1 and r.spans.count(":") == 4 for r in got)
    batches = [tuple(sorted(r.scanned)) for r in seen[1].batches().collect()]
    added, base = ("pem@1", "url@1"), ("access@1", "assign@1", "hex@1")
    assert len(seen) == 2 and set(batches) <= {base, added, tuple(sorted(base + added))} and batches.count(base) == batches.count(added) > 0
    assert len(batches) == 40 + batches.count(base)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.scan_versions(df, S.BlobLedger(spark, f"{tmp_path}/ledger")).count() == 0
