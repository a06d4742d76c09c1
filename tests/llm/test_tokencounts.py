import base64
import random

import pytest
import tiktoken

from tideline.llm import tokencounts as T


def brute(text, spans, rule):
    with open(T.RANKS_PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    enc = tiktoken.Encoding("x", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})
    at, tokens = 0, []
    for piece in map(enc.decode_single_token_bytes, enc.encode_ordinary(text)):
        tokens.append((at, at + len(piece)))
        at += len(piece)
    out = []
    for s, e in spans:
        b, z = len(text[:s].encode()), len(text[:e].encode())
        if rule == "first":
            out.append(sum(b <= x < z for x, _ in tokens))
        elif rule == "last":
            out.append(sum(b <= y - 1 < z for _, y in tokens))
        else:
            out.append(sum(max(0, min(y, z) - max(x, b)) / (y - x) for x, y in tokens))
    return out, len(tokens)


def test_lines_and_spans_match_brute_force(spark):
    r = random.Random(6)
    parts = ["alpha ", "b", "\n", "\n\n", "  \n", "日本", "é", "don't", ".\n", "👍"]
    texts = ["", None, "\n", "no end", "x" * 9000] + ["".join(r.choices(parts, k=r.randrange(1, 60))) for _ in range(60)]
    for rule in T.RULES:
        rows = []
        for i, t in enumerate(texts):
            n = len(t or "")
            cuts = sorted({0, n, *(r.randrange(n + 1) for _ in range(4))})
            rows.append((i, t, [(f"s{k}", a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], "clash"))
        df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<name:string,start:long,stop:long>>, id string")
        got = {(x.id, x.section): x for x in T.count_tokens(df, sections="parts", rule=rule).collect()}
        for i, t, spans, _ in rows:
            want, total = brute(t or "", [s[1:] for s in spans], rule)
            assert [got[i, k].n_tokens for k in range(len(spans))] == pytest.approx(want)
            assert sum(want) == pytest.approx(total if spans else 0)
        by_line = {(x.id, x.section): x for x in T.count_tokens(df, rule=rule).collect()}
        for i, t, *_ in rows:
            cut = (t or "").split("\n")
            pieces = [p + "\n" for p in cut[:-1]] + ([cut[-1]] if cut[-1] else [])
            assert sum(1 for k in by_line if k[0] == i) == len(pieces)
            assert [(t or "")[by_line[i, k].start : by_line[i, k].stop] for k in range(len(pieces))] == pieces
            assert sum(by_line[i, k].n_tokens for k in range(len(pieces))) == pytest.approx(brute(t or "", [], rule)[1])


def test_odd_spans_and_empty_tables(spark):
    rows = [(None, "abc def", [("a", -5, 99), None, ("b", 3, 3), ("c", None, None)]), (1, "abc", None), (1, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<name:string,start:long,stop:long>>")
    got = T.count_tokens(df, sections="parts").collect()
    assert [(r.name, r.n_tokens) for r in got] == [("a", 2.0), ("b", 0.0), ("c", 2.0)]
    assert T.count_tokens(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        T.count_tokens(df, rule="most")
