import random
import struct

import pytest
import sentencepiece

from tideline.llm import sentencepieces as S


@pytest.fixture(scope="module")
def words():
    with open(S.MODEL_PATH, "rb") as f:
        return S.Vocabulary(f.read())


def texts():
    r = random.Random(4)
    parts = ["a", "the", "  ", " ", "\n", "é", "日本", "ing", "▁", "<0x0A>", "👍", "\t", "23", "er", " t", "\x00"]
    return ["", " ", " " * 40 + "a", "x" * 3000, "ab" * 700 + "\n" * 3] + ["".join(r.choices(parts, k=r.randrange(1, 40))) for _ in range(1500)]


def test_ids_equal_the_library(words):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL_PATH)
    for t in texts():
        assert words.encode(t).tolist() == library.encode(t)
        assert words.decode(words.encode(t).tolist()) == library.decode(library.encode(t)) or "▁" in t or "\x00" in t


def test_checked_round_trip_is_that_of_decoding(words):
    for t in [*texts(), "a\ufffdb", "\ud7ff", "x▁y", "  two  "]:
        ids, same = words.encode_checked(t)
        assert same == (words.decode(ids.tolist()) == t)
    fresh = S.Vocabulary(open(S.MODEL_PATH, "rb").read())
    fresh.raw = [b"?" if r == b"ing" else r for r in fresh.raw]  # a piece that doesn't come back
    for t in ("sing", "song", "a thing or two", "sing"):
        ids, same = fresh.encode_checked(t)
        assert same == (fresh.decode(ids.tolist()) == t)


def test_stream_commits_early_and_agrees(words):
    text = " ".join(["thinking", "unbelievable", "日本", "internationalisation"] * 200).replace(" ", S.ESCAPE)
    seen = 0

    def chars():
        nonlocal seen
        for c in text:
            seen += 1
            yield c

    got = words.search(chars())
    first = next(got)
    assert seen <= S.LOOK_EVERY + 2 * words.longest
    assert "".join(p for _, p in [first, *got]) == text
    for t in texts()[:300]:
        if t:
            assert words._ids((" " + t).replace(" ", S.ESCAPE)) == words.encode(t).tolist()


def unigram_model(pieces):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    field = lambda k, v: varint(k << 3 | 2) + varint(len(v)) + v
    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([t])) for p, s, t in pieces)
    return out + field(2, b"\x18\x01") + field(3, b"\x18\x01\x20\x00\x28\x01")


def test_unigram_search_finds_the_best_sum():
    r = random.Random(2)
    pieces = {"".join(r.choices("ab▁", k=r.randrange(1, 5))): -r.random() * 9 for _ in range(40)} | {"a": -9.0, "b": -9.5, "▁": -8.0}
    model = S.Vocabulary(unigram_model([("<unk>", 0.0, 2), *[(p, s, 1) for p, s in pieces.items()]]))
    for _ in range(60):
        t = "▁" + "".join(r.choices("ab▁", k=r.randrange(1, 160)))
        best = [0.0] + [None] * len(t)
        for i in range(1, len(t) + 1):
            best[i] = max(best[j] + pieces[t[j:i]] for j in range(max(0, i - 5), i) if t[j:i] in pieces)
        got = list(model.search(t))
        assert "".join(p for _, p in got) == t and sum(pieces[p] for _, p in got) == pytest.approx(best[-1], abs=1e-4)


def test_window_stays_bounded_and_commits_between_words(words, monkeypatch):
    """No boundary for hundreds of characters, then ordinary words: the window never holds much more than it takes at once."""
    longest = []
    common = S.Vocabulary._common
    monkeypatch.setattr(S.Vocabulary, "_common", staticmethod(lambda last, *x: (longest.append(len(last)), common(last, *x))[1]))
    for text in ("a" * 5000, "thinking" * 700, "ab" * 3000, "the" + "▁" * 900 + "end"):
        got = list(words.search(text))
        assert "".join(p for _, p in got) == text and words._ids(text) == words._ids(list(text))
    assert max(longest) <= 2 * S.LOOK_EVERY + 4 * words.longest


def test_encode_goes_through_the_search(words, monkeypatch):
    seen = []
    search = S.Vocabulary._final
    monkeypatch.setattr(S.Vocabulary, "_final", lambda self, t: (seen.append(t), search(self, t))[1])
    fresh = S.Vocabulary(open(S.MODEL_PATH, "rb").read())
    fresh.encode("short words and " + "x" * 300)
    assert {len(t) > S.KEPT for t in seen} == {True, False} and "".join(seen) == "▁short▁words▁and▁" + "x" * 300


def test_a_position_with_a_piece_asks_for_no_more_pairs(monkeypatch):
    """One piece at most ends at a position, so pairs are tested until it is found; keys of segments take a byte a character."""
    asked = []
    apart = S.Vocabulary._stays_apart
    monkeypatch.setattr(S.Vocabulary, "_stays_apart", lambda self, *pair: (asked.append((pair, apart(self, *pair))), asked[-1][1])[1])
    fresh = S.Vocabulary(open(S.MODEL_PATH, "rb").read())
    for word in ("international", "thoningin", "unbelievable"):
        asked.clear()
        fresh.after = [{} for _ in fresh.pieces]
        text = S.ESCAPE + word
        got = list(fresh.search(text))
        # Pairs of pieces that meet in the text, by the position where the right one ends.
        ends = {fresh.ids[text[j:k]]: k for j in range(len(text)) for k in range(j + 1, len(text) + 1) if text[j:k] in fresh.ids and text.count(text[j:k]) == 1}
        seen = [(ends[b], fits) for (_, b), fits in asked if b in ends]
        found = set()
        for to, fits in seen:
            assert to not in found
            if fits:
                found.add(to)
        assert found and "".join(p for _, p in got) == text
    fresh.encode("ordinary words")
    assert fresh.known and all(k.isascii() for k in fresh.known)


def test_clashing_names(spark):
    names = ["doc_id", "text", "ids", "n_tokens", "IDS_SHA256", "round_trip", "whole"]
    df = spark.createDataFrame([(1, "a b", "1", "2", "3", "4", "5")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = S.encode_texts(df, keep=df.columns)
    assert got.columns == [*names, "n_tokens_", "ids_sha256_", "round_trip_", "ids_"]
    row = got.first()
    assert tuple(row)[:7] == (1, "a b", "1", "2", "3", "4", "5") and row.n_tokens_ == len(row.ids_) > 0


def test_rows(spark):
    data = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "▁"), (5, "x" * 20000)]
    got = {(r.id, r.n_tokens): r for r in S.encode_texts(spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, ids string")).collect()}
    assert len(got) == 5 and got[(2, 0)].ids == [] and got[(1, 0)].round_trip
    assert not next(r for r in got.values() if r.id is None).round_trip and next(r for r in got.values() if r.id == 5).round_trip
    assert S.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    back = S.decode_ids(S.encode_texts(spark.createDataFrame(data, "doc_id long, text string"))).collect()
    assert sorted(r.text for r in back) == sorted((t or "").replace("▁", " ") if t != "▁" else " " for _, t in data)
