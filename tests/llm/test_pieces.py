"""The pair test of the piece search, against plain merging."""

import os
import random

import pytest

from tideline.llm.sentencepieces import BPE, MODEL_PATH, Vocabulary

pytestmark = pytest.mark.skipif(not os.path.isfile(MODEL_PATH), reason="no model here")


@pytest.fixture(scope="module")
def model():
    with open(MODEL_PATH, "rb") as f:
        return f.read()


def test_pairs_by_their_merges_as_by_merging(model, monkeypatch):
    words, r = Vocabulary(model), random.Random(5)
    assert words.kind == BPE
    own = sorted(words.ids.values())
    pairs = [(r.choice(own), r.choice(own)) for _ in range(2000)]
    for k in r.sample(own, 2000):  # neighbours that can meet in a piece
        p = words.pieces[k]
        pairs += [(words.ids[p[:i]], words.ids[p[i:]]) for i in range(1, len(p)) if p[:i] in words.ids and p[i:] in words.ids]
    want = [words.merge(words.pieces[a] + words.pieces[b]) == [words.pieces[a], words.pieces[b]] for a, b in pairs]
    monkeypatch.setattr(words, "merge", None)  # a joined text isn't merged again for each pair
    assert [words.fits(a, b) for a, b in pairs] == want and 100 < sum(want) < len(want)
