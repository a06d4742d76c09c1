"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the characters once. For each position it keeps the last piece of the best path up to there; only
the positions within the longest piece can still be extended, so older ones are dropped as soon as the paths from all
of these lead back through one boundary, and the ids before that boundary are final. All texts go through this one
search, long and short. Of paths that tie, the one found first stays: that of the longest last piece. A unigram model is searched for
the greatest sum of scores. The pieces of a BPE model have merge ranks instead, which are no weights of a sum: there
each pair of neighbouring pieces weighs nothing if merging their joined text gives the same pair back, and is
forbidden otherwise. Exactly one path satisfies this at every position, and it is the one that merging finds.

Texts are cut where no piece of the vocabulary can cross (before a run of blanks, around characters that no piece
holds): all paths meet there by construction. The ids that the search finds for short segments are kept in a bounded
table of the worker, as long as it encodes, and looked up when the segment comes again.

Defined results. Null text encodes to no ids, as does the empty text. Characters outside the vocabulary become byte
pieces, or the unknown piece if the model has none. The escape character itself (U+2581) decodes to a blank, so such
texts report round_trip false. Repeated rows get equal results; empty tables give empty results. Other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, kept, lean, table
from .words import text_parts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Entries of the tables of segments and of pairs that a worker keeps; longest segment kept; characters that the search takes at once.
SEGMENTS, PAIRS, KEPT, LOOK_EVERY = 320_000, 300_000, 64, 64
_PART_BYTES = 1 << 21
ESCAPE = "▁"
# Piece types and model types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The score of a merge that there isn't.
NEVER = float("-inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0]
            at += size


def _path(window: str, last: list, start: list, to: int) -> list[tuple[int, str]]:
    """The pieces of the best path to a boundary."""
    out = []
    while to:
        out.append((last[to], window[start[to] : to]))
        to = start[to]
    return out[::-1]


class Vocabulary:
    """The pieces of a model and the search over them."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.types = [], [], []
        kind, norm = UNIGRAM, {}
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece[2])
                self.types.append(piece[3])
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models without normalisation rules are supported")
        self.kind, self.prefix = kind, bool(norm.get(3, 1))
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER_DEFINED)}
        #: By character: (id or -1, the same for what may follow).
        self.trie: dict = {}
        for piece, k in sorted(self.ids.items()):
            below = self.trie
            for c in piece[:-1]:
                below = below.setdefault(c, (-1, {}))[1]
            below[piece[-1]] = (k, {})
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores, default=0.0) - 10.0
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(ESCAPE, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        inner = {c for p in self.ids for c in p}
        crossing = any(ESCAPE in p.lstrip(ESCAPE) for p in self.ids)
        lone = "\n" not in inner
        stop = " \n" if lone else " "
        #: Segments of a text that has blanks for escape characters: most such strings take a byte a character.
        self.segments = None if crossing else re.compile(f" *[^{stop}]+| +" + "|\n" * lone)
        #: By left piece, whether a right piece may follow it, as far as known; and how many are known.
        self.after: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.pairs = 0
        #: By piece, the merges that make it.
        self.steps: dict[int, list[tuple[float, str, str]] | None] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def merge(self, text: str) -> list[str]:
        """Plain BPE merging: again and again the best-scored neighbours, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two pieces gives the pair back; unknown characters (-1) never merge."""
        if left < 0 or right < 0:
            return True
        found = self.after[left].get(right)
        if found is None:
            if self.pairs >= PAIRS:
                for held in self.after:
                    held.clear()
                self.pairs = 0
            found = self.after[left][right] = self._stays_apart(left, right)
            self.pairs += 1
        return found

    def _steps(self, k: int) -> list[tuple[float, str, str]] | None:
        """The merges that make a piece of its characters, in their order: score, first and last part before each; at the
        end the piece itself. None if merging doesn't make it."""
        if k not in self.steps:
            parts, out = list(self.pieces[k]), []
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    one = self.ids.get(parts[i] + parts[i + 1])
                    if one is not None and (best is None or self.scores[one] > best):
                        best, at = self.scores[one], i
                out.append((NEVER if best is None else best, parts[0], parts[-1]))
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.steps[k] = out if len(parts) == 1 else None
        return self.steps[k]

    def _stays_apart(self, left: int, right: int) -> bool:
        """merge(a + b) == [a, b], by the merges of a and of b alone: in the joined text they come in the order of their
        scores, leftmost first, until one across the border, of a's last part and b's first, comes before them."""
        a, b = self._steps(left), self._steps(right)
        if a is None or b is None:
            return False
        ids, scores, i, j = self.ids, self.scores, 0, 0
        while True:
            (next_a, _, end), (next_b, begin, _) = a[i], b[j]
            across = ids.get(end + begin)
            if across is not None and scores[across] > next_a and scores[across] >= next_b:
                return False
            if next_a == NEVER and next_b == NEVER:
                return True
            if next_a >= next_b:
                i += 1
            else:
                j += 1

    def search(self, text: Iterable[str]) -> Iterator[tuple[int, str]]:
        """(id, text) of the pieces of a stream of characters, as soon as they are final; id -1 for unknown characters."""
        for pieces in self._final(text):
            yield from pieces

    def _final(self, text: Iterable[str]) -> Iterator[list[tuple[int, str]]]:
        """The pieces that become final each time the window has grown.

        By position in the window, what follows the last final boundary: the last piece of the best path up to there
        (None: there is no path, -2: the text begins there), where it starts, and its score."""
        extend = self._sum_up if self.kind == UNIGRAM else self._fit_on
        if isinstance(text, str) and len(text) < LOOK_EVERY:  # one window holds all of it
            size = len(text)
            last, start = [-2, *[None] * size], [0] * (size + 1)
            extend(text, last, start, [0.0] * (size + 1), 0, size, 0, 0)
            yield _path(text, last, start, size)
            return
        window, last, start, score = "", [-2], [0], [0.0]
        at = reach = met = 0
        longest, taken, ended = self.longest, 0, False
        source = None if isinstance(text, str) else iter(text)
        while not ended:
            part = "".join(islice(source, LOOK_EVERY)) if source else text[taken : taken + LOOK_EVERY]
            taken += len(part)
            ended = len(part) < LOOK_EVERY
            window += part
            last += [None] * len(part)
            start += [0] * len(part)
            score += [0.0] * len(part)
            # A piece from a position must be seen whole.
            stop = len(window) if ended else len(window) - longest + 1
            if at < stop:
                at, reach, met = extend(window, last, start, score, at, stop, reach, met)
            if ended:
                yield _path(window, last, start, len(window))
            elif final := max(met, self._common(last, start, at, reach)):
                yield _path(window, last, start, final)
                window, last, start, score = window[final:], last[final:], [s - final for s in start[final:]], score[final:]
                at, reach, met = at - final, reach - final, 0

    def _fit_on(self, window: str, last: list, start: list, score: list, at: int, stop: int, reach: int, met: int) -> tuple[int, int, int]:
        """Extend the only allowed path to each position by the pieces that begin there; (stop, furthest end, last
        position past which no path leads)."""
        after, fits, root, longest = self.after, self.fits, self.trie, self.longest
        for at in range(at, stop):
            before = last[at]
            if before is None:
                continue
            if at == reach:
                met = at
            allowed = after[before].get if before >= 0 else None
            first, to = root.get(window[at]), at + 1
            if first is None or first[0] < 0:  # a character that is no piece stands for itself
                last[to], start[to] = -1, at
                if to > reach:
                    reach = to
                if first is None:
                    continue
            elif last[to] is None and (allowed is None or fits(before, first[0])):
                last[to], start[to] = first[0], at
                if to > reach:
                    reach = to
            below = first[1]
            for char in window[to : at + longest]:
                node = below.get(char)
                if node is None:
                    break
                to += 1
                k, below = node
                if k < 0 or last[to] is not None:  # only one piece ends here, and it is found
                    continue
                if allowed is not None:
                    ok = allowed(k)
                    if not (fits(before, k) if ok is None else ok):
                        continue
                last[to], start[to] = k, at
                if to > reach:
                    reach = to
        return stop, reach, met

    def _sum_up(self, window: str, last: list, start: list, score: list, at: int, stop: int, reach: int, met: int) -> tuple[int, int, int]:
        """The same by the greatest sum of scores."""
        for at in range(at, stop):
            if last[at] is None:
                continue
            if at == reach:
                met = at
            below, to = self.trie, at
            for char in window[at : at + self.longest]:
                to += 1
                k, below = below.get(char, (-1, {}))
                if k < 0 and to > at + 1:
                    if not below:
                        break
                    continue
                total = score[at] + (self.scores[k] if k >= 0 else self.worst)
                if last[to] is None or total > score[to]:
                    last[to], start[to], score[to] = k, at, total
                    reach = max(reach, to)
        return stop, reach, met

    @staticmethod
    def _common(last: list, start: list, at: int, reach: int) -> int:
        """The last boundary through which the best paths to all positions that can still be extended lead."""
        alive = {i for i in range(at, reach + 1) if last[i] is not None}
        while len(alive) > 1:
            most = max(alive)
            alive.discard(most)
            alive.add(start[most])
        return alive.pop() if alive else 0

    def _ids(self, text: str) -> list[int]:
        out = []
        for pieces in self._final(text):
            for k, part in pieces:
                if k >= 0:
                    out.append(k)
                elif self.bytes:
                    out += [self.bytes[b] for b in part.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_checked(text)[0]

    def encode_checked(self, text: str) -> tuple[np.ndarray, bool]:
        """(ids, whether they decode to the text). Decoding goes piece by piece, so it gives the text back if it does so
        for every segment; the escape character itself comes back as a blank."""
        if not text:
            return np.zeros(0, np.int32), True
        blank = " " * self.prefix + text.replace(ESCAPE, " ")
        if self.segments is None or not self.bytes:
            ids = self._ids(blank.replace(" ", ESCAPE))
            return np.array(ids, np.int32), self.decode(ids) == text
        segments = self.segments.findall(blank)
        found = list(map(self.known.get, segments))
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    found[at] = self._new(segments[at])
        same = ESCAPE not in text and self.lossy.isdisjoint(segments)
        return np.frombuffer(b"".join(found), np.int32), same

    def _new(self, segment: str) -> bytes:
        """Ids of a segment that the newer half of the table lacks; segments in use come back from the older half."""
        ids = self.known.get(segment) or self.older.get(segment)
        if ids is None:
            found = self._ids(segment.replace(" ", ESCAPE))
            ids = struct.pack(f"<{len(found)}i", *found)
            if b"".join(map(self.raw.__getitem__, found)) != segment.encode():
                self.lossy.add(segment)
        if len(segment) <= KEPT:
            if len(self.known) >= SEGMENTS:
                self.older, self.known = self.known, {}
                if len(self.lossy) > SEGMENTS:  # no more than the tables can refer to
                    self.lossy &= self.older.keys()
            self.known[segment] = ids
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH, with_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, round_trip, ids) of every row; the digest is over little-endian 32-bit ids.

    With keep, these columns of docs stand in place of id; a new column whose name one of them has gets underscores
    added to its own."""
    with open(model_path, "rb") as f:  # a file of the driver; its content goes with the tasks
        model = f.read()
    own = docs.select(*keep) if keep else docs.select(F.col(id_col).alias("id"))
    n, added = len(own.columns), [free_name(c, own.columns) for c in ("n_tokens", "ids_sha256", "round_trip", "ids")][: 3 + with_ids]
    source = docs.select(*(keep or [F.col(id_col).alias("id")]), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(free_name("whole", own.columns)))
    names, key = [*own.columns, *added], hashlib.sha256(model).hexdigest()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(key, lambda: Vocabulary(model))
        for batch in batches:
            for i, j in text_parts(batch.column(n), _PART_BYTES):
                counts, digests, same, ids = [], [], [], []
                for one in batch.column(n)[i:j].to_pylist():
                    got, back = words.encode_checked(one)
                    counts.append(len(got))
                    digests.append(hashlib.sha256(got).hexdigest())
                    same.append(back)
                    ids.append(got)
                columns = [*batch.slice(i, j - i).columns[:n], pa.array(counts, pa.int64()), pa.array(digests), pa.array(same)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
                yield pa.record_batch(columns, names=names)

    new = [T.StructField(c, k) for c, k in zip(added, (T.LongType(), T.StringType(), T.BooleanType(), T.ArrayType(T.IntegerType())), strict=False)]
    return source.mapInArrow(lean(each, key), T.StructType(own.schema.fields + new))


def decode_ids(encoded: DataFrame, id_col: str = "id", ids: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """(id, text) from ids; null ids count as none."""
    with open(model_path, "rb") as f:
        model = f.read()
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids).cast("array<int>").alias("ids"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(model)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([words.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], names=["id", "text"])

    return source.mapInArrow(lean(each), f"id {source.dtypes[0][1]}, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).withColumnRenamed("id", "doc_id")
