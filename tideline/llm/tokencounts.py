"""Token counts of fields and sections by offset mapping.

A document is encoded once, as a whole, so no token count depends on how it is cut afterwards. The byte offsets of its
tokens are joined with the spans of its sections (both ascending, so the interval join is a binary search), and tokens
that cross a boundary are allocated by an explicit rule:

- 'first': to the section that holds the token's first byte;
- 'last': to the section that holds its last byte;
- 'share': to every section it touches, by the share of its bytes there.

Under each rule the counts of sections that cover a text add up to the text's token count; tokens outside all sections
count for none. A token whose bytes are part of a character belongs where those bytes are.

Sections come as a column of (name, start, stop) in code points, or are the lines, each with its line end.

Defined results. Null text counts as empty and has no section. Null spans are none; overlapping spans are each counted
by themselves; spans beyond the text are cut to it, empty ones have no token. Repeated rows get equal rows. Empty tables
give empty results. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import text_parts

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "share")
_PART_BYTES = 1 << 21


class Encoder:
    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.sizes = np.zeros(max(table.values()) + 1, np.int64)
        for piece, k in table.items():
            self.sizes[k] = len(piece)

    def edges(self, text: str) -> np.ndarray:
        """Byte offsets of all tokens, with the end."""
        return np.concatenate([[0], np.cumsum(self.sizes[np.array(self.encoding.encode_ordinary(text), np.int64)])])


_loaded: dict[bytes, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    key = hashlib.sha1(ranks).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(ranks)
    return _loaded[key]


def allocate(edges: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each byte span [start, stop)."""
    begin, end = edges[:-1], edges[1:]
    some = stop > start
    if rule == "first":
        got = np.searchsorted(begin, stop) - np.searchsorted(begin, start)
    elif rule == "last":
        got = np.searchsorted(end - 1, stop) - np.searchsorted(end - 1, start)
    else:
        # Tokens up to a byte, counting the one it lies in by share.
        at = lambda b: (k := np.clip(np.searchsorted(edges, b, "right") - 1, 0, max(0, len(begin) - 1))) + (b - edges[k]) / np.maximum(1, edges[np.minimum(k + 1, len(edges) - 1)] - edges[k])
        got = at(stop) - at(start) if len(begin) else np.zeros(len(start))
    return np.where(some, got, 0)


def _line_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    edges = np.unique(np.concatenate([[0], ends, [len(raw)]]))
    return edges[:-1], edges[1:]


def _byte_of(raw: bytes) -> np.ndarray:
    """Byte offset of each code point, with the end."""
    return np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "first", ranks_path: str = RANKS_PATH) -> DataFrame:
    """One row a section: id, section (its place), name, start, stop, n_tokens, text_tokens.

    sections names a column array<struct<name,start,stop>>; without one, lines are the sections."""
    if rule not in RULES:
        raise ValueError(f"no rule {rule!r}; there are {RULES}")
    with open(ranks_path, "rb") as f:  # a file of the driver; its content goes with the tasks
        ranks = f.read()
    columns = [F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")]
    source = docs.select(*columns, *([F.col(sections).cast("array<struct<name:string,start:bigint,stop:bigint>>").alias("spans")] if sections else []))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(ranks)
        for batch in batches:
            for i, j in text_parts(batch.column(1), _PART_BYTES):
                parts = batch.slice(i, j - i)
                spans = parts.column(2).to_pylist() if sections else None
                out = [[], [], [], [], [], [], []]
                for row, one in enumerate(parts.column(1).to_pylist()):
                    raw = one.encode()
                    edges = words.edges(one)
                    byte_of = _byte_of(raw)
                    last = len(byte_of) - 1
                    if spans is None:
                        start, stop = _line_spans(raw)
                        names = [None] * len(start)
                        shown = np.searchsorted(byte_of, start), np.searchsorted(byte_of, stop)
                    else:
                        given = [s for s in spans[row] or () if s is not None]
                        names = [s["name"] for s in given]
                        shown = tuple(np.clip(np.array([s[k] if s[k] is not None else (0, last)[k == "stop"] for s in given], np.int64), 0, last) for k in ("start", "stop"))
                        start, stop = byte_of[shown[0]], byte_of[shown[1]]
                    n = len(start)
                    values = [np.full(n, row), np.arange(n), names, shown[0], shown[1], allocate(edges, start, stop, rule).astype(float), np.full(n, len(edges) - 1)]
                    for held, v in zip(out, values, strict=True):
                        held.append(v)
                row, place, names, start, stop, got, total = out
                flat = lambda x: np.concatenate(x) if x else np.zeros(0)
                ids = parts.column(0).take(pa.array(flat(row).astype(np.int64)))
                whole = [pa.array(flat(x).astype(np.int64)) for x in (place, start, stop)]
                yield pa.record_batch(
                    [ids, whole[0], pa.array([n for x in names for n in x], pa.string()), whole[1], whole[2], pa.array(flat(got)), pa.array(flat(total).astype(np.int64))],
                    names=["id", "section", "name", "start", "stop", "n_tokens", "text_tokens"],
                )

    return source.mapInArrow(each, f"id {source.dtypes[0][1]}, section long, name string, start long, stop long, n_tokens double, text_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(F.col("id").alias("doc_id"), "section", "start", "stop", F.col("n_tokens").cast("long").alias("n_tokens"), "text_tokens")
