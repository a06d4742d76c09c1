"""Vectorised words: spans and 64-bit hashes of all words of an Arrow batch of texts, without a Python loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i up to n at least."""
    size = max(_PIECE, 1 << (n - 1).bit_length()) + 1
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, U64(_BASE)), np.full(size, U64(inverse))
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def separators(kind: str) -> np.ndarray:
    """Boolean table of the bytes that are part of words. 'blank': all but [\x20\x09-\x0D]; 'alnum': letters, digits and all bytes from 0x80."""
    word = np.ones(256, bool)
    if kind == "blank":
        word[[32, 9, 10, 11, 12, 13]] = False
    else:
        word[:128] = [chr(c).isalnum() for c in range(128)]
    return word


def batch_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each text the index of its first word, with a last entry for the end."""
    inside = word[data]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with lower, of the word with A-Z lower-cased."""
    out = np.empty(len(starts), U64)
    values = _BYTES[_LOWER] if lower else _BYTES
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + _PIECE, "right")))
        b = ends[j - 1]
        up, down = powers(int(b - a))
        total = np.empty(b - a + 1, U64)
        total[0] = 0
        np.cumsum(values[data[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes (also those that cross texts): len(words)-n+1 of them."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, U64(n))
    for k in range(n):
        out = out * U64(_BASE) + words[k : k + count]
    return mix(out)


def text_parts(column: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes each, one text at least."""
    _, offsets = batch_bytes(column)
    out, i = [], 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        out.append((i, j))
        i = j
    return out


class HashArray:
    """A sorted array of hashes with a table on their leading bits, so that a search reads a few neighbours."""

    def __init__(self, keys: np.ndarray):
        bits = max(1, int(len(keys) * 4).bit_length())
        self.shift, self.size = U64(64 - bits), len(keys)
        held = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits)
        self.start, self.run = (np.cumsum(held) - held).astype(np.int32), int(held.max())
        self.keys = np.append(keys, ~U64(0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        at = self.start[(wanted >> self.shift).astype(np.int64)]
        for _ in range(self.run):
            at = at + (self.keys[at] < wanted)
        return np.where((self.keys[at] == wanted) & (at < self.size), at, -1)
