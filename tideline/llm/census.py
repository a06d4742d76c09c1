"""Which hashes of many units occur twice or more: a filter in two short exchanges that loses nothing.

A unit (a piece of texts that one task holds) sends the leading bits of its distinct hashes, ascending and as
differences, cut by hash range; empty ranges send nothing, so rows never outnumber hashes. The owner of a range says for
each unit, in the unit's own order, which values occur twice. The number of bits follows the number of hashes, six more
than it takes to count them: of the hashes that occur once, one in some sixty passes by chance. The exact work that
follows then moves little more than what does repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean_group
from .packing import pack, pack_sorted, unpack, unpack_sorted

#: Values of all units in a range; bits beyond those that count all values.
RANGE_VALUES, SPARE_BITS = 1_000_000, 6
U64 = np.uint64
SENT = "range int, unit int, tag int, grams binary, many binary"
FOUND = "range int, unit int, tag int, live binary"
_SENT = pa.schema([("range", pa.int32()), ("unit", pa.int32()), ("tag", pa.int32()), ("grams", pa.binary()), ("many", pa.binary())])


def plan(values: int) -> tuple[int, int]:
    """(bits of a value, bits of a range) for so many values."""
    return min(64, max(1, int(values)).bit_length() + SPARE_BITS), int(values // RANGE_VALUES).bit_length()


def ranges(values: np.ndarray, width: int, bits: int) -> list[tuple[int, int, int]]:
    """(range, begin, end) of the ranges that ascending values of a width fall into."""
    if not len(values):
        return []
    place = (values >> U64(width - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    head = np.flatnonzero(np.diff(place, prepend=-1))
    return list(zip(place[head].tolist(), head.tolist(), [*head[1:].tolist(), len(values)], strict=True))


class Asked:
    """The distinct values of a unit under a tag. twice: which of the hashes count as two by themselves; none: which as nothing."""

    def __init__(self, hashes: np.ndarray, weight: np.ndarray, sizes: tuple[int, int]):
        self.width, self.bits = sizes
        self.values, self.index = np.unique(hashes >> U64(64 - self.width), return_inverse=True)
        self.weight = np.minimum(np.bincount(self.index, weights=weight, minlength=len(self.values)), 2).astype(np.uint8)

    def rows(self, unit: int, tag: int) -> list[tuple]:
        return [(r, unit, tag, pack_sorted(self.values[a:b]), pack(self.weight[a:b])) for r, a, b in ranges(self.values, self.width, self.bits)]

    def live(self, answers: dict[int, bytes]) -> np.ndarray:
        """By hash: whether its value occurs twice in all units. answers: by range."""
        out = np.zeros(len(self.values), bool)
        for r, a, b in ranges(self.values, self.width, self.bits):
            if r in answers:
                out[a:b] = np.unpackbits(unpack(answers[r], np.uint8), count=b - a).astype(bool)
        return out[self.index]


def sent_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_SENT), _SENT, strict=True)], schema=_SENT)


def census(sent: DataFrame) -> DataFrame:
    """(range, unit, tag, live) of rows as sent_table makes them; ranges without any value that lives are left out."""

    def mark(group: pa.Table) -> pa.Table:
        values = [unpack_sorted(x.as_py()) for x in group["grams"]]
        weight = np.concatenate([unpack(x.as_py(), np.uint8) for x in group["many"]])
        _, index = np.unique(np.concatenate(values), return_inverse=True)
        live = np.bincount(index, weights=weight) >= 2
        live, edge = live[index], np.cumsum([0, *map(len, values)])
        some = [k for k in range(len(values)) if live[edge[k] : edge[k + 1]].any()]
        bits = [pack(np.packbits(live[edge[k] : edge[k + 1]])) for k in some]
        return pa.table([*(group[c].take(pa.array(some, pa.int64())) for c in ("range", "unit", "tag")), pa.array(bits, pa.binary())], names=["range", "unit", "tag", "live"])

    return sent.groupBy("range", "tag").applyInArrow(lean_group(mark), FOUND)


def answers(found: pa.Table, tag: int) -> dict[int, bytes]:
    tags = found["tag"].to_pylist()
    return {r: x for r, x, t in zip(found["range"].to_pylist(), found["live"].to_pylist(), tags, strict=True) if t == tag}
