"""Compact binary columns for arrays that cross a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """An integer array as byte planes, compressed; planes of small numbers all but vanish."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return values.itemsize.to_bytes(1, "little") + len(values).to_bytes(8, "little") + (_CODEC.compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes, dtype) -> np.ndarray:
    size, count = data[0], int.from_bytes(data[1:9], "little")
    if not count:
        return np.zeros(0, dtype)
    planes = np.frombuffer(_CODEC.decompress(data[9:], size * count, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers, as differences."""
    return pack(np.diff(values, prepend=values[:1] * 0))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)
