"""Variable-length integers of seven bits a byte, least first; the high bit says that more follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def encoded_size(value: Column) -> Column:
    """Bytes that a non-negative long takes: a seventh of its binary digits, rounded up."""
    return F.ceil(F.length(F.bin(value)) / 7).cast("int")


def encode(values: np.ndarray) -> bytes:
    """All values in a row. Negative ones are an error."""
    x = np.asarray(values, np.int64)
    if (x < 0).any():
        raise ValueError("values are non-negative")
    rest, planes, more = x.astype(np.uint64), [], []
    while True:
        planes.append((rest & np.uint64(0x7F)).astype(np.uint8))
        rest = rest >> np.uint64(7)
        more.append(rest > 0)
        if not (rest > 0).any():
            break
    used = np.stack([np.ones(len(x), bool), *more[:-1]], axis=1) if len(x) else np.empty((0, len(planes)), bool)
    data = np.stack([p | (m.astype(np.uint8) << 7) for p, m in zip(planes, more, strict=True)], axis=1)
    return data[used].tobytes()


def decode(data: bytes) -> np.ndarray:
    """The values of encode(). Truncated data and values beyond 63 bits are errors."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.int64)
    last = np.flatnonzero(b < 0x80)
    if not len(last) or last[-1] != len(b) - 1:
        raise ValueError("truncated data")
    start = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(start, last - start + 1)
    if place.max() > 8:
        raise ValueError("a value has more than 63 bits")
    return np.add.reduceat((b & 0x7F).astype(np.int64) << (7 * place), start)


def encode_edges(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> bytes:
    """Sorted arcs, sources as differences from the one before."""
    return encode(np.stack([np.diff(src, prepend=0), dst, weight], axis=1).ravel())


def decode_edges(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    d, dst, weight = decode(data).reshape(-1, 3).T
    return np.cumsum(d), dst, weight
