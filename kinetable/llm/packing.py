"""Compact byte strings of whole numbers, and hash buckets of arrays, for what tasks exchange."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

SHIFTS = range(7, 63, 7)


def varint(values: np.ndarray) -> bytes:
    """Non-negative numbers below 2^63, seven bits a byte, low bits first."""
    v = values.astype(np.int64)
    size = np.ones(len(v), np.int64)
    top = int(v.max(initial=0))
    for s in SHIFTS:
        if top < 1 << s:
            break
        size += v >= 1 << s
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        some = np.flatnonzero(size > k) if k else slice(None)
        out[at[some] + k] = (v[some] >> (7 * k)) & 127 | np.where(size[some] > k + 1, 128, 0)
    return out.tobytes()


def unvarint(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.append(0, ends[:-1] + 1)
    out = b[starts].astype(np.int64) & 127
    for k in range(1, int((ends - starts).max()) + 1):
        some = np.flatnonzero(ends - starts >= k)
        out[some] |= (b[starts[some] + k].astype(np.int64) & 127) << (7 * k)
    return out


def ascending(values: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return varint(np.diff(values.astype(np.int64), prepend=0))


def unascending(data: bytes) -> np.ndarray:
    return np.cumsum(unvarint(data))


def by_bucket(mixed: np.ndarray, buckets: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """Order that brings the buckets of mixed hashes together (stable), and (bucket, from, to) of those that occur."""
    bucket = (mixed >> np.uint64(20)) % np.uint64(buckets)
    bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    names, cuts = np.unique(bucket[order], return_index=True)
    return order, zip(names.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True)


def column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def runs(keys: np.ndarray) -> np.ndarray:
    """First places of equal neighbours."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def lengths(first: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(first, total))


def chained(parts: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def cut_at(values: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """Consecutive pieces of the given sizes."""
    ends = list(itertools.accumulate(sizes))
    return (values[e - n : e] for e, n in zip(ends, sizes, strict=True))


__all__ = ["varint", "unvarint", "ascending", "unascending", "by_bucket", "column", "runs", "lengths", "chained", "cut_at", "mix64"]
