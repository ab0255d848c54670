"""Golomb-Rice coding of sorted unsigned 64-bit integers, in numpy."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBQ")  # count, remainder bits, first value


def encode(values: np.ndarray) -> bytes:
    """values: strictly increasing uint64. The parameter follows the mean gap of this message."""
    n = len(values)
    if n == 0:
        return _HEAD.pack(0, 0, 0)
    gaps = np.diff(values) - np.uint64(1)
    mean = float(gaps.astype(np.float64).mean()) if n > 1 else 0.0
    k = max(0, min(63, int(np.floor(np.log2(max(mean * 0.6931, 1.0))))))
    head = _HEAD.pack(n, k, int(values[0]))
    if n == 1:
        return head
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    shifts = np.arange(k, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return head + struct.pack("<Q", len(unary)) + np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(blob: bytes) -> np.ndarray:
    n, k, first = _HEAD.unpack_from(blob)
    if n <= 1:
        return np.array([first][:n], dtype=np.uint64)
    at = _HEAD.size
    (bits,) = struct.unpack_from("<Q", blob, at)
    at += 8
    size = (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=bits)
    ends = np.flatnonzero(unary)
    quotient = np.diff(np.concatenate(([-1], ends))) - 1
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    if k:
        rest = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + size), count=(n - 1) * k).reshape(n - 1, k)
        gaps |= rest.astype(np.uint64) @ (np.uint64(1) << np.arange(k, dtype=np.uint64))
    return np.concatenate((np.array([first], np.uint64), np.uint64(first) + np.cumsum(gaps + np.uint64(1), dtype=np.uint64)))
