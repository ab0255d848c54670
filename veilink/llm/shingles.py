"""Word hashes and shingle sets of whole texts, over their UTF-8 bytes in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Bytes hashed at once; a longer text is hashed alone.
CHUNK = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n uint64 numbers of the SplitMix64 sequence of this seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTER = seeded(256, 1)
_LETTER[_SPACE] = 0
_LETTER_LOWER = _LETTER[_LOWER]
_POWERS = np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64)
_POWERS[0] = 1
_POWERS = np.cumprod(_POWERS, dtype=np.uint64)


def word_hashes(blob: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word, a run of bytes other than ASCII white space; A-Z count as a-z."""
    b = np.frombuffer(blob, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[b]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    at = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    values = (_LETTER_LOWER if lower else _LETTER)[b[starts[0] :]] * _POWERS[at & 4095]
    if len(at) and at.max() > 4095:
        values = mix(values + (at >> 12).astype(np.uint64) * (values != 0))
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def _grouped(texts: list[str]):
    """(number of the first text, UTF-8 texts) in groups of about CHUNK bytes."""
    group, size, first = [], 0, 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass")
        if group and size + len(raw) > CHUNK:
            yield first, group
            group, size, first = [], 0, i
        group.append(raw)
        size += len(raw)
    if group:
        yield first, group


def document_words(texts: list[str]):
    """The array of word hashes of each text, in order."""
    for _, group in _grouped(texts):
        starts, hashes = word_hashes(b" ".join(group))
        ends = np.cumsum([len(g) + 1 for g in group])
        cuts = np.searchsorted(starts, ends)
        a = 0
        for c in cuts:
            yield hashes[a:c]
            a = c


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of fewer words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(n, size)
    odd = seeded(size, 2) | _U(1)
    total = np.full(n - k + 1, k, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)
    for j in range(k):
        total += words[j : n - k + 1 + j] * odd[j]
    return np.unique(mix(total))


def signature(values: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """uint32 minwise values of a set, one for each multiplier."""
    out = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(values), 4096):
        np.minimum(out, (values[a : a + 4096, None] * odd).min(axis=0), out=out)
    return (out >> _U(32)).astype(np.uint32)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
