"""Keys that every pair of sets above a similarity shares: parts of sets (after Arasu, Ganti and Kaushik, 2006).

Sets of sizes n and m with a Jaccard similarity of part / whole differ in at most (n + m)(whole - part) / (whole + part) values.
Values are dealt to so many parts by their hash that, whichever of them differ, ``spare`` + 1 parts of a similar pair hold the same
values. A key names a part and what it holds. Parts that are empty say nothing: they give no keys unless a set has more than
``spare`` of them, and then a similar pair shares a part with values in it, or both sets give keys for the empty ones.
The number of parts follows the size of the larger set of a pair, by levels; a set has keys for each level that it may
meet a larger one in. Sets of less than ``TINY`` values meet each other on their least values instead (prefix filter).
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .groups import by_node, whole_nodes
from .shingles import document_words, mix, shingle_set

TINY, RATIO, BINS = 64, 1.25, 256
#: Keys that a task holds before it sends them, and buckets for each partition.
AT_ONCE, BUCKETS = 2_000_000, 8
#: Bits of a set's digest that travel with its keys.
WHO_BITS = 48
_U = np.uint64


def most_apart(sizes, part: int, whole: int):
    """How many values similar sets of these sizes, in sum, may differ in."""
    return sizes * (whole - part) // (whole + part)


@functools.cache
def level(at: int, part: int, whole: int) -> tuple[int, int, int, int]:
    """(least size, size beyond the largest, parts, spare) of a level."""
    low = TINY
    for _ in range(at):
        low = math.ceil(low * RATIO)
    high, spare = math.ceil(low * RATIO), 0
    apart = most_apart(2 * (high - 1), part, whole)
    # as many spare ones as are empty in few sets of the least size that meets this level, as far as that ends
    while spare < apart // 2 + 1:
        parts = apart + 1 + spare
        empty = parts * math.exp(-low * part / whole / parts)
        if spare >= empty + 3 * math.sqrt(empty):
            break
        spare += 1
    return low, high, apart + 1 + spare, spare


def set_keys(values: np.ndarray, part: int, whole: int) -> np.ndarray:
    """The keys of a set of sorted uint64 hashes; two sets of at least this similarity share one."""
    n, out = len(values), []
    if not n:
        return values
    if n < TINY:
        out.append(mix(values[: n - -(-part * n // whole) + 1] ^ _U(0x510E527FADE682D1)))
    largest, at = n * whole // part, 0
    while (numbers := level(at, part, whole))[0] <= largest:
        low, high, parts, spare = numbers
        if n < high:
            place = ((mix(values + _U(at + 1)) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
            sums = np.zeros(parts, _U)
            np.add.at(sums, place, mix(values ^ _U(0x9B05688C2B3E6C1F)))
            count = np.bincount(place, minlength=parts)
            names = mix(np.arange(parts, dtype=_U) + _U((at + 1) << 32))
            some = count > 0
            if parts - some.sum() > spare:
                some[:] = True
            out.append(mix(sums + names)[some])
        at += 1
    return np.concatenate(out)


def bins(values: np.ndarray) -> np.ndarray:
    """How many values fall in each of ``BINS`` bins, 255 at most: in sum, those of two sets differ by no more than the sets."""
    return np.minimum(np.bincount((values >> _U(56)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def may_be_similar(sizes: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, part: int, whole: int) -> np.ndarray:
    """Which pairs sizes and bins let through; it lets every similar pair through."""
    out = whole * np.minimum(sizes[i], sizes[j]) >= part * np.maximum(sizes[i], sizes[j])
    at = np.flatnonzero(out)
    for a in range(0, len(at), 16_384):
        some = at[a : a + 16_384]
        x, y = i[some], j[some]
        apart = np.abs(table[x].astype(np.int16) - table[y].astype(np.int16)).sum(axis=1)
        out[some] = apart <= most_apart(sizes[x] + sizes[y], part, whole)
    return out


def _messages(size: int, part: int, whole: int, buckets: int):
    """``bucket, keys, who``: 32 bits of each key, and ``WHO_BITS`` of its set's digest in two parts, 4 bytes and 2."""

    def run(batches):
        held, count = [], 0

        def out():
            keys, who = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            bucket = (keys >> _U(32)) % _U(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, keys, who = bucket[order], keys[order].astype(np.uint32), who[order]
            low, high = who.astype(np.uint32), (who >> _U(32)).astype(np.uint16)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(cuts[1:], len(bucket))
            for a in range(0, len(cuts), 512):
                spans = list(zip(cuts[a : a + 512], ends[a : a + 512]))
                columns = [[x[i:j].tobytes() for i, j in spans] for x in (keys, low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[a : a + 512]].view(np.int64)), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "keys", "low", "high"])

        for batch in batches:
            for words in document_words(batch.column("text").to_pylist()):
                values = shingle_set(words, size)
                keys = set_keys(values, part, whole)
                if len(keys):
                    held.append((keys, np.full(len(keys), digest(values) & _U((1 << WHO_BITS) - 1))))
                    count += len(keys)
                if count >= AT_ONCE:
                    yield from out()
                    held, count = [], 0
        if held:
            yield from out()

    return run


def digest(values: np.ndarray) -> np.uint64:
    return values.sum(dtype=np.uint64)


def _met(batches):
    """``node, who`` of the keys that several sets have; keys that the same sets have give one node."""
    for rows in whole_nodes(batches, "bucket"):
        sizes = np.array([len(x) for x in rows.column("keys").to_pylist()]) // 4
        keys, low, high = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("keys", np.uint32), ("low", np.uint32), ("high", np.uint16)))
        _, bucket = np.unique(rows.column("bucket").to_numpy(), return_inverse=True)
        key = np.repeat(bucket.astype(_U), sizes) << _U(32) | keys
        order = np.argsort(key, kind="stable")
        key = key[order]
        again = key[1:] == key[:-1]
        order = order[np.append(again, False) | np.append(False, again)]
        key = np.repeat(bucket.astype(_U), sizes)[order] << _U(32) | keys[order]
        who = high[order].astype(_U) << _U(32) | low[order]
        order = np.lexsort((who, key))
        key, who = key[order], who[order]
        first = np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1]))[: len(key)]
        key, who = key[first], who[first]
        if not len(key):
            continue
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        counts = np.diff(np.append(cuts, len(key)))
        names = mix(np.add.reduceat(mix(who + _U(1)), cuts) + counts.astype(_U))
        _, once = np.unique(names, return_index=True)
        chosen = np.zeros(len(cuts), bool)
        chosen[once] = True
        chosen &= counts > 1
        keep = np.repeat(chosen, counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[chosen], counts[chosen]).view(np.int64)), pa.array(who[keep].view(np.int64))], ["node", "who"])


def meeting(texts: DataFrame, total: int, shingle_words: int, part: int, whole: int) -> DataFrame:
    """``node, who``: sets of ``texts`` (``text``) in nodes of which every similar pair of unlike sets shares one.

    ``who`` is the low ``WHO_BITS`` of a set's digest, ``total`` about how many values all sets hold.
    """
    buckets = BUCKETS * max(shuffle_partitions(texts.sparkSession), total // 10_000_000)
    sent = texts.mapInArrow(_messages(shingle_words, part, whole, buckets), "bucket long, keys binary, low binary, high binary")
    return by_node(sent.withColumnRenamed("bucket", "node")).withColumnRenamed("node", "bucket").mapInArrow(_met, "node long, who long").distinct()
