"""Hash families over q-grams: seeded xxh64, wide-digest moduli, double, enhanced double and triple hashing, random hashing."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The constants of the XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_M = (1 << 64) - 1


def _rotr(x: int, r: int) -> int:
    return ((x >> r) | (x << (64 - r))) & _M


def seed_constant(seed: int) -> int:
    """The long c with ``xxhash64(c) = seed`` in Spark, so that ``xxhash64(c, s)`` is xxh64 of s with that seed.

    Spark chains columns: the first one's hash seeds the second. Its hash of a long is a bijection, inverted here.
    """
    h = seed & _M
    h ^= h >> 32
    h = h * pow(_P3, -1, 1 << 64) & _M
    h ^= h >> 29 ^ h >> 58
    h = h * pow(_P2, -1, 1 << 64) & _M
    h ^= h >> 33
    h = _rotr((h - _P4) * pow(_P1, -1, 1 << 64) & _M, 27)
    h ^= (42 + _P5 + 8) & _M
    c = _rotr(h * pow(_P1, -1, 1 << 64) & _M, 31) * pow(_P2, -1, 1 << 64) & _M
    return c - (1 << 64) if c >> 63 else c


def xxh64(value: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed_constant(seed)).cast("long"), value)


def unsigned_mod(h: Column, m: int) -> Column:
    """h, read as unsigned 64-bit, modulo m."""
    return F.pmod(F.pmod(h, F.lit(m)) + F.when(h < 0, F.lit((1 << 64) % m)).otherwise(F.lit(0)), F.lit(m)).cast("int")


def xxh64_positions(value: Column, m: int, k: int) -> Column:
    """Positions of seeds 0 to k-1."""
    return F.array(*[unsigned_mod(xxh64(value, i), m) for i in range(k)])


_DIGITS = {"md5": 32, "sha1": 40, "sha224": 56, "sha256": 64}


def digest(value: Column, name: str) -> Column:
    data = value.cast("binary")
    return {"md5": F.md5, "sha1": F.sha1, "sha224": lambda v: F.sha2(v, 224), "sha256": lambda v: F.sha2(v, 256)}[name](data)


def digest_mod(value: Column, name: str, m: int) -> Column:
    """A digest, read as a big integer, modulo m, by eight hex digits at a time."""
    text, out = digest(value, name), F.lit(0).cast("long")
    for a in range(1, _DIGITS[name], 8):
        out = (out * ((1 << 32) % m) + F.conv(F.substring(text, a, 8), 16, 10).cast("long")) % m
    return out


def hash_positions(value: Column, m: int, k: int, method: str = "double", names: tuple[str, ...] = ("sha1", "md5", "sha224")) -> Column:
    """Positions for i = 1 to k: h1 + i h2; enhanced adds (i^3 - i) / 6; triple adds i (i - 1) / 2 h3; all modulo m."""
    h = [digest_mod(value, n, m) for n in names[: 3 if method == "triple" else 2]]
    out = []
    for i in range(1, k + 1):
        at = h[0] + i * h[1]
        if method == "enhanced":
            at = at + (i**3 - i) // 6
        elif method == "triple":
            at = at + i * (i - 1) // 2 * h[2]
        elif method != "double":
            raise ValueError(f"unknown hash method {method!r}")
        out.append((at % m).cast("int"))
    return F.array(*out)


def filter_positions(qgrams: Column, m: int, k: int, method: str = "double", salt: Column | None = None) -> Column:
    """Sorted distinct positions of a whole q-gram set: its Bloom filter as a list."""
    at = (lambda q: xxh64_positions(q, m, k)) if method == "xxh64" else (lambda q: hash_positions(q, m, k, method))
    salted = (lambda q: F.concat(q, salt)) if salt is not None else (lambda q: q)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(qgrams, lambda q: at(salted(q))))))


def random_positions(value: str, m: int, k: int, name: str = "sha1") -> list[int]:
    """k draws from 0 to m-1 of a Mersenne twister seeded by the digest; draws may repeat."""
    source = random.Random(int(hashlib.new(name, value.encode()).hexdigest(), 16))
    return [source.randint(0, m - 1) for _ in range(k)]


def random_hash_table(qgrams: DataFrame, m: int, k: int, name: str = "sha1") -> DataFrame:
    """``qgram, positions`` for the distinct q-grams of a column ``qgram``: each is seeded once, in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([random_positions(q, m, k, name) for q in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["qgram", "positions"]
            )

    return qgrams.select("qgram").filter("qgram IS NOT NULL").distinct().mapInArrow(run, "qgram string, positions array<int>")
