"""Bit vectors: packed 64-bit words in columns, or lists of set positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(positions: Column, m: int) -> list[Column]:
    """``ceil(m / 64)`` longs; position p is bit p % 64 of word p div 64. Built in the row, without a shuffle."""
    bit = lambda w: F.aggregate(
        F.filter(positions, lambda p: F.floor(p / 64) == w), F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int")))
    )
    return [bit(w) for w in range(-(-m // 64))]


def popcount(parts: list[Column]) -> Column:
    return sum((F.bit_count(p) for p in parts[1:]), F.bit_count(parts[0]))


def both(a: list[Column], b: list[Column]) -> Column:
    """Bits set in both vectors, unrolled over the words."""
    return popcount([x.bitwiseAND(y) for x, y in zip(a, b)])


def either(a: list[Column], b: list[Column]) -> Column:
    return popcount([x.bitwiseOR(y) for x, y in zip(a, b)])


def different(a: list[Column], b: list[Column]) -> Column:
    return popcount([x.bitwiseXOR(y) for x, y in zip(a, b)])


def same_size(m1: Column, m2: Column, value: Column) -> Column:
    """``value``; ends the query where the two vectors' lengths differ."""
    return F.when(m1 == m2, value).otherwise(F.raise_error(F.lit("bit vectors differ in length")))


def contains(positions: Column, asked: Column) -> Column:
    """Whether all positions of an element are set."""
    return F.size(F.array_except(asked, positions)) == 0


def halves(positions: Column, m: int) -> tuple[Column, Column]:
    """The two parts of a filter cut at round(m / 2), each counted from its own start."""
    cut = round(m / 2)
    return F.filter(positions, lambda p: p < cut), F.transform(F.filter(positions, lambda p: p >= cut), lambda p: (p - cut).cast("int"))


def fold(positions: Column, m: int) -> Column:
    """XOR of the two halves: positions modulo m / 2 that occur once. m is even."""
    if m % 2:
        raise ValueError("folding needs an even length")
    low, high = halves(positions, m)
    return F.array_sort(F.array_except(F.array_union(low, high), F.array_intersect(low, high)))


def rule90(positions: Column, m: int) -> Column:
    """Each bit becomes the XOR of its neighbours, in a circle."""
    shifted = lambda d: F.transform(positions, lambda p: F.pmod(p + d, F.lit(m)).cast("int"))
    left, right = shifted(1), shifted(-1)
    return F.array_sort(F.array_except(F.array_union(left, right), F.array_intersect(left, right)))


def balanced(positions: Column, m: int, order: list[int] | None = None) -> Column:
    """The filter followed by its complement, 2m bits of which m are set, then permuted: bit p goes to order[p]."""
    every = F.array_except(F.sequence(F.lit(0), F.lit(m - 1)), positions)
    out = F.concat(positions, F.transform(every, lambda p: (p + m).cast("int")))
    if order is not None:
        table = F.array(*[F.lit(i) for i in order])
        out = F.transform(out, lambda p: F.element_at(table, (p + 1).cast("int")))
    return F.array_sort(out)


def flipped(positions: Column, m: int, rate: float, key: Column, seed: int = 0) -> Column:
    """Every bit flips with probability rate / 2, decided by a hash of (key, bit, seed)."""
    limit = int(rate / 2 * (1 << 31))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: F.pmod(F.xxhash64(key, p, F.lit(seed)), F.lit(1 << 31)) < limit)
    return F.array_sort(F.array_except(F.array_union(positions, chosen), F.array_intersect(positions, chosen)))
