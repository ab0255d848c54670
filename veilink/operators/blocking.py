"""Block keys, candidate pairs and locality-sensitive hashing."""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import prefix_key, soundex_variant

#: A prime just over 2**32, the modulus of the min-hash family.
MINHASH_PRIME = 4294967311


def prefix_blocks(df: DataFrame, columns: list[str], n: int, name: str = "blk_key") -> DataFrame:
    return df.withColumn(name, prefix_key([F.col(c) for c in columns], n))


def soundex_blocks(df: DataFrame, columns: list[str], name: str = "blk_key") -> DataFrame:
    return df.withColumn(name, F.concat(*[soundex_variant(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]))


def candidate_pairs(a: DataFrame, b: DataFrame, id_a: str, id_b: str, key: str = "blk_key") -> DataFrame:
    """``id1, id2`` of rows that share a block key; empty keys join, null keys don't."""
    return a.select(F.col(id_a).alias("id1"), key).join(b.select(F.col(id_b).alias("id2"), key), key).select("id1", "id2")


def self_pairs(blocks: DataFrame, node: str = "node", key: str = "blk_key") -> DataFrame:
    """``node1 < node2`` for every pair that shares a block, once, whatever the number of shared blocks."""
    x, y = blocks.select(F.col(node).alias("node1"), key), blocks.select(F.col(node).alias("node2"), key)
    return x.join(y, key).filter("node1 < node2").select("node1", "node2").distinct()


def block_statistics(blocks: DataFrame, key: str = "blk_key") -> DataFrame:
    """One row: number of blocks, their least, mean, median and largest size, pairs within blocks and the reduction against all pairs."""
    sizes = blocks.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("blocks"), F.min("n").alias("least"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("largest"),
        F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"), F.sum("n").alias("rows"),
    ).withColumn("reduction", F.when(F.col("rows") > 1, 1.0 - F.col("pairs") / (F.col("rows") * (F.col("rows") - 1) / 2.0)).otherwise(0.0))


@functools.lru_cache
def minhash_coefficients(n: int, seed: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    source = random.Random(seed)
    return tuple(tuple(sorted(source.sample(range(2**31), n))) for _ in range(2))


def minhash_signature(qgrams: Column, n: int, seed: int = 42) -> Column:
    """n minima of (a x + b) mod prime over the q-grams' CRC-32; null for an empty set."""
    a, b = minhash_coefficients(n, seed)
    x = F.transform(qgrams, lambda q: F.crc32(q.cast("binary")))
    least = lambda i: F.array_min(F.transform(x, lambda v: (v * a[i] + b[i]) % MINHASH_PRIME))
    return F.when(F.size(qgrams) > 0, F.array(*[least(i) for i in range(n)]))


def minhash_blocks(df: DataFrame, node: str, qgrams: str, band: int = 4, bands: int = 50, seed: int = 42, merge_bands: bool = False) -> DataFrame:
    """``blk_key, node``, a row for each band. merge_bands: equal tuples of different bands are one block."""
    signature = df.select(F.col(node).alias("node"), minhash_signature(F.col(qgrams), band * bands, seed).alias("s")).filter("s IS NOT NULL")
    parts = F.array(*[F.array_join(F.slice("s", 1 + i * band, band).cast("array<string>"), "-") for i in range(bands)])
    each = signature.select("node", F.posexplode(parts).alias("band", "key"))
    key = F.col("key") if merge_bands else F.concat_ws(":", "band", "key")
    return each.select(key.alias("blk_key"), "node").distinct()


def minhash_curve(s: float, band: int, bands: int) -> float:
    """Probability that sets of similarity s share a block."""
    return 1 - (1 - s**band) ** bands


def minhash_threshold(band: int, bands: int) -> float:
    return (1 / bands) ** (1 / band)


def sample_positions(m: int, size: int, number: int, seed: int = 42) -> list[list[int]]:
    source = random.Random(seed)
    return [sorted(source.sample(range(m), size)) for _ in range(number)]


def hamming_blocks(df: DataFrame, node: str, positions: str, samples: list[list[int]]) -> DataFrame:
    """``blk_key, node``: for each sample, its number and the filter's bits there. ``positions`` lists the set bits."""
    has = lambda p: F.array_contains(positions, p).cast("int").cast("string")
    keys = [F.concat(F.lit(f"{i}:"), *[has(p) for p in sample]) for i, sample in enumerate(samples)]
    return df.select(F.explode(F.array(*keys)).alias("blk_key"), F.col(node).alias("node"))


def shared_blocks(a: DataFrame, b: DataFrame, key: str = "blk_key") -> DataFrame:
    """``node1, node2`` of two block tables: keys that only one side holds give nothing."""
    return a.select(F.col("node").alias("node1"), key).join(b.select(F.col("node").alias("node2"), key), key).select("node1", "node2").distinct()


def hyperplanes(dimensions: int, n: int, seed: int = 42) -> list[list[float]]:
    source = random.Random(seed)
    return [[source.gauss(0, 1) for _ in range(dimensions)] for _ in range(n)]


def simhash_bits(features: list[Column], planes: list[list[float]]) -> Column:
    """Sorted positions of the bits that are set: bit i says whether the dot product with plane i is at least 0."""
    bits = []
    for i, plane in enumerate(planes):
        total = functools.reduce(lambda x, y: x + y, [f * w for f, w in zip(features, plane)])
        bits.append(F.when(total >= 0, F.lit(i)))
    return F.array_compact(F.array(*bits))


def blocks_by(df: DataFrame, method: str, node: str, columns: list[str], qgrams: str = "qgrams", positions: str = "positions", m: int = 0, prefix: int = 2) -> DataFrame:
    """``blk_key, node`` by 'prefix', 'soundex', 'minhash', 'hamming' (4 bits, 70 samples) or 'none' (one block)."""
    if method == "prefix":
        return prefix_blocks(df, columns, prefix).select("blk_key", F.col(node).alias("node"))
    if method == "soundex":
        return soundex_blocks(df, columns).select("blk_key", F.col(node).alias("node"))
    if method == "minhash":
        return minhash_blocks(df, node, qgrams)
    if method == "hamming":
        return hamming_blocks(df, node, positions, sample_positions(m, 4, 70))
    if method == "none":
        return df.select(F.lit("all").alias("blk_key"), F.col(node).alias("node"))
    raise ValueError(f"unknown blocking method {method!r}")


def pair_completeness(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: gold pairs, those among the candidates, and their share."""
    found = gold.select("id1", "id2").distinct().join(candidates.select("id1", "id2").distinct().withColumn("hit", F.lit(1)), ["id1", "id2"], "left")
    return found.agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("found")).withColumn("completeness", F.when(F.col("gold") > 0, F.col("found") / F.col("gold")).otherwise(0.0))


def hash_count(m: int, mean_qgrams: float) -> int:
    """round(ln 2 * m / mean), halves to even, at least 1."""
    return max(1, round(math.log(2) * m / mean_qgrams)) if mean_qgrams else 1
