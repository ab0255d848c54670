"""Encoding records as Bloom filters, record filters, tabulation and two-step hash codes."""

from __future__ import annotations

import hashlib
import math
import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.qgrams import ATTRIBUTE_PAD, RECORD_PAD, attribute_qgrams, qgram_list, qgram_set
from .blocking import hash_count


def mean_qgrams(df: DataFrame, qgrams: Column, mode: str = "all", order: str | None = None) -> float:
    """Mean set size; mode 'last_row' takes the last row's size by ``order`` instead."""
    if mode == "last_row":
        row = df.agg(F.max_by(F.size(qgrams), F.col(order)).alias("x")).first()
    else:
        row = df.agg(F.avg(F.size(qgrams)).alias("x")).first()
    return float(row["x"] or 0)


def encrypt(df: DataFrame, id_col: str, columns: list[str], m: int, q: int = 2, mode: str = "all", order: str | None = None) -> DataFrame:
    """``id, positions, k``: padded q-grams of the joined attributes under xxh64 seeds 0 to k-1; k fits m to the mean set size."""
    grams = qgram_list(F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), q, RECORD_PAD)
    k = hash_count(m, mean_qgrams(df, grams, mode, order))
    return df.select(F.col(id_col).alias("id"), hashing.filter_positions(grams, m, k, "xxh64").alias("positions"), F.lit(k).alias("k"))


@dataclass(frozen=True)
class AttributeSpec:
    """How one attribute is encoded; salt names a column whose value is appended to each q-gram."""

    column: str
    q: int = 2
    padded: bool = False
    method: str = "double"
    m: int = 200
    k: int = 10
    salt: str | None = None


def attribute_filter(spec: AttributeSpec) -> Column:
    value = F.lower(F.trim(F.coalesce(F.col(spec.column).cast("string"), F.lit(""))))
    salt = F.coalesce(F.col(spec.salt).cast("string"), F.lit("")) if spec.salt else None
    return hashing.filter_positions(qgram_set(value, spec.q, ATTRIBUTE_PAD if spec.padded else None), spec.m, spec.k, spec.method, salt)


def clk(specs: list[AttributeSpec]) -> Column:
    """One filter for all attributes: the union of their positions. All have the same length."""
    if len({s.m for s in specs}) != 1:
        raise ValueError("all attribute filters need the same length")
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[attribute_filter(s) for s in specs]))))


def dynamic_length(mean: float, k: int, fill: float = 0.5) -> int:
    """Filter length at which ``mean`` q-grams under k hashes set a share ``fill`` of the bits."""
    return round(1 / (1 - fill ** (1 / (k * mean))))


def attribute_means(df: DataFrame, columns: list[str], q: int = 2) -> dict[str, float]:
    row = df.agg(*[F.avg(F.size(qgram_set(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))), q))).alias(c) for c in columns]).first()
    return {c: float(row[c] or 0) for c in columns}


def record_map(lengths: list[int], bits: list[int], seed: int = 42) -> list[tuple[int, int]]:
    """(attribute, position) behind each bit of a record filter: bits sampled from each attribute, then permuted.

    Where an attribute's filter is shorter than its share, all its bits are taken, and the rest drawn again from them.
    """
    out: list[tuple[int, int]] = []
    for i, (length, n) in enumerate(zip(lengths, bits, strict=True)):
        source = random.Random(i)
        chosen = source.sample(range(length), n) if length >= n else [*range(length), *(source.randrange(length) for _ in range(n - length))]
        out += [(i, p) for p in chosen]
    random.Random(seed).shuffle(out)
    return out


def record_filter(specs: list[AttributeSpec], bits: list[int], seed: int = 42) -> Column:
    """Record-level filter: a fixed gather of the attribute filters' bits."""
    own = [attribute_filter(s) for s in specs]
    chosen = record_map([s.m for s in specs], bits, seed)
    tables = [F.map_from_entries(F.array(*[F.struct(F.lit(p), F.array(*[F.lit(t) for t, (b, q) in enumerate(chosen) if (b, q) == (a, p)])) for p in sorted({q for b, q in chosen if b == a})])) for a in range(len(specs))]
    gather = lambda positions, t: F.flatten(F.filter(F.transform(positions, lambda p: F.try_element_at(t, p)), lambda x: x.isNotNull()))
    parts = [gather(positions, t) for positions, t in zip(own, tables)]
    return F.array_sort(F.flatten(F.array(*parts)))


def random_hash_filter(df: DataFrame, id_col: str, qgrams: str, m: int, k: int) -> DataFrame:
    """``id, positions`` by random hashing: distinct q-grams are hashed once, then joined back."""
    each = df.select(F.col(id_col).alias("id"), F.explode_outer(qgrams).alias("qgram"))
    table = hashing.random_hash_table(each, m, k)
    joined = each.join(table, "qgram", "left").groupBy("id").agg(F.flatten(F.collect_set("positions")).alias("p"))
    return joined.select("id", F.array_sort(F.array_distinct("p")).alias("positions"))


def _tab_values(q: str, bits: int, tables: int, key_bits: int, seed: int) -> list[int]:
    """For each output bit, the XOR of one random value per slice of the q-gram's SHA-256."""
    whole = int(hashlib.sha256(q.encode()).hexdigest(), 16)
    keys = [(whole >> (key_bits * t)) & ((1 << key_bits) - 1) for t in range(tables)]
    out = []
    for b in range(bits):
        value = 0
        for t, key in enumerate(keys):
            value ^= int.from_bytes(hashlib.blake2b(f"{seed}:{b}:{t}:{key}".encode(), digest_size=8).digest(), "little")
        out.append(value - (1 << 64) if value >> 63 else value)
    return out


def tab_minhash(df: DataFrame, id_col: str, qgrams: str, bits: int = 200, tables: int = 8, key_bits: int = 8, seed: int = 42) -> DataFrame:
    """``id, positions``: for each output bit the least (unsigned) tabulation value over the q-grams gives its last bit."""
    each = df.select(F.col(id_col).alias("id"), F.explode(qgrams).alias("qgram"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"qgram": pdf["qgram"], "v": [_tab_values(q, bits, tables, key_bits, seed) for q in pdf["qgram"]]})

    values = each.select("qgram").distinct().mapInPandas(run, "qgram string, v array<long>")
    least = each.join(values, "qgram").select("id", F.posexplode("v").alias("bit", "v")).groupBy("id", "bit").agg(F.min(F.col("v").bitwiseXOR(F.lit(-(2**63)))).alias("v"))
    return least.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("v").bitwiseAND(F.lit(1)) == 1, F.col("bit")))).alias("positions"))


def _rows_of(q: str, rows: int, columns: int) -> list[int]:
    """The column that a q-gram sets in each of the rows."""
    source = random.Random(int(hashlib.sha1(q.encode()).hexdigest(), 16))
    return [source.randrange(columns) for _ in range(rows)]


def two_step_hash(df: DataFrame, id_col: str, qgrams: str, rows: int = 15, columns: int = 1000, mode: str = "png", bits: int = 32) -> DataFrame:
    """``id, codes``: q-grams set a bit in one column of each row; every column that isn't empty becomes an integer.

    mode 'png' draws from a range of the column's own, 'mod' takes SHA-1 of bit string and column modulo 2**bits.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for grams in pdf["q"]:
                matrix: dict[int, int] = {}
                for q in sorted(set(grams)):
                    for r, c in enumerate(_rows_of(q, rows, columns)):
                        matrix[c] = matrix.get(c, 0) | 1 << r
                codes = set()
                for c, word in matrix.items():
                    text = f"{word:0{rows}b}"[::-1] + str(c)
                    number = int(hashlib.sha1(text.encode()).hexdigest(), 16)
                    width = (1 << bits) // columns
                    codes.add(number % (1 << bits) if mode == "mod" else random.Random(number).randint(c * width, (c + 1) * width - 1))
                out.append(sorted(codes))
            yield pd.DataFrame({"id": pdf["id"], "codes": out})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(qgrams).alias("q")).mapInPandas(run, f"id {kind}, codes array<long>")


def two_step_mod(qgrams: Column, rows: int, columns: int, m: int) -> Column:
    """A two-step code in expressions alone: the column of row r is SHA-1 of q-gram and r, the code MD5 of column and rows modulo m."""
    hits = F.flatten(F.transform(qgrams, lambda q: F.array(*[F.struct(hashing.digest_mod(F.concat(q, F.lit(f"#{r}")), "sha1", columns).alias("c"), F.lit(r).alias("r")) for r in range(rows)])))

    def coded(cells: Column) -> Column:
        chosen = F.array_distinct(F.transform(cells, lambda x: x["c"]))
        word = lambda c: F.array_join(F.transform(F.filter(cells, lambda x: x["c"] == c), lambda x: x["r"].cast("string")), ",")
        return F.transform(chosen, lambda c: F.array_join(F.array(c.cast("string"), word(c)), ":"))

    # variables of functions over lists of one are computed once: what is merely named is computed wherever the name stands
    words = F.transform(F.array(F.array_sort(F.array_distinct(hits))), coded)[0]
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: _hex_mod(hashing.digest(w, "md5"), 32, m))))


def _hex_mod(text: Column, digits: int, m: int) -> Column:
    """A hex number modulo m, by eight digits at a time, with ``text`` computed once."""
    parts = F.transform(F.array(text), lambda t: F.array(*[F.conv(F.substring(t, a, 8), 16, 10).cast("long") for a in range(1, digits, 8)]))[0]
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: (s * ((1 << 32) % m) + x) % m)


@dataclass(frozen=True)
class EncodeSpec:
    """kind: 'clk', 'rbf', 'rbf-d', 'random', 'tab' or 'two-step'."""

    kind: str
    columns: tuple[str, ...]
    q: int = 2
    padded: bool = False
    method: str = "double"
    m: int = 200
    k: int = 10
    mode: str = "png"


def encode(df: DataFrame, id_col: str, spec: EncodeSpec) -> DataFrame:
    """``id`` and the code (``positions`` or ``codes``) of each record; equal records are encoded once where Python does it."""
    columns = list(spec.columns)
    own = [AttributeSpec(c, spec.q, spec.padded, spec.method, spec.m, spec.k) for c in columns]
    if spec.kind == "clk":
        return df.select(F.col(id_col).alias("id"), clk(own).alias("positions"))
    if spec.kind in ("rbf", "rbf-d"):
        if spec.kind == "rbf-d":
            means = attribute_means(df, columns, spec.q)
            own = [AttributeSpec(c, spec.q, spec.padded, spec.method, max(8, dynamic_length(max(means[c], 1.0), spec.k)), spec.k) for c in columns]
        share = [spec.m // len(own) + (i < spec.m % len(own)) for i in range(len(own))]
        return df.select(F.col(id_col).alias("id"), record_filter(own, share).alias("positions"))
    grams = df.select(F.col(id_col).alias("__id"), attribute_qgrams([F.col(c) for c in columns], spec.q, ATTRIBUTE_PAD if spec.padded else None).alias("q"))
    keyed = grams.withColumn("key", F.array_join(F.array_sort("q"), "|"))
    distinct = keyed.groupBy("key").agg(F.first("q").alias("q"))
    if spec.kind == "random":
        codes = random_hash_filter(distinct, "key", "q", spec.m, spec.k)
    elif spec.kind == "tab":
        codes = tab_minhash(distinct, "key", "q", spec.m)
    elif spec.kind == "two-step":
        codes = two_step_hash(distinct, "key", "q", spec.k, spec.m, spec.mode)
    else:
        raise ValueError(f"unknown encoding {spec.kind!r}")
    return keyed.select("__id", "key").join(codes.withColumnRenamed("id", "key"), "key").withColumnRenamed("__id", "id").drop("key")


def optimal_hashes(m: int, mean: float) -> int:
    return round(m / mean * math.log(2))


def permutation(n: int, seed: int) -> list[int]:
    return [int(i) for i in np.random.default_rng(seed).permutation(n)]
