"""Exact duplicates by a Golomb-coded exchange of fingerprints.

1. One scan normalises each text and keeps (id, 64-bit fingerprint, SHA-256) in a staged table, in blocks of
   at most ``BLOCK`` rows of one input partition.
2. Each block sorts its distinct fingerprints and sends every owner (a range of the fingerprint space) one
   Golomb-Rice coded message, with a bit for each fingerprint that the block itself holds more than once.
   A text copied a million times is so at most one number for each block.
3. An owner decodes its messages and answers each block with a bitmap of the fingerprints that occur again.
4. Blocks mark their suspects. Only texts that pass a filter of the suspects' fingerprints are shuffled, and
   grouping on the text itself, with map-side partial aggregation, verifies them byte by byte.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb
from .common import WS, Workspace, shuffle_partitions, table, text_or_empty

#: Rows of a block, as a power of two: 8 MB of fingerprints.
BLOCK_BITS = 20
#: Bits of the suspects' filter for each of their fingerprints, and the least and the most bits in all, as powers of two.
#: At the most (32 MB) it fills up with the input; more texts are shuffled then, and the result stays the same.
BITS_EACH, FILTER_BITS = 16, (16, 28)


def owner_of(sorted_hashes: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold equal, ascending ranges of the upper 32 bits."""
    return ((sorted_hashes >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def _messages(owners: int):
    def send(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(rows["h"].to_numpy().view(np.uint64), return_counts=True)
        own = owner_of(values, owners)
        starts = np.flatnonzero(np.diff(own, prepend=np.uint64(owners)))
        out = []
        for a, b in zip(starts, [*starts[1:], len(values)]):
            out.append((int(own[a]), key[0], golomb.encode(values[a:b]), np.packbits(counts[a:b] > 1).tobytes()))
        return pd.DataFrame(out, columns=["owner", "block", "hashes", "again"])

    return send


def _answers(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    got = [golomb.decode(x) for x in rows["hashes"]]
    again = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(v)) for v, b in zip(got, rows["again"])]
    values, index, counts = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[index[np.concatenate(again) > 0]] = True
    bits, at = [], 0
    for v in got:
        bits.append(np.packbits(shared[index[at : at + len(v)]]).tobytes())
        at += len(v)
    return pd.DataFrame({"block": rows["block"], "owner": key[0], "n": [len(v) for v in got], "bits": bits})


def _mark(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    answers = answers.sort_values("owner")
    shared = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(answers["bits"], answers["n"])])
    values, index = np.unique(rows["h"].to_numpy().view(np.uint64), return_inverse=True)
    assert len(values) == len(shared), "the answers are not those of this block"
    return rows[["id", "h", "sha"]].assign(suspect=shared[index] > 0)


def _passes(suspects: DataFrame):
    """A Column over ``h``, true for every suspect's fingerprint: one bit of a scalar bitmap, sized by their number."""
    many = suspects.agg(F.approx_count_distinct("h")).first()[0]
    size = min(max(math.ceil(math.log2(BITS_EACH * max(many, 1))), FILTER_BITS[0]), FILTER_BITS[1])
    place = f"shiftrightunsigned(h, {64 - size})"
    bit = f"shiftleft(1L, cast({place} % 64 AS int))"
    words = suspects.groupBy(F.expr(f"shiftright({place}, 6)").alias("w")).agg(F.expr(f"bit_or({bit})").alias("bits"))
    every = suspects.sparkSession.range(1 << (size - 6)).join(F.broadcast(words), F.col("id") == F.col("w"), "left")
    bitmap = every.agg(F.expr("transform(array_sort(collect_list(struct(id, coalesce(bits, 0L) AS bits))), x -> x.bits)"))
    word = F.element_at(bitmap.scalar(), F.expr(f"cast(shiftright({place}, 6) + 1 AS int)"))
    return word.bitwiseAND(F.expr(bit)) != 0


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after each run of ASCII white space becomes one space; a null text counts
    as empty. Of equal texts the row with the smallest id is kept. Rows with a null id have the group's
    smallest id as ``keep_id`` and are kept only where the whole group has null ids. Rows that repeat an id with
    an equal text count each, and are all kept if that id is the smallest. Other columns are not read, so
    their names do not matter. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "exact-dedup")
    owners = owners or shuffle_partitions(spark)
    norm = F.regexp_replace(text_or_empty(text_col), WS, " ")
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
    prints = work.stage(
        texts.select(
            "id", F.xxhash64("norm").alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"),
        ),
        "prints",
    )
    messages = prints.select("block", "h").groupBy("block").applyInPandas(_messages(owners), "owner int, block long, hashes binary, again binary")
    answers = messages.groupBy("owner").applyInPandas(_answers, "block long, owner int, n int, bits binary")
    id_type = prints.schema["id"].dataType.simpleString()
    marked = work.stage(
        prints.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_mark, f"id {id_type}, h long, sha binary, suspect boolean"),
        "marked",
    )
    work.drop(prints)
    lone = marked.filter(~F.col("suspect")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    suspects = marked.filter("suspect")
    hashed = texts.withColumn("h", F.xxhash64("norm"))
    groups = (
        hashed.filter(_passes(suspects)).groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    again = suspects.join(work.stage(groups, "groups"), "sha").select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "sha"
    )
    out = lone.unionByName(again)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
