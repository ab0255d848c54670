"""Exact top-k inner products by norm-bucketed retrieval.

1. Vectors become integers and are range-partitioned by falling length, ties by row, so equal lengths spread too.
   Within a range, runs of ``BUCKET`` vectors are buckets.
2. Every query gets a first threshold: its k-th score among the ``SEEDS`` longest vectors, a set of fixed size.
3. Queries go in blocks of about ``QUERY_BLOCK``, each broadcast to the ranges. A task serves only those that its vectors
   can: |q| times the longest reaches their threshold, which rises with what the task has found.
4. For a query and a bucket, the local cosine threshold is threshold / (|q| * bucket's longest). Over 1, the query is
   done with the range. From ``COORDINATE_FROM`` on, the query's largest coordinates bound those of a partner
   (coordinate pruning); below, vectors too short to reach the threshold go (length pruning).
5. Survivors are verified by exact integer products. Pruning has a slack for rounding, so it only ever keeps more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, shuffle_partitions, table

BUCKET, SEEDS, FOCUS = 1024, 2048, 6
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.35
#: Vectors of a range, about; queries that one broadcast holds, about.
RANGE_ROWS, QUERY_BLOCK = 32_768, 16_384
_SLACK = 1e-9
_EXACT = float(2**53)


def _quantise(scale: float):
    def run(batches):
        for batch in batches:
            vectors = [np.floor(scale * np.asarray(v, dtype=np.float64)) for v in batch.column(2).to_pylist()]
            norms = [float(np.sqrt((v * v).sum())) for v in vectors]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(norms, pa.float64()), pa.array([v.astype("<f8").tobytes() for v in vectors], pa.binary())],
                ["uid", "id", "norm", "v"],
            )

    return run


def stack(blobs) -> np.ndarray:
    """Rows of equal width: shorter vectors are filled with zeros."""
    rows = [np.frombuffer(b, "<f8") for b in blobs]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products; past 2**53 in Python integers, past 64 bits held at the ends of the range."""
    if not rows.size:
        return np.zeros(len(rows), dtype=np.int64)
    if np.abs(rows).max(initial=0) * np.abs(q).max(initial=0) * len(q) < _EXACT:
        return (rows @ q).astype(np.int64)
    ints = [int(x) for x in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(r, ints)), -(2**63)), 2**63 - 1) for r in rows], dtype=np.int64)


def _first_thresholds(seeds: list[tuple[int, bytes]], k: int):
    def run(batches):
        ids, rows = np.array([s[0] for s in seeds], dtype=np.int64), stack([s[1] for s in seeds])
        for batch in batches:
            qs, rows_ = align(stack(batch.column("v").to_pylist()), rows)
            out = []
            for uid, q in zip(batch.column("uid").to_pylist(), qs):
                scores = products(rows_[ids != uid], q)
                out.append(int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "threshold"])

    return run


def survivors(rows: np.ndarray, norms: np.ndarray, units: np.ndarray, q: np.ndarray, q_norm: float, threshold: float) -> np.ndarray | None:
    """Places in a bucket (by falling length) that may reach the threshold; None where no bucket after it can either."""
    if threshold <= 0 or q_norm == 0:
        return np.arange(len(rows))
    cosine = threshold / (q_norm * norms[0]) if norms[0] else np.inf
    if cosine > 1 + _SLACK:
        return None
    if cosine < COORDINATE_FROM:
        return np.arange(np.searchsorted(-norms, -(threshold / q_norm) * (1 - _SLACK), side="right"))
    unit = q / q_norm
    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
    cosine = min(cosine, 1.0)
    fits = np.ones(len(rows), dtype=bool)
    for f in focus:
        middle, spread = unit[f] * cosine, np.sqrt(max(0.0, (1 - cosine**2) * (1 - unit[f] ** 2)))
        column = units[:, f]
        # the partner's angle to q is at most acos(cosine); the bounds widen to the axis where it lies inside
        high = 1.0 if unit[f] >= cosine else middle + spread
        low = -1.0 if -unit[f] >= cosine else middle - spread
        fits &= (column <= high + 1e-6) & (column >= low - 1e-6)
    return np.flatnonzero(fits)


def _search(k: int, asks):
    """Candidates for the best of a task's vectors for each query of the block ``asks`` (a broadcast list of uid, norm, v, threshold)."""

    def run(batches):
        q_rows = stack([a[2] for a in asks.value])
        thresholds = [-np.inf if a[3] is None else float(a[3]) for a in asks.value]
        tops = [np.zeros(0, np.int64)] * len(thresholds)  # the k best scores of the task so far
        for batch in batches:
            if not batch.num_rows:
                continue
            norm, uid = batch.column("norm").to_numpy(), batch.column("uid").to_numpy()
            order = np.lexsort((uid, -norm))
            norms, uids = norm[order], uid[order]
            qs, rows = align(q_rows, stack(batch.column("v").to_pylist())[order])
            units = rows / np.where(norms == 0, 1, norms)[:, None]
            ids = batch.column("id").take(pa.array(order)).to_pandas().to_numpy()
            out = []
            for i, (q_uid, q_norm, _, _) in enumerate(asks.value):
                threshold = thresholds[i]
                if threshold > 0 and q_norm * norms[0] * (1 + _SLACK) < threshold:
                    continue
                scores, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for a in range(0, len(rows), BUCKET):
                    b = min(a + BUCKET, len(rows))
                    left = survivors(rows[a:b], norms[a:b], units[a:b], qs[i], q_norm, threshold)
                    if left is None:
                        break
                    left = left[uids[a:b][left] != q_uid] + a
                    got = products(rows[left], qs[i])
                    good = got >= threshold
                    scores, places = np.concatenate((scores, got[good])), np.concatenate((places, left[good]))
                    if len(scores) > k:
                        own = ids[places]
                        keep = np.lexsort((uids[places], pd.isna(own), np.where(pd.isna(own), 0, own), -scores))[:k]
                        scores, places = scores[keep], places[keep]
                    if len(scores) == k:
                        threshold = max(threshold, float(scores.min()))
                if len(scores):
                    out += zip([q_uid] * len(scores), uids[places].tolist(), scores.tolist())
                    tops[i] = np.sort(np.concatenate((tops[i], scores)))[-k:]
                    if len(tops[i]) == k:
                        thresholds[i] = max(thresholds[i], float(tops[i][0]))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64()) for j in range(3)], ["q_uid", "uid", "score"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, <id_col>, score``: for each row where ``is_query``, its k highest integer products with other rows.

    Components become floor(scale * x). Ties go to the smaller id, then to the earlier row; null ids come last. Vectors
    that are null, or hold null or non-finite components, take no part. Shorter vectors count as filled with zeros. Rows
    that repeat an id are rows of their own; only the query's own row is left out. Fewer than k other rows: all of them. An empty
    table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "top-k")
    x = F.col(vector_col)
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.filter(x.isNotNull() & whole).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), x.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    kind = rows.schema["id"].dataType.simpleString()
    packed = work.stage(
        rows.select("uid", F.struct("id", "q").alias("id"), "v").mapInArrow(_quantise(scale), f"uid long, id struct<id:{kind},q:boolean>, norm double, v binary").select("uid", "id.id", "id.q", "norm", "v"),
        "packed",
    )
    n = packed.count()
    parts = max(1, min(n, max(shuffle_partitions(spark), -(-n // RANGE_ROWS))))
    ranged = work.stage(packed.repartitionByRange(parts, F.desc("norm"), "uid").withColumn("range", F.spark_partition_id()), "ranged")
    seeds = [(r["uid"], bytes(r["v"])) for r in packed.orderBy(F.desc("norm"), "uid").limit(SEEDS).select("uid", "v").collect()]
    asks = work.stage(
        packed.filter("q").select("uid", "id", "norm", "v").mapInArrow(_first_thresholds(seeds, k), f"uid long, id {kind}, norm double, v binary, threshold long"), "asks"
    )
    blocks = max(1, -(-asks.count() // QUERY_BLOCK))
    for block in range(blocks):
        own = asks.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).select("uid", "norm", "v", "threshold").collect()
        sent = spark.sparkContext.broadcast([(r["uid"], r["norm"], bytes(r["v"]), r["threshold"]) for r in own])
        part = ranged.select("uid", "id", "norm", "v").mapInArrow(_search(k, sent), "q_uid long, uid long, score long")
        # k rows for each query and batch at most; those beyond the k best go before the tables of blocks are joined
        part = part.join(packed.select("uid", "id"), "uid") if blocks == 1 else work.stage(_first(part.join(packed.select("uid", "id"), "uid"), k), "found")
        found = part if block == 0 else found.unionByName(part)
    found = found if blocks > 1 else _first(found, k)
    return (
        found.join(asks.select(F.col("uid").alias("q_uid"), F.col("id").alias("query_id")), "q_uid")
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _first(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q_uid").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""
