"""All pairs of vectors within groups: matrix products of blocks of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from .grouped import tasks

#: Rows of a block, about; a task holds the pairs of two.
BLOCK = 1024
#: Pairs in a batch of results, about.
BATCH = 65_536


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero."""
    scale = 10.0**digits
    return np.trunc(x * scale + np.copysign(0.5, x)) / scale + 0.0


def _pairs(digits: int):
    def run(batches):
        for table in _whole_nodes(batches):
            node = table.column("node").to_numpy()
            cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(node))):
                yield from _of_node(table.slice(a, b - a), digits)

    return run


def _of_node(part: pa.Table, digits: int):
    own, least = part.column("chunk").to_numpy(), part.column("least").to_numpy()[0]
    left = np.flatnonzero(own == least)
    alone = part.column("alone")[0].as_py()
    right = left if alone else np.flatnonzero(own != least)
    ids = part.column("id").combine_chunks()
    v = np.frombuffer(b"".join(part.column("v").to_pylist()), float).reshape(part.num_rows, -1)
    norm = (v * v).sum(axis=1)
    step = max(1, BATCH // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        i, j = (x.ravel() for x in np.meshgrid(some, right, indexing="ij"))
        dot = (v[some] @ v[right].T).ravel()
        if alone:
            up = i < j
            i, j, dot = i[up], j[up], dot[up]
        if not len(i):
            continue
        size = np.sqrt(norm[i]) * np.sqrt(norm[j])
        cos = np.divide(dot, size, out=np.zeros(len(dot)), where=size != 0)
        square = norm[i] + norm[j] - 2 * dot
        near = np.flatnonzero(square <= 1e-4 * (norm[i] + norm[j]))  # where the difference cancels
        square[near] = ((v[i[near]] - v[j[near]]) ** 2).sum(axis=1)
        angular = 1.0 - np.arccos(np.clip(cos, -1.0, 1.0)) / np.pi
        values = (pa.array(rounded(x, digits)) for x in (cos, angular, np.sqrt(np.maximum(square, 0.0))))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), *values], ["a", "b", "cosine", "angular", "euclid"])


def vector_pairs(rows: DataFrame, id_col: str, group: str, vector: str, digits: int = 4) -> DataFrame:
    """``id1, id2, cosine, angular, euclid`` of the rows of a group, id1 < id2, rounded.

    Rows are dealt into blocks by a hash of the id, and two blocks meet in a task. Vectors that are null, hold nulls or non-finite
    numbers, or differ from most in length are compared by expressions, with all others.
    """
    n = tasks(rows.sparkSession)
    x = rows.filter(F.col(id_col).isNotNull() & F.col(group).isNotNull()).select(F.col(id_col).alias("id"), F.col(group).alias("g"), F.col(vector).alias("v"))
    length = x.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    usual = F.lit(length["size"] if length else 0)
    fine = F.coalesce((F.size("v") == usual) & (usual > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < 1e150)), F.lit(False))
    plain, odd = x.filter(fine), x.filter(~fine)
    kind = x.schema["id"].dataType.simpleString()
    blocks = x.groupBy("g").agg(F.expr(f"cast(count(*) div {BLOCK} as int)").alias("last"))
    placed = plain.join(blocks, "g").withColumn("chunk", F.expr("cast(pmod(xxhash64(id, 5), last + 1) as int)"))
    met = placed.withColumn("other", F.explode(F.expr("sequence(0, last)"))).select(
        F.xxhash64("g", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("node"), F.least("chunk", "other").alias("least"), (F.col("chunk") == F.col("other")).alias("own"), "chunk", "id", "v")
    # rows of a block meet their own block's rows in a node of its own
    met = met.select(F.when(F.col("own"), F.xxhash64("node", F.lit(1))).otherwise(F.col("node")).alias("node"), "least", F.col("own").alias("alone"), "chunk", "id", F.col("v").cast("array<double>").alias("v"))
    packed = met.mapInArrow(_packed, f"node long, least int, alone boolean, chunk int, id {kind}, v binary")
    made = packed.repartition(n, "node").sortWithinPartitions("node").mapInArrow(_pairs(digits), f"a {kind}, b {kind}, cosine double, angular double, euclid double")
    swap = F.col("a") > F.col("b")
    out = made.filter("a <> b").select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("id1"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("id2"), "cosine", "angular", "euclid")
    if not odd.take(1):
        return out
    side = lambda t, s, odd_: t.select("g", F.col("id").alias(f"id{s}"), F.col("v").alias(f"v{s}"), F.lit(odd_).alias(f"odd{s}"))
    first, second = (side(plain, s, False).unionByName(side(odd, s, True)) for s in "12")
    rest = side(odd, "1", True).join(second, "g").unionByName(first.filter("NOT odd1").join(side(odd, "2", True), "g")).filter("id1 < id2")
    c = S.cosine(F.col("v1"), F.col("v2"))
    return out.unionByName(rest.select("id1", "id2", F.round(c, digits).alias("cosine"), F.round(S.angular(c), digits).alias("angular"), F.round(S.euclid(F.col("v1"), F.col("v2")), digits).alias("euclid")))


def _packed(batches):
    for b in batches:
        v = b.column("v")
        flat, n = v.flatten().to_numpy(zero_copy_only=False), b.num_rows
        raw = flat.reshape(n, -1) if n else flat.reshape(0, 1)
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([x.tobytes() for x in raw], pa.binary())], b.schema.names)


def _whole_nodes(batches):
    """Arrow tables that hold whole nodes; rows come sorted by node."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        node = rows.column("node").to_numpy()
        at = int(np.searchsorted(node, node[-1]))
        held = rows.slice(at)
        if at:
            yield rows.slice(0, at)
    if held is not None:
        yield held
