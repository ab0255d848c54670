"""Candidate groups of a similarity join: spanning links within nodes, and their split into groups one task can compare.

A join that goes through sketches first sends narrow rows to many nodes and wide ones (sets, texts) once, to the group of
rows that candidate links connect. Groups within the bounds are compared whole in a task; what is larger goes through nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, shuffle_partitions
from .components import components

#: One row of so many is counted to find nodes that a large share of all rows falls into.
SAMPLE = 64
#: Pairs of rows that are looked at in one step, about.
AT_ONCE = 65_536


def pairs_batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def by_node(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node", *more)


def whole_nodes(batches, key: str = "node"):
    """Arrow tables that hold whole nodes; rows come sorted by node."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        node = rows.column(key).to_numpy()
        cut = int(np.searchsorted(node, node[-1]))
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)
    if held is not None:
        yield held


def spanning(node: np.ndarray, rep: np.ndarray, near, at_once: int = AT_ONCE) -> list[tuple[int, int]]:
    """Pairs of rows that connect what ``near(i, j)`` (arrays of row numbers in, a mask out) connects within each node.

    Each connected group becomes a star around its row of smallest ``rep``: stars of several nodes merge in few steps.
    """
    n = len(node)
    group, members = np.arange(n), {}
    at, d, width = np.arange(n), 1, 1
    while True:
        left, right = [], []
        for _ in range(width):  # distances d to d + width - 1 at once; first 1, so that near neighbours join before others are looked at
            at = at[at + d < n]
            at = at[node[at] == node[at + d]]
            if not len(at):
                break
            apart = at[group[at] != group[at + d]]
            left.append(apart)
            right.append(apart + d)
            d += 1
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if len(i):
            hits = np.flatnonzero(near(i, j))
            for x, y in zip(i[hits].tolist(), j[hits].tolist()):
                a, b = int(group[x]), int(group[y])
                if a != b:
                    more, fewer = members.pop(a, [a]), members.pop(b, [b])
                    if len(more) < len(fewer):
                        a, b, more, fewer = b, a, fewer, more
                    group[fewer] = a
                    members[a] = more + fewer
        if not len(at):
            break
        width = max(1, min(2 * width, at_once // len(at)))
    found = []
    for rows in members.values():
        lead = min(rows, key=lambda i: rep[i])
        found += [(lead, i) for i in rows if i != lead]
    return found


def hot_nodes(sample: DataFrame, least: int) -> DataFrame:
    """``node, pivot`` of the nodes that hold more than a quarter of a partition's share, and about ``least`` rows at least.

    ``sample`` has the rows of every ``SAMPLE``-th document or line, so the list is at most four times as long as there
    are partitions. It only keeps such nodes from meeting in one task: what it misses is handled in the node's task.
    """
    counts = sample.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot"))
    total = sample.count()
    return counts.filter(F.col("n") >= max(least // SAMPLE, total // (4 * shuffle_partitions(sample.sparkSession)), 8)).select("node", "pivot")


def sampled(rows: DataFrame) -> DataFrame:
    return rows.filter(F.expr(f"pmod(xxhash64(rep), {SAMPLE}) = 0"))


def members_of(labels: DataFrame, weights: DataFrame, most: int, weight: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(``rep, grp`` of groups with at most ``most`` rows, ``weight`` in all and most * weight / 2 as product; those of larger ones).

    ``weights`` has ``rep, weight``.
    """
    rows = work.stage(labels.select("rep", F.col("label").alias("grp")).join(weights, "rep"), "members")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
    large = work.stage(sizes.filter(f"size > 1 AND (size > {most} OR weight > {weight} OR size * weight > {most * weight // 2})").select("grp", "size"), "large-groups")
    return rows.select("rep", "grp").join(large, "grp", "left_anti"), rows.select("rep", "grp").join(large, "grp")


def chunks_with_pivots(large: DataFrame, rows: int, pivots: int) -> DataFrame:
    """``node, rep, label``: the rows of large groups in random chunks of about ``rows``, and in each the same few rows as pivots."""
    chunk = F.expr(f"pmod(xxhash64(rep, 17), cast(size / {rows} AS int) + 1)")
    placed = large.select("grp", "rep", "size", chunk.alias("chunk"))
    heads = F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("rep", F.lit(29)).alias("h"), "rep"))), 1, pivots)
    # one row of each chunk is enough to choose from, so no group is gathered
    first = placed.groupBy("grp", "size", "chunk").agg(F.expr("min_by(rep, xxhash64(rep, 29))").alias("rep"))
    first = first.filter(F.expr(f"chunk < {pivots}")).groupBy("grp", "size").agg(heads.alias("heads"))
    spread = first.select("grp", "size", F.explode("heads.rep").alias("rep")).select("grp", "rep", F.explode(F.expr(f"sequence(0, cast(size / {rows} AS int))")).alias("chunk"))
    both = placed.select("grp", "rep", F.col("chunk").cast("long").alias("chunk")).unionByName(spread.select("grp", "rep", F.col("chunk").cast("long").alias("chunk"))).distinct()
    return both.select(F.xxhash64("grp", "chunk").alias("node"), "rep", F.col("rep").alias("label"))


def node_links(nodes: DataFrame, payload: DataFrame, labels: DataFrame | None, small_rows: int, levels: int, exhaustive, verify, branch, work: Workspace) -> DataFrame:
    """``rep, label`` after the links found in these staged nodes (``node, rep``) and those they branch into.

    Nodes of at most ``small_rows`` rows are compared by ``exhaustive`` (sorted by node) on ``payload`` (``rep`` and more); rows of a
    larger node are compared with a pivot by ``verify`` (the pivot's columns are named ``pivot_...``) and
    ``branch(rows, level, work)`` makes its children. Nodes of one label are done. After ``levels`` levels chunk pairs are compared.
    """
    stars = payload.select(F.col("rep").alias("pivot"), *(F.col(c).alias(f"pivot_{c}") for c in payload.columns if c != "rep"))
    for level in range(levels + 1):
        rows = labelled(nodes, labels)
        # few different pivots, so that trees which gather the same rows mostly compare the same pairs
        pivot = F.expr("min(struct(xxhash64(rep, node & 3), rep)).rep").alias("pivot")
        shared = rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(rep))").alias("who"), F.min("label").alias("l0"), F.max("label").alias("l1"), pivot
        ).filter("n > 1 AND l0 < l1")
        # trees that gather the same rows need one comparison
        shared = shared.groupBy("n", "who").agg(F.min(F.struct("node", "pivot")).alias("x")).select("n", "x.node", "x.pivot")
        live = work.stage(rows.join(shared, "node"), "live")
        work.drop(nodes)
        small, big = live.filter(F.col("n") <= small_rows).select("node", "rep", "label"), live.filter(F.col("n") > small_rows)
        last = not big.take(1)
        if level == levels and not last:
            small, last = small.unionByName(chunk_pairs(big, small_rows)), True
        found = by_node(small.join(payload, "rep"), "rep").mapInArrow(exhaustive, "a long, b long")
        if not last:
            pivots = big.filter("rep = pivot").select("node", F.col("label").alias("l"))
            pairs = big.join(pivots, "node").filter("label <> l").select("pivot", "rep").distinct()
            found = found.unionByName(pairs.join(payload, "rep").join(stars, "pivot").mapInArrow(verify, "a long, b long"))
        labels = contracted(work.stage(found.distinct(), "links"), labels, work)
        if last:
            work.drop(live)
            return labels
        again = work.stage(labelled(big.select("node", "n", "rep"), labels), "again")
        mixed = again.groupBy("node").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("node")
        nodes = branch(again.join(mixed, "node").select("node", "n", "rep"), level, work)
        work.drop(live, again)
    return labels


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows with the label of their ``rep``: itself where no link has reached it."""
    if labels is None:
        return rows.withColumn("label", F.col("rep"))
    return rows.join(labels.withColumnRenamed("label", "known"), "rep", "left").withColumn("label", F.coalesce("known", "rep")).drop("known")


def contracted(links: DataFrame, labels: DataFrame | None, work: Workspace) -> DataFrame:
    """``rep, label`` after new links (``a, b``): components run over labels, not over all links so far."""
    if labels is None:
        return work.stage(components(links, work).select(F.col("node").alias("rep"), F.col("root").alias("label")), "labels")
    a = labelled(links.select(F.col("a").alias("rep"), "b"), labels).select(F.col("label").alias("a"), F.col("b").alias("rep"))
    ends = work.stage(labelled(a, labels).select("a", F.col("label").alias("b")).filter("a <> b").distinct(), "ends")
    if not ends.take(1):
        return labels
    roots = work.stage(components(ends, work), "contracted")
    known = labels.unionByName(roots.select(F.col("node").alias("rep"), F.col("node").alias("label"))).groupBy("rep").agg(F.min("label").alias("label"))
    return work.stage(known.join(roots.withColumnRenamed("node", "label"), "label", "left").select("rep", F.coalesce("root", "label").alias("label")), "labels")


def chunk_pairs(large: DataFrame, most: int) -> DataFrame:
    """Rows of large nodes as the small nodes of all pairs of chunks of ``most / 2`` rows."""
    numbered = large.withColumn("chunk", F.expr(f"cast((row_number() OVER (PARTITION BY node ORDER BY rep) - 1) / {most // 2} AS int)"))
    last = f"cast((n - 1) / {most // 2} AS int)"
    return numbered.select(F.explode(F.expr(f"sequence(0, {last})")).alias("other"), "node", "rep", "label", "chunk").select(
        F.xxhash64("node", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("node"), "rep", "label"
    )
