"""Similarity graphs: nodes, edges, overlap, components and node features.

Edges are ``src < dst, sim``. Nodes without edges appear only in the node table.
"""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grouped import chunked, tasks


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that ``spark.checkpoint.dir`` names; one of this process where it is unset."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="veilink-"))
    return df.checkpoint()


def graph_nodes(records: DataFrame, node: str, ent_id: str, values: str) -> DataFrame:
    """``node, ent_ids, org_vals, freq``: records of one node key together, sorted."""
    return records.groupBy(F.col(node).alias("node")).agg(
        F.array_sort(F.collect_set(F.col(ent_id).cast("string"))).alias("ent_ids"), F.array_sort(F.collect_set(values)).alias("org_vals")
    ).withColumn("freq", F.size("ent_ids"))


def add_edges(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair; of several similarities the highest."""
    return edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("sim").alias("sim"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "sim").unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "sim"))


def without_singletons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(both_ways(edges).select(F.col("u").alias("node")).distinct(), "node", "left_semi")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node each node reaches, by grouped minima over links and pointers."""
    links = cut(both_ways(edges).select("u", "v").distinct())
    label = cut(links.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = links.join(label.withColumnsRenamed({"node": "v", "component": "c"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c"))
        lower = label.join(near, "node").select("node", F.least("component", "c").alias("component"))
        jump = lower.join(label.toDF("component", "up"), "component").select("node", F.least("component", "up").alias("component"))
        after = cut(jump)
        moved = after.join(label.withColumnRenamed("component", "before"), "node").filter("component <> before").limit(1).count()
        label = after
        if not moved:
            return label


def without_small_components(edges: DataFrame, least: int) -> DataFrame:
    label = connected_components(edges)
    big = label.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return edges.join(label.join(big, "component").select(F.col("node").alias("src")), "src", "left_semi")


def edge_overlap(plain: DataFrame, encoded: DataFrame) -> DataFrame:
    """One row: edges of both graphs, of the plain one alone and of the encoded one alone."""
    both = plain.select("src", "dst", F.lit(1).alias("p")).join(encoded.select("src", "dst", F.lit(1).alias("e")), ["src", "dst"], "full_outer")
    return both.agg(F.count_if(F.col("p").isNotNull() & F.col("e").isNotNull()).alias("common"), F.count_if(F.col("e").isNull()).alias("plain_only"), F.count_if(F.col("p").isNull()).alias("encoded_only"))


def entity_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between entities: every pair of the two nodes' entity ids, smaller id first."""
    part = lambda name: nodes.select("node", chunked("ent_ids", name, 1024))
    x = edges.join(part("a").withColumnRenamed("node", "src"), "src").join(part("b").withColumnRenamed("node", "dst"), "dst").select("a", "b", "sim")
    # few edges may hold all pairs: parts of both nodes' ids are dealt out before they expand
    kind = edges.schema["sim"].dataType.simpleString()
    return x.repartition(tasks(edges.sparkSession)).mapInArrow(_products, f"src string, dst string, sim {kind}")


def _products(batches):
    """Every pair of an id of list ``a`` and one of ``b``, smaller first, in Arrow batches: comparisons are those of ranks."""
    for batch in batches:
        for a, b, sim in zip(*batch.columns):
            if not a.is_valid or not b.is_valid:
                continue
            ids = pa.concat_arrays([a.values, b.values])
            names = ids.to_pylist()
            order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)  # by code points, as UTF-8 sorts
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            ids, left, right = ids.take(pa.array(order)), rank[: len(a.values)], rank[len(a.values) :]
            step = max(1, 65_536 // max(1, len(right)))
            for k in range(0, len(left), step):
                i, j = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
                ends = [ids.take(pa.array(f(i, j))) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([*ends, pa.repeat(sim, len(i))], ["src", "dst", "sim"])


def common_values(a: DataFrame, b: DataFrame) -> DataFrame:
    """``value, node_a, node_b`` of nodes whose first original value, joined by spaces, is the same; the least node of each counts."""
    first = lambda n, name: n.select(F.array_join(F.element_at("org_vals", 1), " ").alias("value"), "node").groupBy("value").agg(F.min("node").alias(name))
    return first(a, "node_a").join(first(b, "node_b"), "value")


def difference_statistics(plain: DataFrame, encoded: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold: least, mean, deviation, median and largest plain - encoded similarity of edges where either reaches it."""
    both = plain.withColumnRenamed("sim", "p").join(encoded.withColumnRenamed("sim", "e"), ["src", "dst"])
    each = both.select("p", "e", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")).filter("p >= threshold OR e >= threshold")
    d = F.col("p") - F.col("e")
    return each.groupBy("threshold").agg(F.min(d).alias("least"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("deviation"), F.percentile(d, 0.5).alias("median"), F.max(d).alias("largest"), F.count(F.lit(1)).alias("edges"))


def degree_histogram(edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, degree, nodes``."""
    each = both_ways(edges).select("u", "sim", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")).filter("sim >= threshold")
    return each.groupBy("threshold", "u").agg(F.count(F.lit(1)).alias("degree")).groupBy("threshold", "degree").agg(F.count(F.lit(1)).alias("nodes"))


def graph_report(nodes: DataFrame, edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """``measure, threshold, value, n``: nodes, edges, singletons and the histogram of node frequencies; for each threshold edges,
    the histograms of degrees and of component sizes, and components."""
    row = lambda df, measure, t=None, value=F.lit(None), n="n": df.select(F.lit(measure).alias("measure"), F.lit(t).cast("double").alias("threshold"), value.cast("long").alias("value"), F.col(n).cast("long").alias("n"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    parts = [
        row(count(nodes), "nodes"), row(count(edges), "edges"), row(count(nodes.join(both_ways(edges).select(F.col("u").alias("node")).distinct(), "node", "left_anti")), "singletons"),
        row(nodes.groupBy("freq").agg(F.count(F.lit(1)).alias("n")), "node_freq", value=F.col("freq")),
    ]
    for t in thresholds:
        kept = edges.filter(F.col("sim") >= t)
        sizes = cut(connected_components(kept).groupBy("component").agg(F.count(F.lit(1)).alias("size")))
        parts += [
            row(count(kept), "edges_at", t), row(degree_histogram(edges, [t]), "degree", t, F.col("degree"), "nodes"), row(count(sizes), "components", t),
            row(sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")), "component_size", t, F.col("size")),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def basic_features(nodes: DataFrame, edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """``node_freq, max_sim`` and, for each threshold, ``min_sim, sim_avr, sim_std, degree, degree_central`` over edges that reach it."""
    near = both_ways(edges)
    aggs = [F.max("sim").alias("max_sim")]
    for t in thresholds:
        s = F.when(F.col("sim") >= t, F.col("sim"))
        aggs += [f(s).alias(f"{n}-{t:.2f}") for f, n in ((F.min, "min_sim"), (F.avg, "sim_avr"), (F.stddev_pop, "sim_std"), (F.count, "degree"))]
    made = near.groupBy(F.col("u").alias("node")).agg(*aggs)
    out = nodes.select("node", F.col("freq").cast("double").alias("node_freq")).join(made, "node", "left").na.fill(0.0)
    for t in thresholds:
        size = near.filter(F.col("sim") >= t).agg(F.count_distinct("u").alias("__n"))
        out = out.crossJoin(F.broadcast(size)).withColumn(f"degree_central-{t:.2f}", F.when(F.col("__n") > 1, 2.0 * F.col(f"`degree-{t:.2f}`") / (F.col("__n") - 1)).otherwise(0.0)).drop("__n")
    return out.withColumns({f"degree-{t:.2f}": F.col(f"`degree-{t:.2f}`").cast("double") for t in thresholds})


def _buckets(found: DataFrame, degrees: DataFrame, name: str, threshold: float, n: int) -> DataFrame:
    """node and a count per bucket floor(log2(degree)) of the ``other`` nodes found for it."""
    each = found.join(degrees.withColumnsRenamed({"node": "other", "degree": "d"}), "other").withColumn("b", F.floor(F.log2("d") + 1e-12))
    return each.groupBy("node").agg(*[F.count_if(F.col("b") == i).cast("double").alias(f"{name}-b{i}-{threshold:.2f}") for i in range(n)])


#: Graphs of so many nodes at most, and an edge for every 128 pairs at least, go through products of their adjacency matrices: two
#: steps in a dense graph are as many as the cube of its nodes.
DENSE_NODES = 8192


def _dense_steps(near: DataFrame, threshold: float, known: list[tuple], n: int) -> DataFrame:
    """``node, histo, leaving, among``: nodes two steps away by bucket of degree, and edges of neighbours that leave the ego network or stay
    in it, twice. ``known`` lists all nodes with their degrees."""
    spark, count = near.sparkSession, len(known)
    kind = near.schema["u"].dataType.simpleString()
    at = spark.createDataFrame([(name, i) for i, (name, _) in enumerate(known)], f"u {kind}, i int")
    both = near.join(F.broadcast(at), "u").join(F.broadcast(at.toDF("v", "j")), "v").select("i", "j", (F.col("sim") >= threshold).alias("close"))

    def packed(batches):
        for batch in batches:
            for i, others, near_ones in zip(*(c.to_pylist() for c in batch.columns)):
                bits = np.zeros((2, count), np.uint8)
                bits[0, others] += 1
                bits[1, near_ones] += 1
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())], ["i", "bits"])

    rows = both.groupBy("i").agg(F.collect_list("j").alias("others"), F.collect_list(F.when(F.col("close"), F.col("j"))).alias("near_ones")).mapInArrow(packed, "i int, bits binary")
    found = sorted((r["i"], bytes(r["bits"])) for r in rows.collect())  # two bits for each pair of at most DENSE_NODES nodes
    sent = spark.sparkContext.broadcast(b"".join(b for _, b in found))
    bucket = np.floor(np.log2([d for _, d in known]) + 1e-12).astype(int)

    def steps(batches):
        whole = np.frombuffer(sent.value, np.uint8).reshape(count, 2, -1)
        for batch in batches:
            for block in batch.column("id").to_pylist():
                own = np.arange(block * 256, min(count, block * 256 + 256))
                mine = [np.unpackbits(whole[own, k], axis=1, count=count).astype(np.float32) for k in (0, 1)]
                histo, leaving, among = np.zeros((len(own), n)), np.zeros(len(own)), np.zeros(len(own))
                for a in range(0, count, 1024):
                    others = np.arange(a, min(count, a + 1024))
                    # the matrices are symmetric: these are the columns of the others
                    theirs = [np.unpackbits(whole[others, k], axis=1, count=count).astype(np.float32) for k in (0, 1)]
                    same, near_ones = own[:, None] == others, mine[1][:, others] > 0
                    reached = (mine[0] @ theirs[1].T > 0) & ~same & ~near_ones
                    paths = np.where(same, 0, mine[1] @ theirs[0].T)
                    among += np.where(near_ones, paths, 0).sum(axis=1, dtype=float)
                    leaving += np.where(near_ones, 0, paths).sum(axis=1, dtype=float)
                    for b in range(n):
                        histo[:, b] += (reached & (bucket[others] == b)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(histo.tolist(), pa.list_(pa.float64())), pa.array(leaving), pa.array(among)], ["i", "histo", "leaving", "among"])

    made = spark.range(0, (count + 255) // 256, 1, (count + 255) // 256).mapInArrow(steps, "i int, histo array<double>, leaving double, among double")
    return made.join(F.broadcast(at.withColumnRenamed("u", "node")), "i").drop("i")


def neighbourhood_features(edges: DataFrame, threshold: float, max_degree: int | None = None) -> DataFrame:
    """``degree_histo1``, ``degree_histo2``, ``egonet_degree`` and ``egonet_density`` of one threshold, for every node with an edge.

    Histograms bucket neighbours' degrees in the whole graph by log2. The second one looks at nodes two steps away that are
    neither the node nor a neighbour; only the second step's edge must reach the threshold. The ego network is the node
    with its neighbours at the threshold; edges that leave it, of any similarity, are counted by direction. Density divides
    all edges within it by n (n + 1) / 2.
    """
    near = both_ways(edges)
    degrees = near.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    if max_degree is None:
        max_degree = degrees.agg(F.max("degree")).first()[0] or 1
    n = int(math.log2(max_degree)) + 1
    close = near.filter(F.col("sim") >= threshold).select(F.col("u").alias("node"), F.col("v").alias("other"))
    first = _buckets(close, degrees, "degree_histo1", threshold, n)
    known = degrees.limit(DENSE_NODES + 1).collect()
    if 0 < len(known) <= DENSE_NODES and 64 * sum(r["degree"] for r in known) >= len(known) ** 2:
        two = _dense_steps(near, threshold, sorted((r["node"], r["degree"]) for r in known), n)
        second = two.select("node", *[F.col("histo")[i].alias(f"degree_histo2-b{i}-{threshold:.2f}") for i in range(n)])
        leaving, among = two.select("node", F.col("leaving").alias(f"egonet_degree-{threshold:.2f}")), two.select("node", (F.col("among") / 2).alias("inner"))
    else:
        all_near = near.select(F.col("u").alias("node"), F.col("v").alias("mid"))
        steps = all_near.join(close.select(F.col("node").alias("mid"), "other"), "mid").select("node", "other").filter("node <> other").distinct()
        second = _buckets(steps.join(close, ["node", "other"], "left_anti"), degrees, "degree_histo2", threshold, n)
        outside = close.withColumnRenamed("other", "mid").join(near.select(F.col("u").alias("mid"), F.col("v").alias("other")), "mid").filter("other <> node")
        leaving = outside.join(close, ["node", "other"], "left_anti").groupBy("node").agg(F.count(F.lit(1)).cast("double").alias(f"egonet_degree-{threshold:.2f}"))
        among = outside.join(close, ["node", "other"], "left_semi").groupBy("node").agg((F.count(F.lit(1)) / 2).alias("inner"))
    size = close.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    density = size.join(among, "node", "left").select("node", ((F.col("n") + F.coalesce("inner", F.lit(0.0))) / (F.col("n") * (F.col("n") + 1) / 2.0)).alias(f"egonet_density-{threshold:.2f}"))
    out = degrees.select("node")
    for part in (first, second, leaving, density):
        out = out.join(part, "node", "left")
    return out.na.fill(0.0)


def pagerank(edges: DataFrame, threshold: float, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """``node, pagerank`` on the unweighted graph of edges at the threshold, a fixed number of power steps."""
    near = both_ways(edges).filter(F.col("sim") >= threshold).select("u", "v")
    degrees = near.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    arcs = cut(near.join(degrees, "u"))
    n = degrees.count()
    if not n:
        return degrees.select(F.col("u").alias("node"), F.lit(0.0).alias("pagerank"))
    rank = degrees.select(F.col("u").alias("node"), F.lit(1.0 / n).alias("pagerank"))
    for i in range(rounds):
        given = arcs.join(rank, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("pagerank") / F.col("d")).alias("x"))
        rank = given.select("node", (F.lit((1 - damping) / n) + damping * F.col("x")).alias("pagerank"))
        if i % 5 == 4:
            rank = cut(rank)
    return rank


def eigenvector(edges: DataFrame, threshold: float, rounds: int = 50) -> DataFrame:
    """``node, eigenvec_central``: a fixed number of power steps of A + I, with unit length."""
    near = cut(both_ways(edges).filter(F.col("sim") >= threshold).select("u", "v"))
    x = cut(near.select(F.col("u").alias("node")).distinct().withColumn("x", F.lit(1.0)))
    for i in range(rounds):
        given = near.join(x, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.sum("x").alias("s"))
        x = cut(x.join(given, "node").select("node", (F.col("x") + F.col("s")).alias("x")))  # a round reads x twice, so each is cut
        if i % 5 == 4 or i == rounds - 1:
            norm = x.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
            x = cut(x.crossJoin(F.broadcast(norm)).select("node", (F.col("x") / F.col("norm")).alias("x")))
    return x.withColumnRenamed("x", "eigenvec_central")


def _paths(n: int):
    """Betweenness and closeness of one component by breadth-first searches, normalised for a graph of n nodes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["u"]) | set(pdf["v"]))
        at = {x: i for i, x in enumerate(names)}
        near: list[list[int]] = [[] for _ in names]
        for u, v in zip(pdf["u"], pdf["v"]):
            near[at[u]].append(at[v])
        between, close = np.zeros(len(names)), np.zeros(len(names))
        for s in range(len(names)):
            distance, paths, order = {s: 0}, np.zeros(len(names)), [s]
            paths[s] = 1
            for x in order:
                for y in near[x]:
                    if y not in distance:
                        distance[y] = distance[x] + 1
                        order.append(y)
                    if distance[y] == distance[x] + 1:
                        paths[y] += paths[x]
            share = np.zeros(len(names))
            for y in reversed(order):
                for x in near[y]:
                    if distance[x] == distance[y] - 1:
                        share[x] += paths[x] / paths[y] * (1 + share[y])
                if y != s:
                    between[y] += share[y]
            total = sum(distance.values())
            close[s] = (len(order) - 1) / total * (len(order) - 1) / (n - 1) if total else 0.0
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return pd.DataFrame({"node": names, "between_central": between * scale, "closeness_central": close})

    return run


def path_centralities(edges: DataFrame, threshold: float) -> DataFrame:
    """``node, between_central, closeness_central`` on the unweighted graph at the threshold. A component is one task's work: its
    shortest paths cannot be split by grouping; drop or cut giant components first."""
    kept = edges.filter(F.col("sim") >= threshold)
    label = connected_components(kept)
    near = both_ways(kept).join(label.withColumnRenamed("node", "u"), "u").select("component", "u", "v")
    n = label.count()
    kind = edges.schema["src"].dataType.simpleString()
    return near.groupBy("component").applyInPandas(_paths(n), f"node {kind}, between_central double, closeness_central double")


def joint_range(features: list[DataFrame], names: list[str]) -> DataFrame:
    """One row of ``<name>_min`` (at most 1) and ``<name>_max`` (at least 0) over all tables."""
    every = features[0].select(*names)
    for f in features[1:]:
        every = every.unionByName(f.select(*names))
    return every.agg(*[c for n in names for c in (F.least(F.lit(1.0), F.min(n)).alias(f"{n}_min"), F.greatest(F.lit(0.0), F.max(n)).alias(f"{n}_max"))])


def normalise(features: DataFrame, names: list[str], ends: DataFrame) -> DataFrame:
    """(x - min) / (max - min); 0 where the range is empty."""
    made = features.crossJoin(F.broadcast(ends))
    value = lambda n: F.when(F.col(f"`{n}_max`") > F.col(f"`{n}_min`"), (F.col(f"`{n}`") - F.col(f"`{n}_min`")) / (F.col(f"`{n}_max`") - F.col(f"`{n}_min`"))).otherwise(0.0)
    return made.select("node", *[value(n).alias(n) for n in names])


def feature_deviations(features: DataFrame, names: list[str]) -> DataFrame:
    """``variable, deviation`` (population)."""
    return features.agg(*[F.stddev_pop(f"`{n}`").alias(n) for n in names]).unpivot([], [f"`{n}`" for n in names], "variable", "deviation")


def selected_features(a: DataFrame, b: DataFrame, names: list[str], mode: str | int | float) -> list[str]:
    """'all'; 'nonzero' deviation; an int for so many of the highest deviations; a float for deviations from it on. In either graph."""
    if mode == "all":
        return names
    best: dict[str, float] = {}
    for f in (a, b):
        for r in feature_deviations(f, names).collect():  # one row per feature
            best[r["variable"]] = max(best.get(r["variable"], 0.0), r["deviation"] or 0.0)
    if mode == "nonzero":
        return [n for n in names if best[n] > 0]
    if isinstance(mode, int):
        chosen = sorted(names, key=lambda n: (-best[n], n))[:mode]
        return [n for n in names if n in chosen]
    return [n for n in names if best[n] >= mode]


def rare_vectors(features: DataFrame, names: list[str], most: int) -> DataFrame:
    """Nodes whose exact feature vector occurs at most so often."""
    w = Window.partitionBy(*[f"`{n}`" for n in names])
    return features.withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__n") <= most).drop("__n")


def edge_confidence(edges: DataFrame, default: float = 10.0) -> DataFrame:
    """Edges with ``conf``: similarity over the mean similarity of the other edges at either end."""
    ends = both_ways(edges).groupBy("u").agg(F.sum("sim").alias("s"), F.count(F.lit(1)).alias("n"))
    x = edges.join(ends.toDF("src", "s1", "n1"), "src").join(ends.toDF("dst", "s2", "n2"), "dst")
    others = F.col("n1") + F.col("n2") - 2
    return x.select("src", "dst", "sim", F.when(others > 0, F.col("sim") / ((F.col("s1") + F.col("s2") - 2 * F.col("sim")) / others)).otherwise(default).alias("conf"))


def walks(edges: DataFrame, number: int = 20, length: int = 30, p: float = 0.9, q: float = 2.0, seed: int = 42) -> DataFrame:
    """``node, walk``: second-order biased random walks, step by step as joins; draws follow from hashes of walk and step.

    Weights: similarity / p back to the previous node, similarity to a neighbour of it, similarity / q elsewhere.
    """
    near = cut(both_ways(edges))
    starts = near.select(F.col("u").alias("node")).distinct().select("node", F.explode(F.sequence(F.lit(1), F.lit(number))).alias("number"))
    state = starts.select("node", "number", F.lit(None).cast(near.schema["u"].dataType).alias("prev"), F.col("node").alias("now"), F.array("node").alias("walk"))
    known = near.select(F.col("u").alias("prev"), F.col("v").alias("next"), F.lit(1).alias("close"))
    for step in range(1, length):
        options = state.join(near.select(F.col("u").alias("now"), F.col("v").alias("next"), "sim"), "now").join(known, ["prev", "next"], "left")
        weight = F.col("sim") * F.when(F.col("prev").isNull() | F.col("close").isNotNull(), 1.0).when(F.col("next") == F.col("prev"), 1 / p).otherwise(1 / q)
        u = (F.pmod(F.xxhash64("node", "number", "next", F.lit(step), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        # the option with the least exponential clock wins with probability in proportion to its weight
        drawn = options.groupBy("node", "number").agg(F.min_by(F.struct("now", "next", "walk"), -F.ln(u) / weight).alias("x"))
        state = drawn.select("node", "number", F.col("x.now").alias("prev"), F.col("x.next").alias("now"), F.concat("x.walk", F.array("x.next")).alias("walk"))
        if step % 5 == 0:
            state = cut(state)
    return state.select("node", "walk")


def embeddings(walked: DataFrame, dimensions: int = 30, window: int = 10, rounds: int = 10, seed: int = 42) -> DataFrame:
    """``word, vector`` of a skip-gram model over the walks."""
    from pyspark.ml.feature import Word2Vec

    texts = walked.select(F.transform("walk", lambda x: x.cast("string")).alias("walk"))
    return Word2Vec(vectorSize=dimensions, windowSize=window, maxIter=rounds, minCount=0, seed=seed, inputCol="walk", outputCol="vector").fit(texts).getVectors()


