"""Near-duplicate documents by a chosen-path set similarity join (after Christiani, Pagh and Sivertsen, 2018).

1. One scan turns each text into its set of word shingles and stages a narrow row: set size, a 128-bit digest of the
   set, and a sketch of ``COORDINATES`` 16-bit minwise values. Equal sets form a class; one row stands for each class.
2. In each of several independent trees a row takes the path that minwise values at ``START`` randomly chosen coordinates
   spell. Rows on the same path share a node; the nodes of all trees that hold the same rows are compared once. Within a node
   sketches that agree on fewer than ``least_agreeing`` coordinates are passed over; the others span candidate groups.
   A node of more than ``SMALL`` rows becomes one candidate group as it is.
3. Full sets travel once, to the candidate group, where all pairs are compared: products of the incidence matrix.
4. Groups too large for a task (``GROUP_ROWS``, ``GROUP_SHINGLES``) are first compared in random chunks that share a few
   pivots, so most of a group of near copies becomes one label. Rows then take paths in ``TREES_AT_ONCE`` trees at a time; nodes
   of at most ``SMALL_SETS`` rows are compared exhaustively on full sets, in a larger node every row is compared with a pivot and
   the node branches: by the expected 1/threshold branches for each further coordinate, times ``GROWTH``, so that a pair at the
   threshold is expected to stay together in more nodes than before and its lines of descent die out with no more than a bounded
   probability, however many levels follow. Each level has ``FRESH`` minwise values of its own, taken from the full sets of
   the rows that branch. Between levels all links found so far are contracted, and nodes of one label are done. Nodes
   that are still large after ``MAX_LEVELS`` are compared exhaustively in chunk pairs.
5. Trees miss a pair with a small chance. An exact join on parts of the sets (``parts``) follows them, for what they have not put
   in one candidate group, and for rows of large groups that no link has joined; no similar pair is left out.
6. Links and classes give connected components.

A pair at the threshold agrees on a binomial number of the ``COORDINATES`` and shares a node of one tree with their share to
the power of START (times ``survival(GROWTH)`` where nodes branch); the number of trees follows from the recall target.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import parts
from .common import Workspace, is_few, table, text_or_empty, unused, with_label
from .groups import by_node, chunk_pairs, chunks_with_pivots, contracted, hot_nodes, labelled, members_of, node_links, pairs_batch, sampled, spanning, whole_nodes
from .shingles import common, document_words, mix, seeded, shingle_set, signature

COORDINATES, START, SMALL = 64, 2, 2048
#: What one task compares at once: rows of a candidate group, and shingles of them all (8 bytes each).
GROUP_ROWS, GROUP_SHINGLES = 4096, 4_000_000
SMALL_SETS, CHUNK_ROWS, PIVOTS, MAX_LEVELS, TREES_AT_ONCE = 512, 1024, 8, 12, 4
GROWTH, FRESH, MAX_STEPS = 1.5, 512, 8
RECALL = 0.9999999
_U = np.uint64


def trees_for(recall: float, threshold: float, growth: float | None = None) -> int:
    """The least number by which a pair at the threshold is missed with 1 - recall at most, over all its numbers of equal coordinates.

    With ``growth``, nodes branch, and a pair's lines of descent have to survive as well.
    """
    n, stays, trees = COORDINATES, survival(growth) if growth else 1.0, 1
    chance = [math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) for k in range(n + 1)]
    while sum(c * (1 - (k / n) ** START * stays) ** trees for k, c in enumerate(chance)) > 1 - recall:
        trees += 1
    return trees


def least_agreeing(recall: float, threshold: float) -> int:
    """The most coordinates that may be asked to agree, if a pair at the threshold is to fail with 1 - recall at most."""
    n, below, k = COORDINATES, 0.0, 0
    while below + (step := math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k)) <= 1 - recall:
        below, k = below + step, k + 1
    return k


def survival(growth: float) -> float:
    """Chance that descent with a Poisson number of children, ``growth`` on average, never dies out."""
    dies = 0.0
    for _ in range(500):
        dies = math.exp(growth * (dies - 1))
    return 1 - dies


def similar(a: np.ndarray, b: np.ndarray, part: int, whole: int) -> bool:
    """whole * |a & b| >= part * |a | b|."""
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = common(a, b)
    return whole * both >= part * (len(a) + len(b) - both)


def _profiles(size: int):
    def run(batches):
        odd = seeded(COORDINATES, 3) | _U(1)
        for batch in batches:
            n, low, high, sigs, counts = [], [], [], [], []
            for words in document_words(batch.column(2).to_pylist()):
                values = shingle_set(words, size)
                n.append(len(values))
                low.append(int(parts.digest(values).view(np.int64)))
                high.append(int(mix(values ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                sigs.append(signature(values, odd).astype(np.uint16).tobytes())
                counts.append(parts.bins(values).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, low, high)), pa.array(sigs, pa.binary()), pa.array(counts, pa.binary())],
                ["uid", "id", "n", "low", "high", "sig", "bins"],
            )

    return run


def _sets(size: int, kept: tuple[str, ...]):
    """The columns ``kept`` and the set of each ``text``."""

    def run(batches):
        for batch in batches:
            blobs = [shingle_set(w, size).tobytes() for w in document_words(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(blobs, pa.binary())], [*kept, "shingles"])

    return run


def _paths(sigs: np.ndarray, nodes: np.ndarray, steps: int) -> np.ndarray:
    """The child of each node for the row's minwise values at ``steps`` coordinates, which depend on the node alone."""
    for _ in range(steps):
        at = (mix(nodes ^ _U(0x6A09E667F3BCC909)) % _U(sigs.shape[1])).astype(np.int64)
        nodes = mix(nodes * _U(0x9E3779B97F4A7C15) + sigs[np.arange(len(sigs)), at].astype(np.uint64) + _U(1))
    return nodes


def _out(node: np.ndarray, rep: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(rep, pa.int64())], ["node", "rep"])


def _roots(trees: int, first: int = 0):
    def run(batches):
        seeds = seeded(first + trees, 4)[first:]
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, COORDINATES)
            rep = batch.column("rep").to_numpy()
            for seed in seeds:
                yield _out(_paths(sigs, np.full(len(sigs), seed), START), rep)

    return run


def _shared(most: int):
    """``node, rep, pivot`` of nodes with more than one row: of small ones with a number for the set of their rows instead of
    the node, so that equal sets of several trees fall together, of others with the pivot to link with. Sorted by node, rep.
    """

    def small(reps):
        who = mix(np.bitwise_xor.reduce(mix(reps.view(np.uint64) + _U(1)), keepdims=True) + _U(len(reps)))
        return np.repeat(who, len(reps)), reps, np.full(len(reps), -1)

    def run(batches):
        open_, held, count, pivot = None, [], 0, None  # the node at the end of the last batch; ``held`` is empty once it is large
        for batch in batches:
            if not batch.num_rows:
                continue
            node, rep, out = batch.column("node").to_numpy(), batch.column("rep").to_numpy(), []
            cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(node))):
                if open_ is None or node[a] != open_:
                    if 1 < count <= most:
                        out.append(small(np.concatenate(held)))
                    open_, held, count, pivot = node[a], [], 0, rep[a]
                if b - a == 1 and not count:
                    held, count = [rep[a:b]], 1
                    continue
                count += int(b - a)
                held.append(rep[a:b])
                if count > most:
                    more = np.concatenate(held)
                    out.append((np.full(len(more), open_).view(np.uint64), more, np.full(len(more), pivot)))
                    held = []
            yield _marked(out)
        if 1 < count <= most:
            yield _marked([small(np.concatenate(held))])

    return run


def _marked(parts):
    if not parts:
        parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    node, rep, pivot = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node.view(np.int64), rep, pivot)], ["node", "rep", "pivot"])


def _agreeing(least: int):
    """Links that span what agrees on ``least`` coordinates within the nodes."""

    def run(batches):
        for rows in whole_nodes(batches):
            sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, COORDINATES)
            rep = rows.column("rep").to_numpy()
            found = spanning(rows.column("node").to_numpy(), rep, lambda i, j: (sigs[i] == sigs[j]).sum(axis=1) >= least)
            yield pairs_batch([(rep[i], rep[j]) for i, j in found])

    return run


def _fresh(level: int):
    def run(batches):
        odd = seeded(FRESH, 100 + level) | _U(1)
        for batch in batches:
            sigs = [signature(np.frombuffer(blob, np.uint64), odd).tobytes() for blob in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sigs, pa.binary())], ["rep", "sig"])

    return run


def _branch(threshold: float, level: int):
    def run(batches):
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, FRESH)
            node, rep = batch.column("node").to_numpy().view(np.uint64), batch.column("rep").to_numpy()
            # at most as many coordinates as make a node of pairs at the threshold small; few at first, which part unlike rows
            steps = np.clip(np.ceil(np.log(batch.column("n").to_numpy() / SMALL_SETS) / np.log(1 / threshold)), 1, min(MAX_STEPS, 2 << level))
            # the node rounds its number of branches up or down by chance, so that the mean is GROWTH * threshold**-steps
            chance = (mix(node ^ _U(0xBB67AE8584CAA73B)) >> _U(11)).astype(float) / 2**53
            branches = np.floor(GROWTH * threshold**-steps + chance)
            for s in np.unique(steps):
                for j in range(int(branches[steps == s].max())):
                    rows = np.flatnonzero((steps == s) & (branches > j))
                    yield _out(_paths(sigs[rows], mix(node[rows] + _U(j + 1) * _U(0xC2B2AE3D27D4EB4F)), int(s)), rep[rows])

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: products of the incidence matrix for common shingles, pairs of owners for rare ones."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    out, width, rare = np.zeros((n, n), dtype=np.float32), 2048, n // 64
    dense = counts > max(rare, 1)
    place = np.cumsum(dense) - 1
    keep = dense[column]
    at, own = place[column[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    for a in range(0, int(dense.sum()), width):
        i, j = np.searchsorted(at, (a, a + width))
        part = np.zeros((n, width), dtype=np.float32)
        part[own[i:j], at[i:j] - a] = 1
        out += part @ part.T
    few = ~dense & (counts > 1)
    keep = few[column]
    order = np.argsort(column[keep], kind="stable")
    own, often = owner[keep][order], counts[column[keep][order]]
    for c in np.unique(often):
        rows = own[often == c].reshape(-1, c)
        for x in range(c):
            for y in range(x):
                np.add.at(out, (rows[:, x], rows[:, y]), 1)
                np.add.at(out, (rows[:, y], rows[:, x]), 1)
    return out


def _exhaustive(part: int, whole: int):
    """Links that connect what the node's pairs connect; rows come sorted by node."""

    def links(ids, labels, sets):
        n = len(ids)
        if n < 2 or len(set(labels)) < 2:
            return []
        size = np.array([len(x) for x in sets])
        if n <= 4:
            near = np.zeros((n, n), dtype=bool)
            for i in range(n):
                for j in range(i):
                    near[i, j] = near[j, i] = labels[i] != labels[j] and similar(sets[i], sets[j], part, whole)
        else:
            both, near = intersections(sets), np.empty((n, n), dtype=bool)
            for i in range(n):  # integers below 2^24 are exact in float32
                shared = both[i].astype(np.int64)
                near[i] = whole * shared >= part * (size[i] + size - shared)
        known = np.array(labels)
        found, seen = [], np.zeros(n, dtype=bool)
        for i in range(n):
            if seen[i]:
                continue
            seen[i], edge = True, [i]
            while edge:
                k = edge.pop()
                fresh = np.flatnonzero((near[k] | (known == known[k])) & ~seen)
                seen[fresh] = True
                edge += fresh.tolist()
                found += [(ids[i], ids[j]) for j in fresh if labels[j] != labels[i]]
        return found

    def run(batches):
        for rows in whole_nodes(batches):
            node, found = rows.column("node").to_numpy(), []
            ids, labels, blobs = (rows.column(c).to_pylist() for c in ("rep", "label", "shingles"))
            cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            for a, b in zip(cuts, np.append(cuts[1:], len(node))):
                found += links(ids[a:b], labels[a:b], [np.frombuffer(x, np.uint64) for x in blobs[a:b]])
            yield pairs_batch(found)

    return run


def _with_pivot(part: int, whole: int):
    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("shingles", "pivot_shingles"))
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), part, whole) for x, y in zip(left, right)]
            keep = pa.array(np.flatnonzero(ok), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("pivot", "rep")], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, part: int = 4, whole: int = 5, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id_col>, n_shingles, component_id, kept``.

    Texts are linked where the Jaccard similarity of their shingle sets is at least part / whole, confirmed on full
    sets. A-Z count as a-z; words are runs of characters other than ASCII white space; a text with fewer words than a
    shingle is one shingle, a null, empty or blank text has none and is linked with nothing. ``component_id`` is the
    smallest id that links reach, itself included; equal sets are linked. Rows with null ids take part, with the
    component's smallest id, or null if it has none; kept means that the id is the component's. Other columns
    are not read. An empty table gives an empty result. ``docs`` is scanned twice and must give the same rows in the
    same order each time, as files and staged tables do.
    """
    return _grouped(docs, shingle_words, part, whole, recall, id_col, text_col)[0].select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def keep_one(docs: DataFrame, shingle_words: int = 5, part: int = 4, whole: int = 5, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows and columns, without the rows of each component but one: that with the smallest id, then the first.

    Null ids come last. Texts without shingles all stay. ``docs`` is scanned three times, see ``near_duplicates``.
    """
    groups, work = _grouped(docs, shingle_words, part, whole, recall, id_col, text_col)
    uid = unused(docs, "uid")
    gone = work.stage(groups.filter("uid <> stays").select(F.col("uid").alias(uid)), "gone")
    work.keep_only(gone)
    rows, n = docs.withColumn(uid, F.monotonically_increasing_id()), gone.count()
    return rows.join(F.broadcast(gone) if is_few(n, 32) else gone, uid, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def _grouped(docs: DataFrame, shingle_words: int, part: int, whole: int, recall: float, id_col: str, text_col: str) -> tuple[DataFrame, Workspace]:
    """``uid, id, n, component_id, stays``: stays is the number of the row that represents the component."""
    spark = docs.sparkSession
    work = Workspace(spark, "near-dedup")
    threshold = part / whole
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    profiles = work.stage(rows.mapInArrow(_profiles(shingle_words), f"uid long, id {kind}, n long, low long, high long, sig binary, bins binary"), "profiles")
    classes = work.stage(
        profiles.filter("n > 0").groupBy("n", "low", "high").agg(F.min("uid").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("last"), "id", "uid")).alias("least")), "classes"
    )
    who = F.expr(f"low & {(1 << parts.WHO_BITS) - 1}L").alias("who")
    heads = work.stage(profiles.select(F.col("uid").alias("rep"), "sig", "bins").join(classes.select("rep", F.col("n").alias("weight"), who), "rep"), "heads")
    labels = _candidates(heads, recall, threshold, work)
    # what meets by parts, as rows; sets that share the digest's low bits all take part
    met = parts.meeting(rows.select("text"), classes.agg(F.sum("n")).first()[0] or 0, shingle_words, part, whole)
    met = work.stage(met.join(heads.select("who", "rep"), "who").select("node", "rep"), "met")
    labels = contracted(work.stage(_gated(_apart(met, labels, heads, work), part, whole, True), "candidates"), labels, work)
    small, large = members_of(labels, heads.select("rep", "weight"), GROUP_ROWS, GROUP_SHINGLES, work)
    found = work.stage(_confirmed(rows, small.withColumnRenamed("grp", "node").withColumn("label", F.col("rep")), shingle_words, part, whole), "links")
    labels = contracted(found, None, work)
    if large.take(1):
        labels = _large_groups(rows, heads, large, labels, met, shingle_words, part, whole, recall, work)
    roots = work.stage(labelled(classes, labels).withColumnRenamed("label", "root"), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("first"))
    of_class = work.stage(roots.join(least, "root").select("n", "low", "high", F.col("first.id").alias("component_id"), F.col("first.uid").alias("stays")), "components")
    work.keep_only(profiles, of_class)
    own = F.col("n") == 0
    return profiles.select("uid", "id", "n", "low", "high").join(of_class, ["n", "low", "high"], "left").select(
        "uid", "id", "n", F.when(own, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(own, F.col("uid")).otherwise(F.col("stays")).alias("stays")
    ), work


def _candidates(heads: DataFrame, recall: float, threshold: float, work: Workspace) -> DataFrame:
    """``rep, label``: groups that hold every pair at the threshold, but for the chance stated above."""
    roots = _roots(trees_for(recall, threshold))
    hot = work.stage(hot_nodes(sampled(heads.select("rep", "sig")).mapInArrow(roots, "node long, rep long"), 4 * SMALL), "hot")
    nodes = heads.select("rep", "sig").mapInArrow(roots, "node long, rep long").join(F.broadcast(hot), "node", "left")
    nodes = nodes.select(F.expr("if(pivot IS NULL, node, xxhash64(rep))").alias("node"), "rep", F.coalesce("pivot", F.lit(-1)).alias("pivot"))
    marked = work.stage(by_node(nodes.filter("pivot = -1").select("node", "rep"), "rep").mapInArrow(_shared(SMALL), "node long, rep long, pivot long"), "shared")
    if hot.take(1):
        marked = marked.unionByName(nodes.filter("pivot <> -1"))
    shared = marked.filter("pivot = -1").select("node", "rep").distinct().join(heads.select("rep", "sig"), "rep")
    found = by_node(shared).mapInArrow(_agreeing(least_agreeing(recall, threshold)), "a long, b long")
    stars = marked.filter("pivot <> -1 AND pivot <> rep").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    return contracted(work.stage(found.unionByName(stars).distinct(), "candidates"), None, work)


def _apart(met: DataFrame, labels: DataFrame, heads: DataFrame, work: Workspace) -> DataFrame:
    """``node, rep, label, weight, bins`` of the nodes that hold several labels; larger ones as all pairs of their chunks."""
    rows = labelled(met, labels)
    mixed = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).filter("l0 < l1").select("node", "n")
    rows = work.stage(rows.join(mixed, "node").select("node", "n", "rep", "label"), "apart")
    small, big = rows.filter(F.col("n") <= SMALL).select("node", "rep", "label"), rows.filter(F.col("n") > SMALL)
    if big.take(1):
        small = small.unionByName(chunk_pairs(big, SMALL))
    return small.join(heads.select("rep", "weight", "bins"), "rep")


def _gated(rows: DataFrame, part: int, whole: int, span: bool) -> DataFrame:
    """Links between rows of different labels in nodes that sizes and bins let through: all, or with ``span`` those that span them."""

    def run(batches):
        for batch in whole_nodes(batches):
            node, rep, label, sizes = (batch.column(c).to_numpy() for c in ("node", "rep", "label", "weight"))
            table = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, parts.BINS)

            def near(i, j):
                out = label[i] == label[j]
                at = np.flatnonzero(~out)
                out[at] = parts.may_be_similar(sizes, table, i[at], j[at], part, whole)
                return out

            if span:
                yield pairs_batch([(rep[i], rep[j]) for i, j in spanning(node, rep, near) if label[i] != label[j]])
                continue
            at, d = np.arange(len(node)), 1
            while len(at := at[at + d < len(node)]) and len(at := at[node[at] == node[at + d]]):
                some = at[label[at] != label[at + d]]
                some = some[parts.may_be_similar(sizes, table, some, some + d, part, whole)]
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(f(rep[some], rep[some + d]), pa.int64()) for f in (np.minimum, np.maximum)], ["a", "b"])
                d += 1

    return by_node(rows, "rep").mapInArrow(run, "a long, b long").distinct()


def _confirmed(rows: DataFrame, placed: DataFrame, shingle_words: int, part: int, whole: int) -> DataFrame:
    """Links within the nodes of ``placed`` (``node, rep, label``, each rep in one node), on full sets."""
    wide = with_label(rows.select(F.col("uid").alias("rep"), "text"), placed, "rep", placed.count()).select("node", "rep", "label", "text")
    sets = wide.mapInArrow(_sets(shingle_words, ("node", "rep", "label")), "node long, rep long, label long, shingles binary")
    return by_node(sets, "rep").mapInArrow(_exhaustive(part, whole), "a long, b long")


def _large_groups(rows: DataFrame, heads: DataFrame, large: DataFrame, labels: DataFrame, met: DataFrame, shingle_words: int, part: int, whole: int, recall: float, work: Workspace) -> DataFrame:
    """``labels`` after the links of groups that no task can compare as a whole; ``met`` has their rows by parts."""
    threshold = part / whole
    large = work.stage(large, "large")
    wide = with_label(rows.select(F.col("uid").alias("rep"), "text"), large.select("rep"), "rep", large.count())
    sets = work.stage(wide.select("rep", "text").mapInArrow(_sets(shingle_words, ("rep",)), "rep long, shingles binary"), "sets")
    compare = _exhaustive(part, whole)
    chunks = chunks_with_pivots(large, CHUNK_ROWS, PIVOTS).join(sets, "rep")
    labels = contracted(work.stage(by_node(chunks, "rep").mapInArrow(compare, "a long, b long").distinct(), "links"), labels, work)
    members = work.stage(heads.select("rep", "sig").join(large.select("rep", "grp"), "rep"), "heads")
    trees = trees_for(recall, threshold, GROWTH)
    for first in range(0, trees, TREES_AT_ONCE):
        roots = members.select("rep", "sig").mapInArrow(_roots(min(TREES_AT_ONCE, trees - first), first), "node long, rep long")
        # rows of different groups are no candidates, so a node holds rows of one group
        nodes = roots.join(members.select("rep", "grp"), "rep").select(F.xxhash64("node", "grp").alias("node"), "rep")
        labels = node_links(
            work.stage(nodes, "nodes"), sets, labels, SMALL_SETS, MAX_LEVELS, compare, _with_pivot(part, whole),
            lambda rows, level, work: _children(rows, sets, level, threshold, work), work,
        )
    met = met.join(large.select("rep", "grp"), "rep").select(F.xxhash64("node", "grp").alias("node"), "rep")
    pairs = work.stage(_gated(_apart(met, labels, heads, work), part, whole, False).select(F.col("a").alias("pivot"), F.col("b").alias("rep")), "pairs")
    stars = sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("pivot_shingles"))
    return contracted(work.stage(pairs.join(sets, "rep").join(stars, "pivot").mapInArrow(_with_pivot(part, whole), "a long, b long"), "links"), labels, work)


def _children(wide: DataFrame, sets: DataFrame, level: int, threshold: float, work: Workspace) -> DataFrame:
    """``node, rep`` of the nodes that rows of large nodes (``node, n, rep``) branch into."""
    fresh = work.stage(sets.join(wide.select("rep").distinct(), "rep").select("rep", "shingles").mapInArrow(_fresh(level), "rep long, sig binary"), "fresh")
    nodes = work.stage(wide.join(fresh, "rep").select("node", "n", "rep", "sig").mapInArrow(_branch(threshold, level), "node long, rep long"), "nodes")
    work.drop(fresh)
    return nodes


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, part=85, whole=100)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS h FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * h >= 85 * (a.n + b.n - h)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id AS node, doc_id AS r FROM documents UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.node),
c AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON node = doc_id
"""
