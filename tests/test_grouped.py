"""Pairs through groups of equal values, counted selections and weighted measures against plain ones."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from veilink import catalogue, catalogue_linkage  # noqa: F401
from veilink.functions import similarity as S
from veilink.operators import graph, grouped, match, metrics, prep, regress, transfer, vectors

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    source = random.Random(4)
    made = [(source.randint(0, 40), source.choice("xyz"), source.choice(["ab", "abc", "", None])) for _ in range(60)]  # ids repeat
    return [*made, (None, "x", "ab"), (99, None, "ab")]


@pytest.mark.parametrize("few, chunk", [(256, 4096), (0, 2)])
def test_groups_give_the_pairs_of_rows(spark, rows, monkeypatch, few, chunk):
    monkeypatch.setattr(grouped, "FEW_VALUES", few)
    monkeypatch.setattr(grouped.chunked, "__defaults__", (chunk,))
    table = spark.createDataFrame(rows, "id int, k string, v string")
    scores = lambda s, t: {"n": F.coalesce(F.col(f"n{s}") + F.col(f"n{t}"), F.lit(-1)), "same": F.col(f"v{s}") == F.col(f"v{t}")}
    groups = grouped.group_pairs(table, "id", "k", "v", lambda v: {"n": F.length(v)}, scores)
    score = lambda a, b: (-1, None) if a is None or b is None else (len(a) + len(b), a == b)
    pairs = [(a[0], b[0], *score(a[2], b[2])) for a, b in itertools.product(rows, rows) if a[1] == b[1] and a[1] and a[0] is not None and b[0] is not None]
    assert sorted(map(tuple, grouped.expanded(groups, ordered=False).collect()), key=repr) == sorted(pairs, key=repr)
    up = [p for p in pairs if p[0] < p[1]]
    assert sorted(map(tuple, grouped.expanded(groups).collect()), key=repr) == sorted(up, key=repr)
    counts = {(r.n_, r.same): r.n for r in grouped.counted(groups.withColumnRenamed("n", "n_")).collect()}
    assert counts == {k: sum(p[2:] == k for p in up) for k in {p[2:] for p in up}}


@pytest.mark.parametrize("n", [0, 1, 7, 20, 39, 40, 99])
def test_first_rows_by_counted_values(spark, n):
    source = random.Random(5)
    made = [(source.choice([0.5, 0.25, None, 1.0]), source.randint(0, 3), source.randint(0, 5)) for _ in range(40)]
    table = spark.createDataFrame(made, "s double, a int, b int")
    got = sorted(map(tuple, prep.first_by_values(table, [("s", True), ("a", False), ("b", False)], n).collect()), key=repr)
    want = sorted(made, key=lambda r: (r[0] is None, -(r[0] or 0), r[1], r[2]))[:n]
    assert got == sorted(want, key=repr)


def test_weights_stand_for_repeated_rows(spark):
    made = [(0.1 * i, 0.07 * i * i, i % 2, 1 + i % 3) for i in range(1, 9)]
    once = spark.createDataFrame(made, "p double, y double, m int, n long")
    often = once.select("p", "y", "m", F.explode(F.expr("sequence(1L, n)")).alias("x"))
    close = lambda a, b: all(math.isclose(x, y, abs_tol=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b))
    assert close(regress.regression_quality(once, "p", "y", "n").first(), regress.regression_quality(often, "p", "y").first())
    both = [sorted(map(tuple, metrics.threshold_quality(*x).collect())) for x in ((once, "p", "m", [0.2, 0.5], "n"), (often, "p", "m", [0.2, 0.5]))]
    assert both[0] == both[1]
    weighted = {(r.a, r.b): r.covariance for r in transfer.covariance(once, ["p", "y"], "n").collect()}
    plain = {(r.a, r.b): r.covariance for r in transfer.covariance(often, ["p", "y"]).collect()}
    assert close([weighted[k] for k in sorted(plain)], [plain[k] for k in sorted(plain)])
    a, b = (regress.SimilarityModel("linear").fit(d, ["p"], "y", w).model.coefficients[0] for d, w in ((once, "n"), (often, None)))
    assert math.isclose(a, b, rel_tol=1e-6)


@pytest.mark.parametrize("name", ["blocked_compare", "compared_candidates", "text_similarity", "compression_distance", "bloom_similarities", "coral_adapt"])
def test_pairs_are_dealt_out_before_they_expand(spark, name):
    """A table of few bytes is one partition, whatever its pairs are."""
    assert catalogue.QUERIES[name](spark, DATA).rdd.getNumPartitions() >= grouped.tasks(spark)


@pytest.mark.parametrize("name", ["balance_training", "cosine_histogram", "threshold_metrics", "sim_models", "source_bound", "transfer_variants"])
def test_pairs_are_not_sorted_or_recomputed(spark, name):
    made = catalogue.QUERIES[name](spark, "/root/testdata/sf0.01")
    assert made.count() > 0 and "rangepartitioning" not in made._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["cosine_pairs", "entity_pairs", "lsh_compare_all", "two_step_hash_mod"])
def test_few_bytes_of_input_fill_all_tasks(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).rdd.getNumPartitions() >= grouped.tasks(spark)


def test_pairs_of_blocks_are_found_once_without_a_list_of_all(spark):
    """Nodes in several shared blocks, with repeated and null rows."""
    source = random.Random(6)
    made = [(f"{i % 3}:{source.randint(0, 2)}", i // 3 % 12, i // 3 % 12) for i in range(72)] + [(None, 3, 3), ("0:1", None, 5)]
    table = spark.createDataFrame([(k, n, sorted(random.Random(c).sample(range(8), 3))) for k, n, c in made], "blk_key string, node int, positions array<int>")
    got = match.compare_blocks(table, table, 8, 0.5)
    assert "Deduplicate" not in got._jdf.queryExecution().analyzed().toString()
    blocks = {}
    for k, n, c in made:
        blocks.setdefault((n, tuple(random.Random(c).sample(range(8), 3))), set()).add(k)
    want = [(a, b, 1 - len(set(x) ^ set(y)) / 8) for (a, x), p in blocks.items() for (b, y), q in blocks.items() if p & q - {None} and len(set(x) ^ set(y)) <= 4]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("block", [1024, 3])
def test_vector_pairs(spark, monkeypatch, block):
    """Against expressions: repeated, zero, null, short and non-finite vectors, in one block and in many."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "BATCH", 16)
    source = random.Random(7)
    made = [(i, i % 2, [source.uniform(-1, 1) for _ in range(4)]) for i in range(30)]
    made += [(40, 0, made[0][2]), (41, 0, [0.0] * 4), (42, 1, None), (43, 1, [1.0, None, 0.5, 0.25]), (44, 0, [1.0]), (45, 1, [float("inf"), 1.0, 1.0, 1.0]), (46, None, [1.0] * 4), (47, 0, [-x for x in made[2][2]])]
    table = spark.createDataFrame(made, "id int, g int, v array<float>")
    x = table.select("g", F.col("id").alias("id1"), F.col("v").alias("a")).join(table.select("g", F.col("id").alias("id2"), F.col("v").alias("b")), "g").filter("id1 < id2")
    c = S.cosine(F.col("a"), F.col("b"))
    want = {(r[0], r[1]): r[2:] for r in x.select("id1", "id2", F.round(c, 4), F.round(S.angular(c), 4), F.round(S.euclid(F.col("a"), F.col("b")), 4)).collect()}
    rows = vectors.vector_pairs(table, "id", "g", "v").collect()
    got = {(r[0], r[1]): r[2:] for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    for k, values in want.items():
        assert all(a == b or a != a and b != b or abs(a - b) < 1e-9 for a, b in zip(got[k], values)), (k, got[k], values)


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_dense_graphs_have_the_features_of_sparse_ones(spark, monkeypatch, threshold):
    source = random.Random(9)
    made = [(f"n{i:02}", f"n{j:02}", round(source.random(), 3)) for i, j in itertools.combinations(range(24), 2) if source.random() < 0.4]
    edges = spark.createDataFrame(made, "src string, dst string, sim double")
    dense = sorted(map(tuple, graph.neighbourhood_features(edges, threshold).collect()))
    monkeypatch.setattr(graph, "DENSE_NODES", 0)
    assert dense == sorted(map(tuple, graph.neighbourhood_features(edges, threshold).collect()))


@pytest.fixture(scope="module")
def scored_pairs(spark):
    source = random.Random(11)
    near = lambda y, *options: round(source.choice(options) + 0.3 * y, 2)
    made = [(f"a{source.randint(0, 99):02}", f"b{i:03}", *(near(i % 3 == 0, *x) for x in ([0.2, 0.3, 0.45, 0.5], [0.15, 0.4], [0.1, 0.6], [0.3, 0.5], [0.25, 0.5])), int(i % 3 == 0)) for i in range(240)]
    return spark.createDataFrame(made, "id1 string, id2 string, dice double, jaccard double, overlap double, hamming double, entropy double, is_match int").cache()


@pytest.mark.parametrize("n", [0, 1, 30, 79, 80, 500])
def test_first_rows_by_counts_of_distinct_rows(spark, scored_pairs, n):
    """Where several distinct rows have the border's score, ids decide; ids are looked up for no others."""
    values = ["dice", "overlap", "is_match"]
    rows = scored_pairs.filter("is_match = 0")
    counts = rows.groupBy(*values).agg(F.count(F.lit(1)).alias("n"))
    asked = []
    pairs = lambda same: asked.append(same.count()) or rows.join(same.select(*values), values, "left_semi")
    for score in ("dice", None):
        order = sorted(map(tuple, rows.select("dice", "id1", "id2", *values).collect()), key=lambda r: (-r[0] if score else 0, r[1], r[2]))[:n]
        want = {v: sum(r[3:] == v for r in order) for v in {r[3:] for r in order}}
        got = {tuple(r)[:3]: r["n"] for r in transfer.first_counted(counts, n, "n", pairs, score).select(*values, "n").collect()}
        assert got == want
    assert all(a > 1 for a in asked)


def test_transfer_of_counts_is_that_of_rows(spark, scored_pairs):
    values = [*transfer.METRICS, "is_match"]
    counted = lambda df: df.groupBy(*values).agg(F.count(F.lit(1)).alias("n"))
    target = scored_pairs.withColumn("dice", F.col("dice") * 0.97)
    pairs = lambda same: scored_pairs.join(same.select(*values, *[c for c in same.columns if c == "pp"]), values)
    plain = transfer.transfer(scored_pairs, target, least=0.3, share=0.4).collect()
    weighted = transfer.transfer(counted(scored_pairs), counted(target), least=0.3, share=0.4, weight="n", pairs=pairs).collect()
    assert len(plain) == len(weighted) > 2
    for a, b in zip(plain, weighted):
        assert all(math.isclose(x, y, abs_tol=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", ["transfer_variants", "source_bound"])
def test_classifiers_take_counts_not_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(catalogue, "matrix", None)
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("n", [0, 1, 7, 120, 239, 240])
def test_first_rows_by_hash_are_counted(spark, scored_pairs, n):
    keyed = scored_pairs.withColumn("__id", F.concat_ws("|", "id1", "id2"))
    want = {(r["dice"], r["entropy"]): r["count"] for r in prep.first_by_hash(keyed, "__id", n, "b").groupBy("dice", "entropy").count().collect()}
    for total in (240, 100_000_000):  # a wrong total puts the window elsewhere, the rows stay right
        got = prep.first_counted_by_hash(keyed, "__id", n, total, ["dice", "entropy"], "b").collect()
        assert {(r["dice"], r["entropy"]): r["n"] for r in got} == want


def test_bound_of_counts_is_that_of_rows(spark, scored_pairs):
    values = [*transfer.METRICS, "is_match"]
    counts = scored_pairs.groupBy(*values).agg(F.count(F.lit(1)).alias("n"))
    adapted = lambda df: df.withColumn("dice", F.col("dice") * 0.9)
    keyed = scored_pairs.withColumn("__id", F.concat_ws("|", "id1", "id2"))
    side = lambda n: prep.first_counted_by_hash(keyed, "__id", n, 240, transfer.METRICS, "b")
    got = transfer.source_bound(counts, adapted(counts), weight="n", sample=lambda n: (side(n), adapted(side(n))))
    want = transfer.source_bound(scored_pairs, adapted(scored_pairs))
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want), (got, want)


def test_similarities_of_edges_are_computed_once(spark, monkeypatch):
    """What components are found in has no expression of similarities left to evaluate."""
    plans, whole = [], graph.without_small_components
    monkeypatch.setattr(graph, "without_small_components", lambda e, n: plans.append(e._jdf.queryExecution().analyzed().toString()) or whole(e, n))
    assert catalogue.QUERIES["reidentification"](spark, DATA).count() > 0
    assert len(plans) == 2 and not any("array_intersect" in p for p in plans)


def test_entity_pairs_are_products_in_batches(spark):
    """Ids in both nodes, outside ASCII, and none at all; no row is made by nested explodes."""
    ids = {"x": ["10", "9", "é", "\U0001F600", "�"], "y": ["9", "a", "é"], "z": [], "w": None, **{"u": [f"{i}" for i in range(3000)]}}
    nodes = spark.createDataFrame(list(ids.items()), "node string, ent_ids array<string>")
    edges = spark.createDataFrame([("x", "y", 0.5), ("x", "z", 0.6), ("w", "x", 0.7), ("u", "y", None)], "src string, dst string, sim double")
    pairs = graph.entity_pairs(nodes, edges)
    want = [(*sorted(p, key=lambda t: t.encode()), s) for a, b, s in map(tuple, edges.collect()) for p in itertools.product(ids[a] or [], ids[b] or [])]
    assert sorted(map(tuple, pairs.collect()), key=repr) == sorted(want, key=repr)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") <= 2  # the lists' chunks
