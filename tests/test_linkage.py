"""Comparison, blocking, graphs, matching, transfer and evaluation against plain Python on small tables."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilink.functions import bits, scalars
from veilink.functions import similarity as S
from veilink.operators import blocking, compare, encode, graph, match, metrics, prep, regress, transfer
from veilink.plans import attack, linkage
from veilink.streaming import encode_stream


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def people(spark):
    source = random.Random(4)
    names = ["ann lee", "anna lee", "bob kim", "bob kimm", "carl oz", "dora ray", "dora rey", "eve"]
    a = [(f"a{i}", source.choice(names), source.choice(["rome", "oslo", None])) for i in range(20)]
    b = [(f"b{i}", source.choice(names), source.choice(["rome", "oslo", None])) for i in range(20)]
    gold = [(x[0], y[0]) for x in a for y in b if x[1] == y[1] and source.random() < 0.5]
    return a, b, gold, *(spark.createDataFrame(t, "id string, name string, city string") for t in (a, b)), spark.createDataFrame(gold + gold[:2], "id1 string, id2 string")


def test_preparation(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "b", "y")], "n int, s string, id string")
    assert rows(prep.fill_nulls(df, "-"), "n") == [("1", "-", "x"), ("2", "b", "y")]
    assert prep.at_positions(df, [2, 0]).columns == ["id", "n"] and prep.last_to_front(df, "key").columns == ["key", "n", "s"]
    train, test = prep.hash_split(spark.range(4000), "id", 0.75)
    again, _ = prep.hash_split(spark.range(4000), "id", 0.75)
    assert {r.id for r in train.collect()} == {r.id for r in again.collect()} and train.count() + test.count() == 4000 and 2850 < train.count() < 3150
    a, b = spark.range(0, 40), spark.range(20, 60)
    left, right, gold = prep.populate(a, b, prep.linkage_sample(a, b, "id", 10, 0.5), "id")
    la, lb = {r.id for r in left.collect()}, {r.id for r in right.collect()}
    assert (len(la), len(lb), {tuple(r) for r in gold.collect()}) == (10, 10, {(i, i) for i in la & lb}) and len(la & lb) == 5
    both = prep.linkage_sample(a, b, "id", 10, 0.5, only_from_both=True)
    assert {r.id for r in both.filter("side = 'a'").collect()} - set(range(20, 40)) <= {*range(20), *range(40, 60)}
    report = prep.quality_report(df, df, spark.createDataFrame([("1", "2")], "id1 string, id2 string"), ["s"])
    assert {(r.side, r.variable): r.missing for r in report.collect()} == {("a", "s"): 1, ("b", "s"): 1, ("gold", "id1"): 0, ("gold", "id2"): 0}


@pytest.mark.parametrize("n", [0, 1, 7, 60, 1000])
def test_first_rows(spark, n):
    source = random.Random(n)
    data = [(source.randrange(6), i) for i in range(300)]
    df = spark.createDataFrame(data, "v int, i int").repartition(5)
    assert set(rows(prep.first_rows(df, [F.desc("v")], ["i"], n))) == set(sorted(data, key=lambda r: (-r[0], r[1]))[:n])


def test_scalars(spark):
    assert [one(spark, scalars.half_rating(F.lit(x))) for x in (4.1, 4.11, 5.0)] == [4.1, 4.15, 5.0]
    assert abs(one(spark, scalars.laplace_density(F.lit(2.0), 1.0, 0.5)) - math.exp(-2) / 1.0) < 1e-12
    assert [one(spark, scalars.integer_text(F.lit(x))) for x in ("3.0", "x", None)] == ["3", None, None]
    assert [one(spark, scalars.mean_over([F.lit(a), F.lit(b)], 0.5)) for a, b in ((0.5, 0.5), (0.6, 0.5))] == [0, 1]
    for text in ("2020-03-09", "09/03/2020", "20200309", "09.03.2020", "Mar 9 2020"):
        assert one(spark, scalars.month_year(F.lit(text))) == "3/2020"
    assert one(spark, scalars.month_year(F.lit("13/25/x"))) == "" and one(spark, scalars.month_year(F.lit("03/25/2020"))) == "3/2020"
    noisy = spark.range(4000).select(scalars.laplace_noise(F.lit(0.0), 2.0, F.col("id")).alias("x")).toPandas()["x"]
    assert abs(noisy.mean()) < 0.05 and abs(noisy.abs().mean() - 0.5) < 0.05


def test_bits(spark):
    array = lambda *x: F.array(*[F.lit(v) for v in x])
    assert one(spark, bits.contains(array(1, 2, 3), array(3, 1))) and not one(spark, bits.contains(array(1, 2), array(2, 5)))
    assert one(spark, bits.same_size(F.lit(8), F.lit(8), F.lit(1))) == 1
    with pytest.raises(Exception, match="differ in length"):
        one(spark, bits.same_size(F.lit(8), F.lit(9), F.lit(1)))
    order = encode.permutation(16, 3)
    got = one(spark, bits.balanced(array(0, 5), 8, order))
    assert got == sorted(order[p] for p in [0, 5, *(8 + p for p in range(8) if p not in (0, 5))])
    flipped = spark.range(400).select(F.size(bits.flipped(F.array().cast("array<int>"), 100, 0.2, F.col("id"))).alias("n")).agg(F.avg("n")).first()[0]
    assert abs(flipped - 10) < 1
    x, y = [0.9, 0.1, 0.5], [0.8, 0.2]
    assert abs(one(spark, S.sorted_edge_difference(array(*x), array(*y))) - (0.1 + 0.3) / 2) < 1e-12
    assert one(spark, S.sorted_edge_difference(array(*x), F.array().cast("array<double>"))) == 0.0
    weights = [1.0, 3.0]
    assert abs(one(spark, S.byte_entropy(array(*weights))) + sum(w / 4 * math.log(w / 4) for w in weights)) < 1e-12
    assert one(spark, S.set_hamming(F.lit(1), F.lit(2), F.lit(3))) == 0.25


def test_text_similarities(spark):
    def entropy(s):
        return 1 - sum(c / len(s) * math.log2(c / len(s)) for c in collections.Counter(s).values()) if s else 1.0

    pairs = [("hello", "hallo"), ("", "abc"), (None, None), ("aab", "baa"), ("x", "y")]
    got = compare.entropy_ncd(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    for r in got:
        x, y = r.a or "", r.b or ""
        assert abs(r.entropy_ncd - (1 - (entropy(x + y) - min(entropy(x), entropy(y))) / max(entropy(x), entropy(y)))) < 1e-9


def test_candidate_comparison(people):
    a, b, gold, da, db, dg = people
    of = {x[0]: (x[1], x[2] or "") for x in a + b}
    for only in (False, True):
        matrix = linkage.similarity_matrix(da, db, dg, "id", ["name", "city"], ["name"], 2, 100, only_gold=only)
        want = {(x[0], y[0]) for x in a for y in b if x[1][:2] == y[1][:2] and (not only or (x[0], y[0]) in gold)}
        got = {(r.id1, r.id2): r for r in matrix.collect()}
        assert set(got) == want and matrix.count() == len(want)
        assert all(r.is_match == ((i, j) in gold) for (i, j), r in got.items())
        assert all(r.overlap == 1.0 for (i, j), r in got.items() if of[i] == of[j])  # each table has its own number of hashes
    every = linkage.matrices(da, db, dg, "id", {"atts-1": ["name"], "atts-2": ["name", "city"]}, ["name"], [1, 3], 100)
    assert set(every) == {(n, k) for n in ("atts-1", "atts-2") for k in (1, 3)}
    assert every["atts-1", 1].count() == sum(x[1][:1] == y[1][:1] for x in a for y in b)


def test_blocks(spark, people):
    a, b, gold, da, db, dg = people
    pairs = blocking.candidate_pairs(blocking.prefix_blocks(da, ["name"], 3), blocking.prefix_blocks(db, ["name"], 3), "id", "id")
    assert set(rows(pairs)) == {(x[0], y[0]) for x in a for y in b if x[1][:3] == y[1][:3]}
    found = blocking.pair_completeness(pairs, dg).first()
    assert (found["gold"], found["found"], found["completeness"]) == (len(set(gold)), len(set(gold)), 1.0)
    assert blocking.pair_completeness(pairs.filter("false"), dg).first()["completeness"] == 0.0
    coded = da.withColumns({"qgrams": F.split("name", " "), "positions": F.array(F.lit(1), F.lit(5))})
    for method in ("prefix", "soundex", "minhash", "hamming", "none"):
        made = blocking.blocks_by(coded, method, "id", ["name"], m=20)
        assert made.columns == ["blk_key", "node"] and {r.node for r in made.collect()} == {x[0] for x in a}
    with pytest.raises(ValueError):
        blocking.blocks_by(coded, "x", "id", ["name"])
    one_block = blocking.blocks_by(coded, "none", "id", [])
    assert one_block.select("blk_key").distinct().count() == 1
    left, right = (spark.createDataFrame(t, "blk_key string, node string") for t in ([("k", "a"), ("l", "a"), ("m", "c")], [("k", "b"), ("l", "b"), ("n", "d")]))
    assert rows(blocking.shared_blocks(left, right)) == [("a", "b")]
    assert abs(blocking.minhash_threshold(4, 50) - 0.376) < 1e-3 and abs(blocking.minhash_curve(0.5, 4, 50) - 0.96032) < 1e-5
    assert (encode.optimal_hashes(200, 9), encode.dynamic_length(8, 10), blocking.hash_count(100, 9.0)) == (15, 116, round(math.log(2) * 100 / 9))


@pytest.fixture(scope="module")
def net(spark):
    source = random.Random(1)
    edges = [(f"n{a:02d}", f"n{b:02d}", round(source.random(), 3)) for a, b in itertools.combinations(range(18), 2) if source.random() < 0.2]
    nodes = [(f"n{i:02d}", [str(i), str(100 - i)], [[f"v{i % 7}", "w"]], 1 + i % 3) for i in range(20)]
    return edges, nodes, spark.createDataFrame(edges, "src string, dst string, sim double"), spark.createDataFrame(nodes, "node string, ent_ids array<string>, org_vals array<array<string>>, freq int")


def test_graph_changes(spark, net):
    edges, nodes, de, dn = net
    raw = spark.createDataFrame([("b", "a", 0.1), ("a", "b", 0.4), ("c", "c", 1.0)], "src string, dst string, sim double")
    assert rows(graph.add_edges(raw)) == [("a", "b", 0.4)]
    linked = {x for e in edges for x in e[:2]}
    assert {r.node for r in graph.without_singletons(dn, de).collect()} == linked
    ids = {n: e for n, e, *_ in nodes}
    want = collections.Counter((min(p, q), max(p, q), s) for a, b, s in edges for p in ids[a] for q in ids[b])
    assert collections.Counter(rows(graph.entity_pairs(dn, de))) == want
    assert rows(graph.common_values(dn, dn.filter("node > 'n08'")), "value")[0] == ("v0 w", "n00", "n14")
    report = {(r.measure, r.threshold, r.value): r.n for r in graph.graph_report(dn, de, [0.5]).collect()}
    kept = [e for e in edges if e[2] >= 0.5]
    degree = collections.Counter(x for e in kept for x in e[:2])
    assert report["nodes", None, None] == 20 and report["singletons", None, None] == 20 - len(linked) and report["edges_at", 0.5, None] == len(kept)
    assert {k[2]: n for k, n in report.items() if k[0] == "degree"} == collections.Counter(degree.values())
    assert sum(k[2] * n for k, n in report.items() if k[0] == "component_size") == len(degree)
    assert {k[2]: n for k, n in report.items() if k[0] == "node_freq"} == collections.Counter(n[3] for n in nodes)


def test_ranks_and_centralities(net):
    """Against the definitions, in numpy."""
    edges, _, de, _ = net
    kept = [e for e in edges if e[2] >= 0.3]
    names = sorted({x for e in kept for x in e[:2]})
    at = {x: i for i, x in enumerate(names)}
    adjacent = np.zeros((len(names),) * 2)
    for a, b, _ in kept:
        adjacent[at[a], at[b]] = adjacent[at[b], at[a]] = 1
    rank, n = np.full(len(names), 1 / len(names)), len(names)
    for _ in range(30):
        rank = 0.15 / n + 0.85 * adjacent @ (rank / adjacent.sum(axis=1))
    got = {r.node: r.pagerank for r in graph.pagerank(de, 0.3).collect()}
    assert all(abs(got[x] - rank[at[x]]) < 1e-12 for x in names) and len(got) == n
    x = np.ones(n)
    for _ in range(50):
        x = adjacent @ x + x
        x /= np.linalg.norm(x)
    got = {r.node: r.eigenvec_central for r in graph.eigenvector(de, 0.3).collect()}
    assert all(abs(got[v] - x[at[v]]) < 1e-9 for v in names)
    far = np.where(adjacent > 0, 1.0, np.inf)
    np.fill_diagonal(far, 0)
    for k in range(n):
        far = np.minimum(far, far[:, [k]] + far[[k], :])
    paths = np.eye(n)
    for d in range(1, n):
        for i in range(n):
            for j in np.flatnonzero(far[i] == d):
                paths[i, j] = sum(paths[i, k] for k in np.flatnonzero(adjacent[j]) if far[i, k] == d - 1)
    got = {r.node: r for r in graph.path_centralities(de, 0.3).collect()}
    for v in range(n):
        seen = np.isfinite(far[v])
        close = (seen.sum() - 1) / far[v][seen].sum() * (seen.sum() - 1) / (n - 1)
        between = sum(paths[i, v] * paths[v, j] / paths[i, j] for i in range(n) for j in range(n) if len({i, j, v}) == 3 and np.isfinite(far[i, j]) and far[i, v] + far[v, j] == far[i, j])
        r = got[names[v]]
        assert abs(r.closeness_central - close) < 1e-9 and abs(r.between_central - between / ((n - 1) * (n - 2))) < 1e-9


def test_neighbour_histograms(net):
    edges, _, de, _ = net
    near, close = collections.defaultdict(set), collections.defaultdict(set)
    for a, b, s in edges:
        near[a].add(b), near[b].add(a)
        if s >= 0.4:
            close[a].add(b), close[b].add(a)
    bucket = lambda xs: collections.Counter(int(math.log2(len(near[x]))) for x in xs)
    for r in graph.neighbourhood_features(de, 0.4).collect():
        n = r["node"]
        second = {y for m in near[n] for y in close[m]} - {n} - close[n]
        for name, want in (("degree_histo1", bucket(close[n])), ("degree_histo2", bucket(second))):
            got = {int(c.split("-b")[1].split("-")[0]): r[c] for c in r.asDict() if c.startswith(name)}
            assert {b: v for b, v in got.items() if v} == dict(want)


def test_features(spark):
    a = spark.createDataFrame([("x", 0.5, 2.0, 1.0), ("y", 0.5, 4.0, 1.0), ("z", 0.5, 4.0, 1.0)], "node string, u double, v double, w double")
    b = spark.createDataFrame([("x", 0.5, -1.0, 1.0), ("y", 0.5, 0.0, 1.5)], "node string, u double, v double, w double")
    names = ["u", "v", "w"]
    ends = graph.joint_range([a, b], names)
    assert ends.first().asDict() == {"u_min": 0.5, "u_max": 0.5, "v_min": -1.0, "v_max": 4.0, "w_min": 1.0, "w_max": 1.5}
    assert rows(graph.normalise(a, names, ends), "node") == [("x", 0.0, 0.6, 0.0), ("y", 0.0, 1.0, 0.0), ("z", 0.0, 1.0, 0.0)]
    assert {r.variable: round(r.deviation, 6) for r in graph.feature_deviations(a, names).collect()} == {"u": 0.0, "v": 0.942809, "w": 0.0}
    assert [graph.selected_features(a, b, names, m) for m in ("all", "nonzero", 1, 0.5)] == [names, ["v", "w"], ["v"], ["v"]]
    assert rows(graph.rare_vectors(a, names, 1)) == [("x", 0.5, 2.0, 1.0)]


def test_walks_and_embeddings(net):
    edges, _, de, _ = net
    near = collections.defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b), near[b].add(a)
    walked = graph.walks(de, number=2, length=6)
    got = walked.collect()
    assert collections.Counter(r.node for r in got) == {n: 2 for n in near}
    assert all(len(r.walk) == 6 and r.walk[0] == r.node and all(y in near[x] for x, y in zip(r.walk, r.walk[1:])) for r in got)
    vectors = graph.embeddings(walked, dimensions=5, rounds=1).collect()
    assert {r.word for r in vectors} == set(near) and all(len(r.vector) == 5 for r in vectors)


@pytest.fixture(scope="module")
def scored(spark):
    source = random.Random(2)  # the same keys on both sides
    data = sorted({(f"k{source.randrange(9)}", f"k{source.randrange(9)}"): round(0.3 + 0.7 * source.random(), 1) for _ in range(26)}.items())
    return [(q, b, s) for (q, b), s in data], spark.createDataFrame([(q, b, s) for (q, b), s in data], "qg string, ba string, score double")


def sides(data, least):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for q, b, s in data:
        if s >= least:
            root[find(("q", q))] = find(("b", b))
    return find


def test_bipartite_components(spark, scored):
    data, df = scored
    few = spark.createDataFrame([("a", "x", 0.9), ("c", "x", 0.8), ("b", "a", 0.7)], "qg string, ba string, score double")
    parts = {(r.qg, r.ba): r.component for r in match.bipartite_components(few, 0.0).collect()}
    assert parts["a", "x"] == parts["c", "x"] != parts["b", "a"]
    assert {(r.qg, r.ba) for r in match.hungarian(few).collect()} == {("a", "x"), ("b", "a")}
    find, got = sides(data, 0.7), match.bipartite_components(df, 0.7).collect()
    assert sorted((r.qg, r.ba, r.score) for r in got) == sorted(x for x in data if x[2] >= 0.7)
    assert len({(find(("q", r.qg)), r.component) for r in got}) == len({r.component for r in got}) == len({find(("q", r.qg)) for r in got})
    at = match.threshold_for_size(df, 2, 4)
    find = sides(data, at)
    count = collections.defaultdict(lambda: (set(), set()))
    for q, b, s in data:
        if s >= at:
            count[find(("q", q))][0].add(q)
            count[find(("q", q))][1].add(b)
    assert 2 <= max(max(map(len, x)) for x in count.values()) <= 4


def test_hungarian_is_optimal(spark):
    source = random.Random(6)
    data = [(f"k{i}", f"k{j}", round(0.1 + 0.9 * source.random(), 3)) for i in range(5) for j in range(6) if source.random() < 0.7]
    got = match.hungarian(spark.createDataFrame(data, "qg string, ba string, score double")).collect()
    assert len({r.qg for r in got}) == len({r.ba for r in got}) == len(got)
    value = {(q, b): s for q, b, s in data}
    best = max(sum(value.get((f"k{i}", f"k{j}"), 0) for i, j in enumerate(p)) for p in itertools.permutations(range(6), 5))
    assert abs(sum(r.score for r in got) - best) < 1e-9


def test_stable_matching_has_no_blocking_pair(scored):
    data, df = scored
    got = {r.qg: (r.ba, r.score) for r in match.stable(df).collect()}
    of = {b: (q, s) for q, (b, s) in got.items()}
    assert not [(q, b) for q, b, s in data if s > got.get(q, ("", -1))[1] and s > of.get(b, ("", -1))[1]]
    every = match.random_matching(df, all_edges=True)
    assert every.count() == len(data)


def test_confident_matching(spark, scored):
    data, df = scored

    def rounds(data):
        left, out = list(data), set()
        while left:
            total, count = collections.Counter(), collections.Counter()
            for q, b, s in left:
                for x in (("q", q), ("b", b)):
                    total[x] += s
                    count[x] += 1

            def conf(q, b, s):
                others = count["q", q] + count["b", b] - 2
                return s / ((total["q", q] + total["b", b] - 2 * s) / others) if others else s / 0.4

            order = sorted(left, key=lambda e: (-e[2], -round(conf(*e), 12), e[0], e[1]))
            first = {}
            for e in order:
                first.setdefault(("q", e[0]), e), first.setdefault(("b", e[1]), e)
            best = {e for e in order if first["q", e[0]] == e == first["b", e[1]]}
            out |= best
            used = {x for q, b, _ in best for x in (("q", q), ("b", b))}
            left = [e for e in left if not {("q", e[0]), ("b", e[1])} & used]
        return out

    assert set(rows(match.confident(df).select("qg", "ba", "score"))) == rounds(data)


def test_weights_and_edge_bands(spark, scored):
    _, df = scored
    made = match.normalised(match.confidences(df.withColumnRenamed("score", "cos_sim"), 0.3))
    got = match.weighted(made, ((1.0, 0.0, 0.0), (0.6, 0.3, 0.1)))
    plain = {(r.qg, r.ba): r for r in made.collect()}
    for r in got.collect():
        p, w = plain[r.qg, r.ba], [float(x) for x in r.weights.split("/")]
        assert abs(r.score - (w[0] * p.cos_sim + w[1] * p.sim_conf + w[2] * p.degree_conf)) < 1e-12
    a = spark.createDataFrame([("k", "a1", [1, 2]), ("l", "a1", [1, 2]), ("k", "a2", [1, 9])], "blk_key string, node string, positions array<int>")
    b = spark.createDataFrame([("k", "b1", [1, 2]), ("l", "b1", [1, 2])], "blk_key string, node string, positions array<int>")
    ea = spark.createDataFrame([("a1", "a3", 0.9), ("a2", "a3", 0.2)], "src string, dst string, sim double")
    eb = spark.createDataFrame([("b1", "b2", 0.85)], "src string, dst string, sim double")
    assert rows(match.compare_blocks(a, b, 10, 0.0), "qg") == [("a1", "b1", 1.0), ("a2", "b1", 0.8)]
    assert rows(match.compare_blocks_by_edges(a, b, ea, eb, 10, 0.0, 0.1, 0.1, 0.5)) == [("a1", "b1", 1.0)]


def test_reidentification(spark):
    matches = spark.createDataFrame([("p", "e", 0.9), ("r", "f", 0.8), ("s", "g", 0.7)], "qg string, ba string, score double")
    plain = spark.createDataFrame([("p", ["2", "1"]), ("r", ["3"]), ("s", ["4"])], "node string, ent_ids array<string>")
    encoded = spark.createDataFrame([("e", ["1"]), ("f", ["9"]), ("g", ["8"])], "node string, ent_ids array<string>")
    a = spark.createDataFrame([("1", ["ann"]), ("3", ["jonathan"]), ("4", ["x"])], "ent_id string, attrs array<string>")
    b = spark.createDataFrame([("1", ["ann"]), ("9", ["jonathann"]), ("8", ["unlike"])], "ent_id string, attrs array<string>")
    got = match.reidentified(matches, plain, encoded, a, b)
    assert [(r.qg, r.id_a, r.id_b, r.correct, r.similar) for r in got.orderBy("qg").collect()] == [("p", "1", "1", True, True), ("r", "3", "9", False, True), ("s", "4", "8", False, False)]


@pytest.mark.parametrize("matching", ["hungarian", "confident"])
def test_evaluation(spark, matching):
    source = random.Random(3)
    words = ["".join(source.choice("abcdef") for _ in range(6)) for _ in range(25)]
    records = spark.createDataFrame([(str(i), [w, words[(i + 1) % 5]]) for i, w in enumerate(words)], "ent_id string, attrs array<string>")
    spec = attack.AttackSpec(m=200, k=5, thresholds=[0.2], weights=((1.0, 0.0, 0.0),), blocking="none", matching=matching, centralities=True)
    plain, encoded = attack.plain_graph(records, spec), attack.encoded_graph(records, spec)
    features = attack.node_features(*plain, spec, 8).columns
    assert {"pagerank-0.20", "between_central-0.20", "closeness_central-0.20", "eigenvec_central-0.20"} <= set(features)
    got = {r.cutoff: (r.correct, r.wrong) for r in attack.evaluate(plain, encoded, records, records, spec).collect()}
    assert sum(got[0]) >= got[10][0] + got[10][1] > 0


def test_similarity_models(spark, tmp_path):
    source = random.Random(5)
    data = [(f"a{i}", f"b{i}", x := source.random(), 0.2 + 0.5 * x + 0.02 * source.random()) for i in range(400)]
    df = spark.createDataFrame(data, "id1 string, id2 string, plain double, encoded double")
    for kind in ("linear", "isotonic", "poly"):
        model, quality = regress.trained_and_tested(df, ["id1", "id2"], ["plain"], "encoded", kind)
        assert quality.first()["r2"] > 0.97
        model.save(str(tmp_path / kind))
        again = regress.SimilarityModel.load(str(tmp_path / kind))
        assert rows(again.predict(df).select("id1", "adjusted"), "id1") == rows(model.predict(df).select("id1", "adjusted"), "id1")
    got = regress.regression_quality(df, "plain", "encoded").first()
    p, y = (np.array([r[i] for r in data]) for i in (2, 3))
    assert np.allclose([got["mse"], got["mean"], got["largest"], got["r2"]], [((y - p) ** 2).mean(), abs(y - p).mean(), abs(y - p).max(), 1 - ((y - p) ** 2).mean() / y.var()])
    edges = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.1)], "src string, dst string, sim double")
    assert rows(regress.adjusted_edges(edges, 2.0, 0.1, 0.5)) == [("a", "b", 1.1)]
    pairs = spark.createDataFrame([(i, i % 4 == 0, i / 100) for i in range(100)], "i int, m boolean, cos double").withColumn("m", F.col("m").cast("int"))
    histogram = regress.cosine_histogram(pairs, "cos", "m", ["i"], 1, 2).collect()
    assert [sum(r.n for r in histogram if r.is_match == k) for k in (0, 1)] == [50, 25]
    capped = regress.sample_per_class(pairs, "cos", ["i"], 3)
    assert set(rows(capped.groupBy("sim_class").count().select("count"))) == {(3,), (1,)}


@pytest.fixture(scope="module")
def matrix(spark):
    def made(seed, shift):
        source = random.Random(seed)
        out = []
        for i in range(300):
            y = int(i % 6 == 0)
            base = (0.8 if y else 0.35) + shift
            out.append((f"{seed}a{i}", f"b{i}", *(min(1.0, max(0.0, base + source.gauss(0, 0.08))) for _ in range(5)), y))
        return spark.createDataFrame(out, "id1 string, id2 string, dice double, jaccard double, overlap double, hamming double, entropy double, is_match int")

    return made(1, 0.0), made(2, 0.02)


def test_transfer(spark, matrix):
    source, target = matrix
    kinds = {k: transfer.Classifier(k).fit(source, transfer.METRICS, "is_match") for k in ("logistic", "svm", "forest", "boosted")}
    for model in kinds.values():
        p = model.proba(target)
        assert metrics.quality(p, (F.col("pp") >= 0.5).cast("int"), "is_match").first()["f1"] > 0.95
        assert p.filter("pp < 0 OR pp > 1").count() == 0
    with pytest.raises(ValueError):
        transfer.Classifier("x").fit(source, transfer.METRICS, "is_match")
    seen = transfer.confident_instances(transfer.Classifier().fit(transfer.domain_data(source, target, transfer.METRICS), transfer.METRICS, "domain"), source, 0.5)
    assert 0 < seen.count() < source.count() and seen.filter("pp < 0.5").count() == 0
    even = transfer.balanced(seen, 3, 0.1)
    assert even.filter("is_match = 0").count() == min(27, seen.filter("is_match = 0").count())
    assert transfer.first_matches(source, 4, ["id1", "id2"]).filter("is_match = 1").count() == 4
    moved = transfer.coral(source, target, transfer.METRICS, ridge=1e-6)
    got, want = ({(r.a, r.b): r.covariance for r in transfer.covariance(t, transfer.METRICS).collect()} for t in (moved, target))
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)
    strategies = {r.stage1_strategy: r for r in transfer.transfer(source, target, least=0.4, share=0.2).collect()}
    assert {"naive", "tl-base", "tl_pprl", "tl_pprl++", "coral", "tl_pprl-w:pp2"} <= set(strategies) and strategies["tl-base"].f1 > 0.9
    few = {r.stage1_strategy: r.status for r in transfer.transfer(source.filter("is_match = 0"), target).collect()}
    assert few["tl-base"].startswith("0 matches")


def test_source_ranking_and_grid(spark, matrix):
    source, target = matrix
    bound = transfer.source_bound(source, target)
    assert 0 <= bound["e_s"] < 0.05 and abs(bound["et"] - bound["e_s"] - bound["dhh"] - bound["complement"]) < 1e-12
    ranked = transfer.rank_sources({"s": source, "bad": source.drop("dice")}, {"t": target, "s": source})
    assert [(r["source"], r["target"], r["status"] == "ok", r["e_s"] == -1.0) for r in ranked] == [("s", "t", True, False), ("bad", "t", False, True), ("bad", "s", False, True)]
    grid = transfer.run_grid({"s": source}, {"t": target}).collect()
    plain = [r for r in grid if r.stage1_strategy.startswith("threshold:")]
    assert len(plain) == 3 and {r.source for r in grid} == {"", "s"} and all(r.actual_1 == 50 for r in grid if r.status == "ok")
    left = spark.createDataFrame([("x", 1), ("y", 2)], "scenario string, a int")
    right = spark.createDataFrame([("x", "pp", "svm", 1, 5), ("x", "pp2", "svm", 2, 6)], "scenario string, stage1_weight string, stage1_model string, a int, b int")
    assert rows(metrics.merge_experiments(left, right, 2, "pp", "svm"), "scenario") == [("x", 1, 1, 5), ("y", 2, None, None)]
    q = metrics.quality(spark.createDataFrame([(1, 1), (0, 1)], "p int, y int"), "p", "y", prefix="s2_").first()
    assert (q["s2_precision"], q["s2_recall"]) == (1.0, 0.5)


def test_encodings(people):
    _, _, _, da, _, _ = people
    for kind, most in (("rbf", 64), ("rbf-d", 64), ("random", 64), ("tab", 64), ("two-step", 1 << 32)):
        spec = encode.EncodeSpec(kind, ("name", "city"), m=64, k=4)
        code = "codes" if kind == "two-step" else "positions"
        first, second = ({r["id"]: list(r[code]) for r in encode.encode(da, "id", spec).collect()} for _ in range(2))
        assert first == second and len(first) == 20 and all(0 <= p < most for v in first.values() for p in v)
    same = encode.encode(da.withColumn("name", F.lit("x")).withColumn("city", F.lit("y")), "id", encode.EncodeSpec("rbf-d", ("name", "city"), m=64))
    assert same.select("positions").distinct().count() == 1
    assert encode.mean_qgrams(da, F.split("name", ""), "last_row", "id") == len([x for x in people[0] if x[0] == "a9"][0][1])


def test_streams(spark, people, tmp_path):
    a, b, _, da, db, _ = people
    da.write.parquet(str(tmp_path / "in"))
    arriving = lambda: spark.readStream.schema(da.schema).parquet(str(tmp_path / "in"))
    index = blocking.prefix_blocks(db, ["name"], 2).select("id", "blk_key")
    encode_stream.link_stream(arriving(), index, "id", ["name"], 2, str(tmp_path / "pairs"), str(tmp_path / "c1")).awaitTermination(120)
    assert set(rows(spark.read.parquet(str(tmp_path / "pairs")))) == {(x[0], y[0]) for x in a for y in b if x[1][:2] == y[1][:2]}
    spec = encode.EncodeSpec("clk", ("name",), m=100)
    coded = encode_stream.encoded_stream(arriving(), "id", spec)
    coded.writeStream.format("parquet").option("path", str(tmp_path / "codes")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(rows(spark.read.parquet(str(tmp_path / "codes")))) == sorted(rows(encode.encode(da, "id", spec)))
    with pytest.raises(ValueError):
        encode_stream.encoded_stream(arriving(), "id", encode.EncodeSpec("rbf-d", ("name",)))
