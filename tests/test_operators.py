import itertools
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilink.operators import blocking, encode, graph, hardening, match, prep, transfer
from veilink.sources import readers, sinks


@pytest.fixture(scope="module")
def random_edges(spark):
    source = random.Random(1)
    rows = [(f"n{a:02d}", f"n{b:02d}", round(source.random(), 3)) for a, b in itertools.combinations(range(16), 2) if source.random() < 0.2]
    return rows, spark.createDataFrame(rows, "src string, dst string, sim double")


def near_of(rows, least):
    out = {}
    for a, b, s in rows:
        if s >= least:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def test_components_and_ego_networks(random_edges):
    rows, df = random_edges
    near, close = near_of(rows, 0), near_of(rows, 0.4)
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[n] == min(seen)
    for r in graph.neighbourhood_features(df, 0.4).collect():
        n, own = r["node"], close.get(r["node"], set())
        ego = own | {n}
        assert r["egonet_degree-0.40"] == sum(y not in ego for x in own for y in near[x])
        inner = len(own) + sum(y in own for x in own for y in near[x]) / 2
        assert abs(r["egonet_density-0.40"] - (inner / (len(own) * (len(own) + 1) / 2) if own else 0)) < 1e-9


def test_matchings(spark, random_edges):
    rows, _ = random_edges
    scored = spark.createDataFrame([(f"q{a}", f"b{b}", s) for a, b, s in rows], "qg string, ba string, score double")
    want, used = set(), set()
    for s, a, b in sorted((-s, f"q{a}", f"b{b}") for a, b, s in rows):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    assert {(r.qg, r.ba) for r in match.greedy(scored).collect()} == want
    chosen = match.random_matching(scored).collect()
    assert len({r.qg for r in chosen}) == len({r.ba for r in chosen}) == len(chosen)


def test_assignment_is_optimal():
    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (4, 6), (1, 5), (5, 5)):
        cost = rng.random((n, m)).round(3)
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        pairs = match.assignment(cost)
        assert sorted(i for i, _ in pairs) == list(range(n)) and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9


def test_confidence_goldens(spark):
    df = spark.createDataFrame([("q1", "b1", 0.9), ("q1", "b2", 0.8), ("q2", "b1", 0.7), ("q3", "b3", 0.6)], "qg string, ba string, cos_sim double")
    got = {(r.qg, r.ba): (round(r.sim_conf, 6), round(r.degree_conf, 6)) for r in match.confidences(df, 0.2).collect()}
    assert got == {("q1", "b1"): (1.2, 0.333333), ("q1", "b2"): (0.888889, 0.5), ("q2", "b1"): (0.777778, 0.5), ("q3", "b3"): (6.0, 1.0)}
    best = match.mutual_best(df.withColumnRenamed("cos_sim", "score"))
    assert {(r.qg, r.ba) for r in best.collect()} == {("q1", "b1"), ("q3", "b3")}


def test_constants():
    assert [transfer.non_matches_to_keep(10, p) for p in (0.1, 0.01)] == [90, 990]
    assert encode.dynamic_length(8, 10) == 116 and encode.optimal_hashes(200, 9) == 15
    assert round(blocking.minhash_threshold(4, 50), 3) == 0.376 and round(blocking.minhash_curve(0.5, 4, 50), 5) == 0.96032


def test_markov_frequency_model_is_monotone(spark):
    words = spark.createDataFrame([(w,) for w in "hello world,hello,world,world,hallo,hall,worry,holden,halo,heli".split(",")], "w string")
    model = hardening.transitions(words, "w")
    sets = spark.createDataFrame([(1, ["he", "el"]), (2, ["he", "el", "wo"]), (3, [])], "id int, q array<string>")
    got = {r.id: set(r.extra) for r in hardening.expand(sets, "id", "q", model).collect()}
    assert got[1] and got[1] <= got[2] and got[3] == set()


def test_coral_moves_covariance(spark):
    rng = np.random.default_rng(4)
    table = lambda scale: spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(0, scale, (200, 2))], "x double, y double")
    source, target = table(1.0), table(3.0)
    spread = transfer.coral(source, target, ["x", "y"], 1e-6).agg(F.var_samp("x")).first()[0]
    assert 5 < spread < 14


def test_profile_and_samples(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, v string")
    assert prep.profile(df, ["v"]).collect()[0].asDict() == {"variable": "v", "count": 3, "unique": 2, "top": "b", "freq": 2, "missing": 1}
    sample = prep.linkage_sample(df, df.filter("id < 3"), "id", 2, 0.5)
    assert sample.filter("side = 'b'").count() == 1 and sample.filter("side = 'a'").count() == 2


def test_archive_and_matrix_round_trip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("a.csv", "id;name\n1;x\n2;\n")
        z.writestr("b.csv", "id;name\n7;y\n")
        z.writestr("gold.csv", "id1;id2\n1;7\n")
    a, b, gold = readers.linkage_set(spark, str(tmp_path / "set.zip"), ["id", "name"], ["id", "name"])
    assert [tuple(r) for r in a.orderBy("id").collect()] == [("1", "x"), ("2", "")] and b.count() == gold.count() == 1
    matrix = spark.createDataFrame([("1", "7", 0.5, 0.4, 0.6, 1.0, 0.9, 1)], readers.COMPARISON)
    sinks.save_matrices({("atts-1", 2): matrix}, str(tmp_path / "m"))
    assert readers.comparison_matrix(spark, str(tmp_path / "m"), "atts-1", 2, zipped=False).collect() == matrix.collect()
    assert readers.size_from_name("/x/ds_a_500_z.zip") == 500


def test_token_records_carry(spark):
    lines = spark.createDataFrame([(1, "1;F_ann;L_x;G_1;PR_p"), (2, "2;F_bob")], "n int, value string")
    plain = readers.token_records(lines).orderBy("id").collect()
    carried = readers.token_records(lines, carry_from="n").orderBy("id").collect()
    assert (plain[0].gender, plain[1].lastname, plain[1].prof) == ("Female", None, None)
    assert (carried[1].lastname, carried[1].firstname, carried[1].prof) == ("x", "bob", None)
