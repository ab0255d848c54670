"""Readers and writers by round trip."""

import zipfile

import pytest
from pyspark.sql import functions as F

from veilink.operators import compare, prep
from veilink.sources import readers, sinks


@pytest.fixture
def archive(tmp_path):
    def make(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, text in members.items():
                z.writestr(member, text.encode("iso-8859-1"))
        return str(tmp_path / name)

    return make


MATRIX = "id1;id2;dice;jaccard;overlap;hamming;entropy;is_match\n{};x;0.5;0.25;1;0.75;;1\n"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_matrix_archives(spark, archive):
    path = archive("m_ncvr_500.zip", {"atts-1.csv": MATRIX.format("a"), "atts-1-blk-2.csv": MATRIX.format("b"), "atts-10.csv": MATRIX.format("c")})
    assert rows(readers.comparison_matrix(spark, path)) == [("c", "x", 0.5, 0.25, 1.0, 0.75, None, 1)]  # the last member that fits
    assert rows(readers.comparison_matrix(spark, path, block=2))[0][0] == "b"
    source, target, log = readers.matrices_of(spark, path, path, blocks=(2, None))
    assert (rows(source)[0][0], rows(target)[0][0]) == ("b", "c")
    assert rows(log) == [("ncvr", 500, "ncvr", 500, "atts-1", "atts-1")]
    with pytest.raises(Exception, match="no member fits"):
        readers.zipped_csv(spark, path, ["id1"], "nothing").collect()


def test_members(spark, archive):
    path = archive("t.zip", {"x.csv": "id;n\n1;é\n2;b;too;many\n3;c\n", "ax.csv": "id;n\n4;d\n", "y_ALL.csv": "id;n\n9;z\n", "z.txt": "n;id\nq;5\n", "no.pdf": "x"})
    exact = readers.zipped_csv(spark, path, ["id", "n"], "x.csv", encoding="iso-8859-1", exact=True)
    assert rows(exact, "id") == [("1", "é"), ("3", "c")]
    assert [r[0] for r in rows(readers.zipped_csv(spark, path, ["id"], "x.csv", encoding="iso-8859-1"), "id")] == ["4"]
    assert rows(readers.zipped_members(spark, path, ["id", "n"], "ALL"), "id") == [("1", "é"), ("3", "c"), ("4", "d"), ("5", "q")]
    got = readers.extract_member(spark, path, "ax.csv").collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("ax.csv", b"id;n\n4;d\n")] and readers.extract_member(spark, path, "ax").count() == 0
    assert readers.members_without(["a/X_ALL.csv", "a/b.TXT", "a/c.zip", "ALL/d.csv"], "ALL") == ["a/b.TXT", "ALL/d.csv"]


def test_delimited_files(spark, tmp_path):
    names = [f"c{i}" for i in range(70)]
    (tmp_path / "v.tsv").write_text("\t".join(names) + "\n" + "\t".join(f"é{i}" for i in range(70)) + "\n", encoding="iso-8859-1")
    voters = readers.state_voters(spark, str(tmp_path / "v.tsv"))
    assert voters.columns == ["ncid", "c2", "c10", "c11", "c9", "c28", "c29", "c13", "c14", "c1", "c15", "c16"]
    assert rows(voters)[0][:3] == ("é68", "é2", "é10")
    (tmp_path / "q.csv").write_text("# a comment\nid,name\n1,'a,b'\n", encoding="utf-8")
    assert rows(readers.csv(spark, str(tmp_path / "q.csv"), quote="'", comment="#")) == [("1", "a,b")]
    (tmp_path / "r.tsv").write_text("id\tzip\n1\t0\n", encoding="utf-8")
    (tmp_path / "d.tsv").write_text("id1\tid2\n1\t2\n", encoding="utf-8")
    a, b = readers.records_and_duplicates(spark, str(tmp_path / "r.tsv"), str(tmp_path / "d.tsv"))
    assert (a.columns, rows(b)) == (["id", "zip"], [("1", "2")])


def test_carried_tokens(spark):
    lines = [(i, t) for i, t in enumerate(["1;F_ann;L_lee;G_1;B3_1990", "2;F_bob", "3;L_kim;G_0", "4;PP1_rome", "5"] * 40)]
    df = spark.createDataFrame(lines, "n long, value string").repartition(7)
    got = {r.n: r for r in readers.token_records(df, carry_from="n").withColumn("n", F.lit(0)).collect()}
    assert len(got) == 1
    carried = readers.token_records(df, carry_from="n")
    counts = {(r.id, r.firstname, r.lastname, r.gender, r.by, r.city): r["count"] for r in carried.groupBy("id", "firstname", "lastname", "gender", "by", "city").count().collect()}
    assert counts[("5", "bob", "kim", "Male", None, "rome")] == 40  # carried over the ranges' borders
    assert counts[("1", "ann", "lee", "Female", "1990", None)] == 1 and counts[("1", "ann", "lee", "Female", "1990", "rome")] == 39
    plain = {(r.id, r.firstname) for r in readers.token_records(df).collect()}
    assert ("3", None) in plain


def test_feature_matrix_ends(spark):
    made, ends = readers.feature_matrix(spark.createDataFrame([("a", "0.5", "3"), ("b", "x", "-2")], "node_key string, u string, v string"))
    assert rows(made, "node_key") == [("a", 0.5, 3.0), ("b", None, -2.0)]
    assert ends.first().asDict() == {"u_min": 0.5, "u_max": 0.5, "v_min": -2.0, "v_max": 3.0}


def test_linkage_set_round_trip(spark, tmp_path, archive):
    a = spark.createDataFrame([("1", None), ("2", "x")], "id string, n string")
    b, gold = a.filter("id = '2'"), spark.createDataFrame([("1", "2")], "id1 string, id2 string")
    prep.save_all(a, b, gold, ["n"], str(tmp_path / "set"))
    got = readers.linkage_set(spark, str(tmp_path / "set"), ["id", "n"], ["id", "n"])
    assert [rows(t, t.columns[0]) for t in got] == [[("1", ""), ("2", "x")], [("2", "x")], [("1", "2")]]
    assert rows(spark.read.parquet(str(tmp_path / "set/stats_a")).select("variable", "count", "missing")) == [("n", 1, 1)]
    sinks.save_linkage_csv(a, b, gold, {"stats": gold}, str(tmp_path / "text"))
    assert rows(readers.csv(spark, str(tmp_path / "text/a"), ";").na.fill(""), "id") == [("1", ""), ("2", "x")]
    path = archive("set.zip", {"a.csv": "id;n\n1;\n", "b.csv": "id;n\n2;x\n", "gold.csv": "id1;id2\n1;2\n"})
    assert [rows(t) for t in readers.linkage_set(spark, path, ["id", "n"], ["id", "n"])] == [[("1", "")], [("2", "x")], [("1", "2")]]


def test_matrices_features_graphs_and_logs(spark, tmp_path):
    matrix = spark.createDataFrame([("a", "x", 0.5, 0.25, 1.0, 0.75, 0.1, 1)], readers.COMPARISON)
    stats = compare.comparison_stats(15, 200, ["name", "zip"], spark)
    sinks.save_matrices({("atts-1", None): matrix, ("atts-1", 2): matrix.withColumn("id1", F.lit("b"))}, str(tmp_path / "m"), stats)
    assert rows(readers.comparison_matrix(spark, str(tmp_path / "m"), "atts-1", 2, zipped=False))[0][0] == "b"
    assert rows(spark.read.parquet(str(tmp_path / "m-stats"))) == [(15, 200, 0, "name,zip")]
    features = spark.createDataFrame([("n", 1.0)], "node_key string, f double")
    for append in (False, True):
        sinks.save_features(features, str(tmp_path / "f"), append)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    edges = spark.createDataFrame([("n", "o", 0.5)], "src string, dst string, sim double")
    sinks.save_graph(features, edges, str(tmp_path / "g"))
    assert rows(spark.read.parquet(str(tmp_path / "g/edges"))) == rows(edges) and rows(spark.read.parquet(str(tmp_path / "g/nodes"))) == rows(features)
    for _ in range(2):
        sinks.append_log(edges, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert rows(sinks.competitor_input(matrix, ["dice", "jaccard"])) == [([0.5, 0.25], 1)]
    assert sinks.markdown(edges) == "| src | dst | sim |\n| --- | --- | --- |\n| n | o | 0.5 |"
    assert sinks.latex(edges.withColumn("src", F.lit("a_b"))).split("\n")[2] == r"a\_b & o & 0.5 \\"
    assert sinks.remove(spark, str(tmp_path / "log")) and not (tmp_path / "log").exists() and not sinks.remove(spark, str(tmp_path / "log"))
