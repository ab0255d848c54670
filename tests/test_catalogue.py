import math

import duckdb
import pytest

import __spark_entry__ as entry
from veilink import catalogue, catalogue_linkage  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


def plain(v):
    return None if v is None or v != v else float(v) if isinstance(v, float) else v


def same(a, b):
    return len(a) == len(b) and all(
        all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, abs_tol=2e-6) for x, y in zip(r, s)) for r, s in zip(a, b)
    )


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert same(got, want)


@pytest.mark.parametrize("name", ["bloom_xxh64", "record_bloom", "blip_filters", "tab_minhash", "two_step_hash_png", "minhash_bands", "greedy_match", "laplace_similarities"])
def test_other_queries_give_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["id1", "id2", "dice", "jaccard", "overlap", "is_match"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
