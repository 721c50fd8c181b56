"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_oracle(spark, db, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    rel = db.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_whole_excerpts_and_lookups(spark, db):
    """Every file has its excerpt, some of them truncated; every path is looked up, deleted ones too."""
    n = db.sql("select count(*) from documents").fetchall()[0][0]
    found = __spark_entry__.queries()["source_excerpt_all"](spark, DATA)
    assert found.count() == n
    assert 0 < found.filter("truncated").count() < n
    hashes = __spark_entry__.queries()["hash_point_lookup_all"](spark, DATA)
    assert hashes.count() == n and hashes.filter("hash is null").count() > 0


def test_even_trade_has_no_edges(spark, tmp_path):
    """Where all nations trade alike, the walk has the SQL's one row, a null start."""
    pair = spark.range(625)
    tables = {
        "lineitem": pair.selectExpr("id l_orderkey", "id % 25 l_suppkey"),
        "orders": pair.selectExpr("id o_orderkey", "floor(id / 25) o_custkey"),
        "customer": spark.range(25).selectExpr("id c_custkey", "cast(id as int) c_nationkey"),
        "supplier": spark.range(25).selectExpr("id s_suppkey", "cast(id as int) s_nationkey"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = [(r["node"], r["depth"]) for r in __spark_entry__.queries()["reach_cyclic"](spark, str(tmp_path)).collect()]
    assert got == con.sql(__spark_entry__.oracle_sql()["reach_cyclic"]).fetchall() == [(None, 0)]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
