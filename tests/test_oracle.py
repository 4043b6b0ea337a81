"""Every registered query that has a SQL counterpart, against it in DuckDB; the library's own all have one."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from scriptlode.plans import oracle, queries as P

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def ordered(rows, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


def test_every_query_has_a_counterpart():
    assert set(P.all_queries()) == set(oracle.all_sql())
    assert set(P.all_queries()) <= set(QUERIES) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = ordered([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(SQL[name])
    cols = [c[0] for c in result.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == ordered(result.fetchall(), cols)
    assert got, "no rows compared"


def test_entry(spark):
    rows = dict(tuple(r) for r in entry_points.entry(spark).collect())
    assert rows["nonempty_repos"] == 10 and rows["queries"] > 0


def test_facts_are_extracted_once(spark):
    assert P.catalog(spark, SF) is P.catalog(spark, SF)
