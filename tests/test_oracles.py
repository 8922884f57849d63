"""Every registered query against its DuckDB statement on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    return str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = [tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall()]
    got = [tuple(plain(row[c]) for c in columns) for row in frame.collect()]
    order = lambda row: [(x is None, str(x)) for x in row]
    assert sorted(got, key=order) == sorted(expected, key=order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    """On larger tables, where keys of lines repeat; the chains of fits read tables without such keys and take the small ones."""
    frame = QUERIES[name](spark, FOLDER if name in ("model_run", "model_corrector") else "/root/testdata/sf0.01")
    assert frame.count() > 0 and len(frame.columns) == len(set(frame.columns))


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_is_a_frame(spark):
    assert __spark_entry__.entry(spark).columns[0] == "mvt_id"
