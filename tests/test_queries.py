"""Every registered query against its check SQL on the smallest data set."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.views import BASE_TABLES

_spec = importlib.util.spec_from_file_location(
    "check_sql", Path(__file__).resolve().parent.parent / "tools" / "check_sql.py"
)
check_sql = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check_sql)

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, sf_dir, duck, key):
    df = QUERIES[key](spark, sf_dir)
    got = df.collect()
    if key not in SQL:
        assert got
        return
    cur = duck.execute(SQL[key])
    names = [d[0] for d in cur.description]
    assert check_sql.compare(df.columns, got, names, cur.fetchall()) == "ok"


def test_every_check_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).collect()
