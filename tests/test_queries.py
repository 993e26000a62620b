"""Every query with SQL, held against DuckDB on whole small tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomspark.plans import reference, reference_numeric

PARTS = (reference, reference_numeric)
SQL = {k: v for p in PARTS for k, v in p.ORACLE_SQL.items()}
CORE = {k: v for p in PARTS for k, v in p.QUERIES.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, sf_dir, name):
    df = CORE[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert CORE[name](spark, sf_dir).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
