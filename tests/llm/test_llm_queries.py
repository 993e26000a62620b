import glob
import os

import duckdb
import pytest

from loomspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_found_columns(spark, sf_dir):
    assert queries.p1_found(spark, sf_dir).dtypes == [("regen_id", "bigint"), ("msg_pos", "int"), ("defect", "string")]
    assert queries.p6_found(spark, sf_dir).dtypes == [("regen_id", "bigint"), ("msg_pos", "int")]
    assert queries.p7_ids(spark, sf_dir).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
