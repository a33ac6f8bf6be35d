"""Queries of the training-data operators that SQL can express, against their twins."""

import os

import pytest

import __spark_entry__ as entry
from brindle.llm import queries as Q

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in sorted(names)]
    assert columns == sorted(names) and got == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_others_run(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.count() == len({tuple(map(str, r)) for r in df.collect()}) > 0
