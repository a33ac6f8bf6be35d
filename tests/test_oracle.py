"""Every core query against its SQL twin, on whole tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from brindle import catalogue

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_twin(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in sorted(names)]
    assert columns == sorted(names)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "n_loss_tokens" in df.columns


def test_every_query_is_registered(spark):
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert set(catalogue.queries()) <= set(entry.queries())
