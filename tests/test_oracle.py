"""Every registered query against its DuckDB oracle on the sf0.001 fixture
(the driver repeats this at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from basketlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v


def test_every_query_has_an_oracle():
    missing = set(registry.queries()) - set(E.oracle_sql())
    assert not missing


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == want


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["product_1", "product_2"]
    assert 0 < df.count() <= 100
