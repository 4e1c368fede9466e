"""Every query with SQL, against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tessera.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows and all(c for c in cols)  # the operators have tests of their own
        return
    got = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    assert sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in got.fetchall()) == rows
