"""Every registered query with SQL equals it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from trajscreen.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "lineitem events documents embeddings labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else glob.glob(path)[0]}'")
    return con


def plain(v):
    return float(v) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted(repr([plain(v) for v in r]) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert got == want


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0
