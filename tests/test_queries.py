"""Every query of the registry against its SQL on DuckDB."""

import os

import duckdb
import pytest

from loomspark.plans import surface as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    want = duck.sql(registry.ORACLES[name])
    cols = sorted(want.columns)
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == cols
    rows = sorted((tuple(r) for r in got.select(*cols).collect()), key=repr)
    assert rows == sorted(want.select(*[f'"{c}"' for c in cols]).fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
