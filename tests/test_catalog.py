"""Every query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

from palimpsest.plans import catalog

TABLES = "events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def key(row):
    return repr([str(round(float(v), 6)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in row])


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    got = sorted(key([r[c] for c in sorted(df.columns)]) for r in df.collect())
    if name in catalog.oracles():
        r = duck.execute(catalog.oracles()[name])
        columns = [x[0] for x in r.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == sorted(key([dict(zip(columns, x, strict=True))[c] for c in sorted(columns)]) for x in r.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
