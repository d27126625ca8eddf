"""Every query that has SQL, against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from sparkloom.plans import catalog

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    x = x.tolist() if hasattr(x, "tolist") else x
    return 0.0 if x == 0 and isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    got = catalog.queries()[name](spark, sf)
    columns = sorted(got.columns)
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = Counter(repr([plain(dict(zip(names, r, strict=True))[c]) for c in columns]) for r in rel.fetchall())
    assert Counter(repr([plain(r[c]) for c in columns]) for r in got.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
