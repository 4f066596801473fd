"""Every query with an oracle, side by side with it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry  # noqa: E402
from parchmint.plans import catalog

DATA = entry.SMOKE
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows or name in ("quality_regressions",)
    if name in catalog.ORACLES:
        r = db.sql(catalog.ORACLES[name])
        assert sorted(r.columns) == columns
        want = sorted((tuple(plain(dict(zip(r.columns, x))[c]) for c in columns) for x in r.fetchall()), key=repr)
        assert rows == want


def test_contract(spark):
    assert entry.entry(spark).columns == ["doc_id", "block", "kind", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
