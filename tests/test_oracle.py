"""Every query with SQL gives that SQL's rows on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from simgraph.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "events", "lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame):
    """Sorted rows with columns by name; missing values are one thing, numbers another."""
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if x is None or x != x else x if isinstance(x, str) else round(float(x), 6)
    return sorted((tuple(clean(x) if x is None or not hasattr(x, "dtype") or x.dtype.kind in "fiub" else str(x) for x in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    got, want = (f.astype(object).where(f.notna(), None) for f in (got, want))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
