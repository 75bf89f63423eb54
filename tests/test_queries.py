"""Every registered query of the engine against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from ctxgraph.queries import ORACLE_SQL, QUERIES
from ctxgraph.sources.views import TABLES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    show = lambda v: "~" if v is None else format(v, ".9g") if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        assert got
        return
    r = duck.execute(ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, got) == rows(cols, r.fetchall())


def test_registered_names_match():
    assert set(ORACLE_SQL) <= set(QUERIES)
