"""Every catalogue query against its DuckDB twin on the sf0.001 tables."""

import math

import duckdb
import pytest

from tests.conftest import SF001
from tallyho.plans import completions, learning, nullable, runs  # noqa: F401  they register their queries
from tallyho.plans.catalog import ORACLE, QUERIES
from tallyho.sources.tables import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in recs]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    cols = df.columns
    got = _rows(cols, [tuple(r) for r in df.collect()])
    res = duck.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    want = _rows(ocols, res.fetchall())
    assert sorted(cols) == sorted(ocols)
    assert len(got) == len(want)
    assert got == want


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() == 3
    assert set(df.columns) == {"split", "n_rows", "n_pass", "n_fail", "pass_rate"}
