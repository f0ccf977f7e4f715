"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as engine
from quarry import queries as core


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return None if x is None else str(x)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    return c


def compare(spark, small, con, name, queries, oracles):
    df = queries[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in oracles:
        r = con.execute(oracles[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        want = sorted((tuple(plain(v) for _, v in sorted(zip(names, row))) for row in r.fetchall()), key=str)
        assert got == want


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, small, con, name):
    compare(spark, small, con, name, core.QUERIES, core.ORACLES)


def test_entry(spark):
    assert engine.entry(spark).columns == ["fusion", "mode", "micro_precision", "micro_recall", "micro_f1", "macro_f1"]


def test_every_oracle_has_a_query():
    assert set(engine.oracle_sql()) <= set(engine.queries())
