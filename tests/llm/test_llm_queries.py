"""Every query of the subpackage against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quarry.llm import queries as llm


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    return c


@pytest.mark.parametrize("name", list(llm.QUERIES))
def test_query(spark, small, con, name):
    df = llm.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(str(r[c]) for c in cols) for r in df.collect()), key=str)
    if name in llm.ORACLES:
        r = con.execute(llm.ORACLES[name])
        names = [d[0] for d in r.description]
        assert got == sorted((tuple(str(v) for _, v in sorted(zip(names, row))) for row in r.fetchall()), key=str)


def test_columns(spark, small):
    want = {
        "p1_found": [("sample_id", "bigint"), ("defect", "string")],
        "p2_found": [("tbl", "string"), ("rec_id", "bigint"), ("start_pos", "bigint"), ("end_pos", "bigint")],
        "p3_found": [("tbl", "string"), ("id_a", "bigint"), ("id_b", "bigint")],
        "p5_found": [("sample_id", "bigint"), ("field", "string")],
        "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
        "p8_found": [("doc_id", "bigint")],
    }
    assert {n: llm.QUERIES[n](spark, small).dtypes for n in want} == want
