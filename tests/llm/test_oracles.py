"""Operators against their SQL on the smallest tables."""

import glob
import os

import pytest

BASE = "/root/testdata/sf0.001"


def _names():
    from tidelens.llm import queries

    return sorted(queries.ORACLE)


@pytest.mark.parametrize("name", _names())
def test_operator_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(BASE):
        pytest.skip("no test data")
    from tidelens.llm import queries

    con = duckdb.connect()
    for path in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[: -len('.parquet')]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, BASE)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLE[name])
    own = [c[0] for c in found.description]
    assert sorted(own) == columns
    want = sorted(repr(tuple(row[own.index(c)] for c in columns)) for row in found.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == want
