"""Registered queries against their SQL on the smallest tables."""

import glob
import os
from decimal import Decimal

import pytest

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(BASE):
        pytest.skip("no test data")
    con = duckdb.connect()
    for path in glob.glob(f"{BASE}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[: -len('.parquet')]} AS SELECT * FROM '{path}'")
    return con


def _names():
    from tidelens.plans import composed, feeds, landed, queries  # noqa: F401

    return sorted(queries.ORACLE)


@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, duck, name):
    from tidelens.plans import queries

    df = queries.QUERIES[name](spark, BASE)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLE[name])
    own = [c[0] for c in found.description]
    assert sorted(own) == columns
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    want = sorted(repr(tuple(plain(row[own.index(c)]) for c in columns)) for row in found.fetchall())
    assert sorted(repr(tuple(row[c] for c in columns)) for row in df.collect()) == want
