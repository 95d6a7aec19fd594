"""Registered queries: plans without Python workers or cartesian products, and results against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from tidelens.plans import queries as Q

BASE = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "pages", "benchmark", "labels", "conversations"]
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test data")


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(float(v), 5) if isinstance(v, float) or hasattr(v, "is_finite") else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in found)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_plan_stays_in_the_jvm(spark, name):
    plan = Q.QUERIES[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["top_keywords", "flesch", "keyword_trends", "emerging_topics", "paper_correlations", "quality_bands", "collaboration", "latest_wins", "rubric_parse", "new_keywords_by_day"])
def test_equals_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{BASE}/{t}.parquet'")
    expected = db.execute(Q.ORACLE[name])
    columns = [c[0] for c in expected.description]
    df = Q.QUERIES[name](spark, BASE)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, expected.fetchall())


def test_enrichment_measures_whole_pages(spark):
    from pyspark.sql import functions as F

    got = Q.QUERIES["enrichment_stats"](spark, BASE).first()
    html = spark.read.parquet(f"{BASE}/pages.parquet").agg(F.count("*").alias("n"), F.min(F.char_length("html")).alias("least")).first()
    assert got["total"] == html["n"] and html["least"] > 100
    # A page's text is part of its html, and a merge adds a heading at most.
    assert 1.0 <= got["max_ratio"] < 2.5
