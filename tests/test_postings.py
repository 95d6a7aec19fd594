"""Stored postings against plain searches, and what a search reads."""

import random

import pytest
from pyspark.sql import functions as F

from tidelens.operators import postings, search


def _docs(spark, n=300):
    random.seed(2)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(k * 40_000, " ".join(random.choices(words, k=3)), " ".join(random.choices(words, weights=range(1, 21), k=8)), f"s{k % 3}", None if k % 50 == 0 else f"2024-01-{1 + k % 28:02d}") for k in range(n)]
    rows += [(7, None, None, "s0", "2024-01-01"), (8, "", "the and", "s1", "2024-01-01")]
    return spark.createDataFrame(rows, "id long, title string, content string, source_type string, published_date string")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    docs = _docs(spark)
    return docs, postings.term_index(docs, "file://" + str(tmp_path_factory.mktemp("index") / "terms"), shards=16)


@pytest.mark.parametrize("query", ["wt", "ws wt", "the wa wq ws", "wa missing", "the", ""])
def test_search_equals_the_search_without_index(spark, indexed, query):
    docs, index = indexed
    want = [r["id"] for r in search.search_all(docs, query, ["s0", "s1"], "2024-01-03", "2024-01-25", 40).collect()]
    assert [r["id"] for r in postings.search_all(index, docs, query, ["s0", "s1"], "2024-01-03", "2024-01-25", 40).collect()] == want
    assert query != "ws wt" or want


def test_many_queries_and_frequencies(spark, indexed):
    docs, index = indexed
    queries = spark.createDataFrame([(1, "wt"), (1, "ws"), (1, "ws"), (2, "wa"), (3, "wt"), (3, "missing"), (4, None)], "query_id long, key string")
    got = {}
    for r in index.holding_each(queries).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    held = {r["id"]: set(((r["title"] or "") + " " + (r["content"] or "")).split()) for r in docs.collect()}
    assert got == {1: {i for i, w in held.items() if {"wt", "ws"} <= w}, 2: {i for i, w in held.items() if "wa" in w}}
    assert {r["key"]: r["n"] for r in index.frequencies(spark, ["wt", "wa", "missing"]).collect()} == {k: sum(k in w for w in held.values()) for k in ("wt", "wa")}


def test_a_search_reads_only_the_partitions_of_its_terms(spark, indexed):
    _, index = indexed
    found = index.holding_all(spark, ["wt", "ws"])
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    read = index.lists(spark, ["wt", "ws"]).select(F.input_file_name().alias("f")).distinct().collect()
    shards = {r["f"].split("shard=")[1].split("/")[0] for r in read}
    assert len(shards) <= 2
    every = spark.read.parquet(index.path).select("shard").distinct().count()
    assert every > 6
    assert "ReadSchema: struct<key:string,n:bigint>" in index.frequencies(spark, ["wt"])._jdf.queryExecution().executedPlan().toString()


def test_ranges_bound_a_row(spark, indexed, tmp_path):
    _, index = indexed
    rows = spark.read.parquet(index.path).where("key = 'wt'").collect()
    assert len(rows) > 3 and all(i // postings.RANGE == r["range"] for r in rows for i in r["ids"]) and all(sorted(r["ids"]) == list(r["ids"]) and len(r["ids"]) == r["n"] for r in rows)


@pytest.mark.parametrize("part", ["tion", "TION", "on", "", "a%b", "x_z", "é日", "nope", "100%", "a\\%b"])
def test_parts_of_texts_equal_ilike(spark, tmp_path, part):
    texts = ["Nation", "TIONAL", "on", "", "aXXb", "a%b", "xyz", "x_z", "Äé日本", "100% sure", "xz", None, "Nation"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    index = postings.Substrings.of(df, "file://" + str(tmp_path / "texts"), shards=4)
    want = {r["text"] for r in df.where(F.col("text").ilike(f"%{part}%")).collect()}
    assert {r["text"] for r in index.like(spark, part).collect()} == want


def test_empty_collection(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, title string, content string, source_type string, published_date string")
    index = postings.term_index(docs, "file://" + str(tmp_path / "none"), shards=4)
    assert postings.search_all(index, docs, "a b").count() == 0
