"""Registered queries over stored indexes: each builds its index in the shared folder and then searches it; the SQL is that of the search without one."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import postings
from ..sources.scratch import folder
from .feeds import _ents
from .queries import ORACLE, query


def _docs(spark, d):
    return B.contents(spark, d)


@query("indexed_search", sql=ORACLE["search_all_terms"])
def indexed_search(spark, d):
    """Q1: the index is built once and read by the partitions of two terms."""
    docs = _docs(spark, d)
    index = postings.term_index(docs, folder(spark, "term-index"))
    return postings.search_all(index, docs, "the tion erst").select("id", "title", "published_date", "source_type")


@query("indexed_search_many", ("cw",), ", q(query_id, term) AS (VALUES (1, 'tion'), (1, 'erst'), (2, 'anea'), (3, 'tion'), (4, 'tion'), (4, 'nowhere')) SELECT query_id, doc_id AS id FROM (SELECT DISTINCT doc_id, term FROM cw) JOIN q USING (term) GROUP BY query_id, doc_id HAVING count(*) = CASE WHEN query_id IN (1, 4) THEN 2 ELSE 1 END")
def indexed_search_many(spark, d):
    """Q1 for many queries."""
    docs = B.documents(spark, d).select(F.col("document_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("content"))
    wanted = spark.createDataFrame([(1, "tion"), (1, "erst"), (2, "anea"), (3, "tion"), (4, "tion"), (4, "nowhere")], "query_id long, key string")
    return postings.term_index(docs, folder(spark, "term-index")).holding_each(wanted)


@query("term_frequencies", ("cw",), "SELECT term AS key, count(DISTINCT doc_id) AS n FROM cw WHERE term IN ('tion', 'erst', 'anea', 'nowhere') GROUP BY term")
def term_frequencies(spark, d):
    """Document frequencies from the index, without its lists."""
    docs = B.documents(spark, d).select(F.col("document_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("content"))
    return postings.term_index(docs, folder(spark, "term-index")).frequencies(spark, ["tion", "erst", "anea", "nowhere"])


@query("indexed_entity_search", sql=ORACLE["entity_search"])
def indexed_entity_search(spark, d):
    """Q4 by grams."""
    e = _ents(spark, d)
    index = postings.Substrings.of(e.select(F.col("entity_text").alias("text")), folder(spark, "entity-index"))
    return postings.search_entities(index, e, "AFTER_THE", "tion", 200)


@query("indexed_report_search", sql=ORACLE["report_search"])
def indexed_report_search(spark, d):
    """Q6 by grams."""
    r = B.rich_reports(spark, d)
    index = postings.Substrings.of(postings.report_strings(r), folder(spark, "report-index"))
    return postings.search_reports(index, r, "tion", None, 0.3).select("document_id", "timestamp")


@query("indexed_reports_with_keywords", ("kw", "reports"), ", m AS (SELECT r.document_id, keyword FROM reports r LEFT JOIN kw ON kw.doc_id = r.document_id WHERE contains(CAST(r.document_id AS VARCHAR), '77') OR keyword ILIKE '%77%') SELECT document_id, coalesce(string_agg(keyword, ', ' ORDER BY keyword), '') AS keywords FROM m GROUP BY document_id")
def indexed_reports_with_keywords(spark, d):
    """J9 by grams; a part of two characters has none, so all stored texts are looked through."""
    r, k = B.reports(spark, d), B.keywords(spark, d).select("document_id", "keyword")
    texts = k.select(F.col("keyword").alias("text")).unionByName(r.select(F.col("document_id").cast("string").alias("text")))
    return postings.reports_with_keywords(postings.Substrings.of(texts, folder(spark, "keyword-index")), r, k, "77")
