"""Registered queries over one mixed feed of landed results (N10, N11): JSON lines of all kinds, made of the documents, landed in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import bindings as B
from ..operators import normalize
from ..sources.scratch import folder
from .feeds import _CATEGORIES, _FRAMES, _IMPORTANCE, _SUMMARY, _flat
from .queries import query

_AT = "2024-01-10"


def _lines(spark, d) -> DataFrame:
    """A landed line for each document, of nine kinds by its id, and some that are no JSON."""
    k, kind = F.col("doc_id"), F.pmod("doc_id", F.lit(9))
    name = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    lit = lambda x: F.lit(x)
    record = lambda **c: F.to_json(F.struct(*(v.alias(n) for n, v in c.items())))
    login = lambda c: F.struct(c.alias("login"))
    form = F.get(F.array(*map(lit, ("10-K", "8-K", "4", "SC 13D/A"))), F.pmod(F.floor(k / 9), lit(4)).cast("int"))
    company = F.when(F.pmod(F.floor(k / 9), lit(5)) == 0, "").otherwise(F.concat(lit("Acme  "), "source"))
    day = F.concat(lit("2024-01-0"), (1 + F.pmod(F.floor(k / 9), lit(9))).cast("string"))
    repository = record(
        id=k, name=name("r"), full_name=name("o/r"), description=lit("A flask tool"), owner=login(lit("o")), html_url=lit("https://r.org"), language=F.col("lang"), languages=F.create_map(lit("Python"), F.col("n_chars"), lit("C"), lit(7).cast("long")), stargazers_count=F.pmod(k * 37, lit(20000)),
        created_at=lit("2023-06-01T00:00:00Z"), updated_at=lit("2024-01-08T00:00:00Z"), size=F.col("n_chars"), topics=F.array("source"), license=F.struct(lit("MIT License").alias("name")), readme_content=F.col("text"), fork=F.pmod(k, lit(2)) == 0,
    )
    body = {"title": F.concat(lit("t "), "source"), "body": F.col("text"), "user": login(F.col("lang")), "created_at": lit("2024-01-02T03:04:05Z"), "html_url": name("https://i.org/")}
    data = (
        F.when(kind == 0, record(title=name("Paper "), abstract=F.col("text"), authors=F.array("lang", "source"), published=lit("2024-01-05T00:00:00Z"), url=name("https://a.org/"), keywords=F.array("source"), citations=F.pmod(k, lit(50))))
        .when(kind == 1, record(form_type=form, company_name=company, cik=F.pmod(k, lit(40)).cast("string"), filing_date=day, form_description=lit("Report"), filing_url=name("https://f.org/")))
        .when(kind == 2, record(title=name("Notice "), summary=F.col("text"), authors=F.array("source"), published_date=lit("01/05/2024"), tags=F.array(lit("t")), keywords=lit("no list")))
        .when(kind == 5, record(id=k, state=lit("open"), labels=F.array(F.struct(F.col("source").alias("name"))), comments=F.pmod(k, lit(6)), **body))
        .when(kind == 6, record(id=k, state=lit("closed"), head=F.struct(F.col("lang").alias("ref")), base=F.struct(lit("main").alias("ref")), draft=F.pmod(k, lit(2)) == 0, **body))
        .when(kind == 7, record(id=name("e"), type=lit("PushEvent"), actor=login(F.col("lang")), repo=F.struct(F.concat(lit("o/"), "source").alias("name")), created_at=lit("2024-01-02T03:04:05Z")))
        .otherwise(repository)
    )
    social = (kind == 8) & (F.pmod(F.floor(k / 9), lit(2)) == 1)
    source_type = F.when(kind == 0, "academic").when(kind.isin(1, 2), "public_docs").when(social, "social").otherwise("code_projects")
    metadata = F.to_json(F.struct(F.get(F.array(*map(lit, (None, "filing", None, "repository", "repository_search", "issue", "pull_request", "user_event", "gist"))), kind.cast("int")).alias("type"), F.when(kind == 1, "sec_edgar").when(kind == 2, "registry").alias("source")))
    line = F.concat(lit('{"source_type":"'), source_type, lit('","source_id":"'), name("s"), lit(f'","collected_at":"{_AT}T00:00:00Z","metadata":'), metadata, lit(',"data":'), data, lit("}"))
    docs = B.table(spark, d, "documents")
    return docs.select(line.alias("value")).unionByName(docs.where(F.pmod(k, lit(50)) == 7).select(F.concat(lit('{"source_type": '), k.cast("string")).alias("value")))


def _results(spark, d) -> DataFrame:
    path = folder(spark, "results")
    _lines(spark, d).write.text(path)
    return normalize.landed(spark.read.text(path))


_D = """d AS (SELECT doc_id AS k, doc_id % 9 AS kind, text, lang, source, n_chars, ['10-K', '8-K', '4', 'SC 13D/A'][(doc_id // 9) % 4 + 1] AS form_type, CASE WHEN (doc_id // 9) % 5 = 0 THEN NULL ELSE 'Acme  ' || source END AS company, 1 + (doc_id // 9) % 9 AS day FROM documents)"""
_ROUTED = rf"""WITH {_D}, a AS (SELECT 'academic' AS route, k, md5('s' || k || '_Paper ' || k) AS id, 'academic' AS source_type, 'Paper ' || k AS title, text AS content, {_SUMMARY.format("text", 200)} AS summary, lang || '|' || source AS authors, TIMESTAMP '2024-01-05' AS published_date, 'https://a.org/' || k AS url, source AS keywords, '' AS categories, '' AS tags, k % 50 AS citations, NULL AS importance, NULL AS stars, NULL AS comments FROM d WHERE kind = 0),
    f AS (SELECT 'filing', k, translate('sec_' || (k % 40) || '_' || form_type || '_2024-01-0' || day, '/-', '__'), 'public_docs', coalesce(form_type || ': ' || company, 'SEC Filing ' || form_type) || ' (CIK: ' || (k % 40) || ')', 'Filing Type: Report' || coalesce(' | Company: ' || company, '') || ' | Central Index Key (CIK): ' || (k % 40), 'Report filed by ' || coalesce(company, 'Unknown Company'), coalesce(company, ''), CAST(DATE '2024-01-01' + CAST(day - 1 AS INTEGER) AS TIMESTAMP), 'https://f.org/' || k,
    form_type || CASE WHEN company IS NULL THEN '' ELSE '|Acme|' || source END, 'sec_filing|corporate' || {_CATEGORIES}, 'sec_filing|form_' || translate(lower(form_type), '/-', '__') || CASE WHEN contains(form_type, '/A') THEN '|amendment' ELSE '' END || CASE WHEN form_type = '8-K' THEN '|urgent' WHEN form_type = '4' THEN '|insider_activity' WHEN form_type = '10-K' THEN '|financial_report' ELSE '' END || CASE WHEN 10 - day <= 1 THEN '|recent' WHEN 10 - day <= 7 THEN '|this_week' ELSE '|this_month' END, NULL, CAST({_IMPORTANCE} AS DOUBLE), NULL, NULL FROM d WHERE kind = 1),
    n AS (SELECT 'public_document', k, 'public_doc_' || md5('s' || k || '_Notice ' || k || '_2024-01-10 00:00:00'), 'public_docs', 'Notice ' || k, coalesce(text, ''), coalesce(text, ''), source, TIMESTAMP '2024-01-05', NULL, '', 'public_document', 't', NULL, NULL, NULL, NULL FROM d WHERE kind = 2),
    r AS (SELECT 'repository', k, 'github_repo_' || k || '_o_r' || k, 'code_projects', 'o/r' || k, concat_ws(' | ', 'Description: A flask tool', 'README: ' || nullif(text, ''), 'Languages: C, Python', 'Topics: ' || source), 'A flask tool', 'o', TIMESTAMP '2023-06-01', 'https://r.org', source || '|' || lang, array_to_string(list_sort(list_distinct(list_concat([lower(lang), lower(source)], {_FRAMES}))), '|'),
    'repository' || CASE WHEN k % 2 = 0 THEN '|fork' ELSE '' END || '|license-mit-license' || CASE WHEN k * 37 % 20000 > 10000 THEN '|popular' WHEN k * 37 % 20000 > 1000 THEN '|trending' WHEN k * 37 % 20000 > 100 THEN '|growing' ELSE '' END || '|recently-updated', NULL, NULL, k * 37 % 20000, NULL FROM (SELECT *, 'a flask tool ' || lower(source) AS t FROM d WHERE kind IN (3, 4) OR (kind = 8 AND (k // 9) % 2 = 0))),
    i AS (SELECT 'issue', k, 'github_issue_' || k, 'code_projects', 't ' || source, substr(coalesce(text, ''), 1, 1000), NULL, lang, TIMESTAMP '2024-01-02 03:04:05', 'https://i.org/' || k, source, 'issue', 'issue|open', NULL, NULL, NULL, k % 6 FROM d WHERE kind = 5),
    p AS (SELECT 'pull_request', k, 'github_pr_' || k, 'code_projects', 't ' || source, substr(coalesce(text, ''), 1, 1000), NULL, lang, TIMESTAMP '2024-01-02 03:04:05', 'https://i.org/' || k, lang || '|main', 'pull_request', 'pull_request|closed' || CASE WHEN k % 2 = 0 THEN '|draft' ELSE '' END, NULL, NULL, NULL, NULL FROM d WHERE kind = 6),
    e AS (SELECT 'user_event', k, 'github_event_e' || k, 'code_projects', lang || ' PushEvent on o/' || source, lang || ' PushEvent on o/' || source, NULL, lang, TIMESTAMP '2024-01-02 03:04:05', NULL, 'PushEvent|' || source, 'user_activity', 'event', NULL, NULL, NULL, NULL FROM d WHERE kind = 7),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM f UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r UNION ALL SELECT * FROM i UNION ALL SELECT * FROM p UNION ALL SELECT * FROM e)"""


@query("routed_documents", (), _ROUTED + " SELECT route, id, source_type, 's' || k AS source_id, title, content, summary, authors, published_date, url, keywords, categories, tags, CAST(citations AS DOUBLE) AS citations, CAST(importance AS DOUBLE) AS importance, CAST(stars AS DOUBLE) AS stars, CAST(comments AS DOUBLE) AS comments FROM u")
def routed_documents(spark, d):
    """One feed of all kinds, two of them unknown, and unreadable lines, through the router."""
    out = normalize.routed(_results(spark, d), _AT)
    own = out.select("route", "id", "source_type", "source_id", "title", "content", "summary", "authors", "published_date", "url", "keywords", "categories", "tags", *(F.col("metrics")[m].alias(m) for m in ("citations", "importance", "stars", "comments")))
    return _flat(own).withColumn("published_date", F.col("published_date").cast("timestamp_ntz"))


@query("route_counts", (), _ROUTED + " SELECT route, count(*) AS n, count(DISTINCT k) AS sources, CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS characters FROM u GROUP BY route")
def route_counts(spark, d):
    """What each normalizer got."""
    return normalize.routed(_results(spark, d), _AT).groupBy("route").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("sources"), F.sum(F.char_length(F.coalesce("content", F.lit("")))).alias("characters"))
