"""Registered queries over feeds and stored rows: filters, normalizers, joins, look-ups and roll-ups (F N J Q W X E L P H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bindings as B
from .. import terms as K
from ..functions import scalars as S
from ..operators import analysis, enrich, normalize, rubric, search, stats
from ..sources import sinks
from .queries import CTE, _NEEDS, _rounded, query

_TERMS = ["tion", "aner"]
_RELEVANT = "(contains(lower({0}), 'tion') OR contains(lower({0}), 'aner'))"


def _case(key: str, *values: str | None) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else f"'{v}'") for k, v in enumerate(values)) + " END"


CTE |= {
    "st": f"st AS (SELECT paper_id AS id, {_case('paper_id', 'Ask HN: ', 'Show HN: ', 'Tell HN: ', '', 'Study: ', '', 'Funding: ', '')} || title AS title, abstract AS text, {_case('paper_id', 'https://github.com/x/', 'https://ex.org/f', 'https://arxiv.org/abs/', 'https://www.example.com/p/', 'http://reddit.com/r/', None)} || paper_id || {_case('paper_id', '', '.PDF', '', '', '', '')} AS url, paper_id % 40 AS score, created_at AS time, source_type FROM papers)",
    "fl": f"fl AS (SELECT o_orderkey AS arrival, CAST(o_custkey % 40 AS VARCHAR) AS cik, CASE WHEN o_custkey % 11 = 0 THEN '' ELSE 'Company  No ' || (o_custkey % 40) END AS company_name, {_case('o_orderkey', *B.FORMS)} AS form_type, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%m-%d-%Y') WHEN 3 THEN strftime(o_orderdate, '%Y%m%d') ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'unknown' END END AS filing_date, CASE WHEN o_orderkey % 5 < 4 THEN CAST(o_orderdate AS DATE) END AS day, 'edgar/' || (o_custkey % 40) || '/' || o_orderkey AS filename FROM orders)",
    "rp": f"rp AS (SELECT doc_id AS id, 'r' || doc_id AS name, 'o' || (doc_id % 9) || '/r' || doc_id AS full_name, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'A flask and pandas tool in ' || lang END AS description, lang AS language, n_chars, doc_id % 7 AS c_bytes, CASE WHEN doc_id % 6 <> 0 THEN CAST(doc_id * 37 % 20000 AS INT) END AS stars, CAST(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER) AS TIMESTAMP) AS created_at, CASE WHEN doc_id % 3 = 0 THEN [] ELSE ['Docker', source, 'nlp'] END AS topics, text AS readme FROM documents)",
    "an": "an AS (SELECT paper_id * 2 + run AS id, paper_id AS document_id, paper_id, created_at + to_days(CAST(run + 1 AS INT)) AS created_at, length(abstract) AS word_count FROM (SELECT *, unnest(CASE WHEN paper_id % 2 = 0 THEN [0, 1] WHEN paper_id % 3 = 0 THEN [0] END) AS run FROM papers))",
    "rr": "rr AS (SELECT *, [struct_pack(concept := ' Concept ' || (document_id % 5), weight := (document_id % 4) / 4), struct_pack(concept := ' Concept ' || (document_id % 3), weight := (document_id % 10) / 10)] AS concepts, document_id % 3 > 0 AS significant, 2 * (document_id % 6) AS novelty, 2 * (document_id % 4) AS rigor, CASE WHEN document_id % 3 > 0 THEN 1 + 2 * (document_id % 5) END AS practical, CASE WHEN document_id % 2 = 0 THEN CAST(document_id % 11 AS DOUBLE) END AS impact, document_id % 2 = 0 AS has_method, 'm' || (document_id % 3) AS model FROM reports)",
    "ents": r"ents AS (SELECT doc_id AS document_id, 'AFTER_THE' AS entity_type, unnest(list_distinct(regexp_extract_all(text, '(?i)\bthe\s+([A-Za-z]{6,})', 1))) AS entity_text FROM documents)",
}
_NEEDS |= {"st": ["papers"], "an": ["papers"], "rr": ["reports"]}


def _ents(spark, d) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?i)\bthe\s+([A-Za-z]{6,})"), F.lit(1)))
    return B.documents(spark, d).select("document_id", F.lit("AFTER_THE").alias("entity_type"), F.explode(found).alias("entity_text"))


# Filters


@query("recent_stories", ("st",), f"SELECT id, title, score, time FROM st WHERE time >= TIMESTAMP '2024-02-15' - INTERVAL 480 HOURS AND score >= 10 AND {_RELEVANT.format('title || chr(32) || text')}")
def recent_stories(spark, d):
    """F1, F3."""
    return search.stories(B.stories(spark, d), "2024-02-15", 480, 10, _TERMS, []).select("id", "title", "score", "time")


@query("live_comments", (), "SELECT doc_id AS id FROM documents WHERE doc_id % 9 NOT IN (0, 1, 2) AND trim(text) <> ''")
def live_comments(spark, d):
    """F4."""
    k = F.pmod("document_id", F.lit(9))
    body = F.when(k == 0, "[deleted]").when(k == 1, "[removed]").when(k == 2, "  ").otherwise(F.col("text"))
    return search.live_comments(B.documents(spark, d).select(F.col("document_id").alias("id"), body.alias("body"))).select("id")


@query("issues_without_pull_requests", (), "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0")
def issues_without_pull_requests(spark, d):
    """F5."""
    pull = F.when(F.pmod("document_id", F.lit(3)) == 0, F.struct(F.lit("u").alias("url")))
    return search.issues_only(B.documents(spark, d).select(F.col("document_id").alias("id"), pull.alias("pull_request"))).select("id")


@query("paper_filter", ("papers",), "SELECT paper_id FROM papers WHERE (contains(lower(title), 'erst') OR contains(lower(abstract), 'erst') OR (paper_id % 2 = 0 AND paper_id % 50 = 4)) AND (source_type = 'c3' OR paper_id % 7 = 3)")
def paper_filter(spark, d):
    """a comment is missing for odd ids."""
    k = F.col("paper_id")
    comment = F.when(F.pmod(k, F.lit(2)) == 0, F.when(F.pmod(k, F.lit(50)) == 4, "an ERST note").otherwise("none"))
    p = B.papers(spark, d).withColumn("comment", comment).withColumn("categories", F.array("source_type", F.concat(F.lit("c"), F.pmod(k, F.lit(7)).cast("string"))))
    return search.paper_filter(p, "Erst", "c3").select("paper_id")


@query("trending_repositories", ("rp",), "SELECT id, full_name, stars FROM rp WHERE created_at > TIMESTAMP '2024-02-15' - INTERVAL 30 DAYS AND language = 'en' ORDER BY stars DESC NULLS LAST, id LIMIT 90")
def trending_repositories(spark, d):
    """F7."""
    r = B.repositories(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return _rounded(search.trending_repositories(r, "2024-02-15", "month", "en").select("id", "full_name", F.col("stargazers_count").alias("stars")))


@query("insider_filings", ("fl",), ", r AS (SELECT *, row_number() OVER (PARTITION BY cik, form_type ORDER BY filing_date DESC NULLS LAST, filename) AS k FROM fl WHERE form_type IN ('3', '4', '5')) SELECT arrival, cik, form_type, filing_date FROM r WHERE k <= 20 AND filing_date IS NOT NULL AND (day IS NULL OR day >= (SELECT max(CAST(o_orderdate AS DATE)) FROM orders) - 900)")
def insider_filings(spark, d):
    """The last 900 days before the newest filing."""
    last = B.table(spark, d, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]  # one value
    return search.insider_filings(B.filings(spark, d), last, 900, 20).select("arrival", "cik", "form_type", "filing_date")


@query("company_filings", ("fl",), "SELECT arrival, cik, form_type, filing_date, filename FROM fl WHERE cik = '7' AND form_type = '8-K' ORDER BY filing_date DESC NULLS LAST, filename LIMIT 20")
def company_filings(spark, d):
    """F9."""
    return search.company_filings(B.filings(spark, d), "7", "8-K").select("arrival", "cik", "form_type", "filing_date", "filename")


@query("filing_dates", ("fl",), "SELECT arrival, day FROM fl")
def filing_dates(spark, d):
    """Four formats."""
    return B.filings(spark, d).select("arrival", S.filing_date("filing_date").alias("day"))


@query("recent_contents", ("papers",), "SELECT paper_id AS id, source_type, created_at AS collected_at FROM papers WHERE created_at >= TIMESTAMP '2024-02-29' - INTERVAL 240 HOURS AND length(source_type) % 2 = 0 ORDER BY collected_at DESC, id LIMIT 500")
def recent_contents(spark, d):
    """F10, F11, W8."""
    c = B.contents(spark, d)
    kinds = [r[0] for r in c.select("source_type").distinct().collect() if r[0] and len(r[0]) % 2 == 0]  # names of sources
    return search.recent(c, "collected_at", "2024-02-29", 240, kinds or ["none"], 500).select("id", "source_type", "collected_at")


@query("stored_stories", ("papers",), "SELECT paper_id AS id, created_at AS collected_at FROM papers WHERE created_at >= TIMESTAMP '2024-02-29' - INTERVAL 48 HOURS AND contains(lower(abstract), 'tion') ORDER BY collected_at DESC, id LIMIT 20")
def stored_stories(spark, d):
    """F12."""
    return search.stored_stories(B.contents(spark, d), "TION", "2024-02-29").select("id", "collected_at")


@query(
    "story_fields", ("st",),
    """SELECT id, CASE WHEN starts_with(lower(title), 'ask hn:') THEN 'ask_hn' WHEN starts_with(lower(title), 'show hn:') THEN 'show_hn' WHEN starts_with(lower(title), 'tell hn:') THEN 'tell_hn' WHEN contains(coalesce(url, ''), 'github.com') OR contains(coalesce(url, ''), 'gitlab.com') THEN 'open_source'
    WHEN contains(lower(title), 'paper') OR contains(lower(title), 'research') OR contains(lower(title), 'study') THEN 'research' WHEN contains(lower(title), 'startup') OR contains(lower(title), 'funding') OR contains(lower(title), 'ipo') OR contains(lower(title), 'acquisition') THEN 'business' ELSE 'general' END AS class,
    split_part(url, '/', 3) AS host, CASE WHEN id % 6 = 1 OR id % 6 = 2 THEN 'pdf_extract' WHEN id % 6 = 3 THEN 'web_scrape' ELSE 'none' END AS strategy, CASE id % 6 WHEN 1 THEN url WHEN 2 THEN replace(url, '/abs/', '/pdf/') || '.pdf' END AS pdf FROM st""",
)
def story_fields(spark, d):
    """X5, X6, E1, E2."""
    return B.stories(spark, d).select("id", S.story_class("title", "url").alias("class"), S.host("url").alias("host"), enrich.strategy("url").alias("strategy"), enrich.pdf_link("url").alias("pdf"))


@query("post_keywords", ("st",), ", k AS (SELECT id, unnest(list_concat([lower(source_type)], list_filter([" + ", ".join(f"'{t}'" for t in K.POST_TERMS) + "], lambda x: contains(lower(title || ' ' || text), x)))) AS w FROM st) SELECT id, string_agg(DISTINCT w, '|' ORDER BY w) AS keywords FROM k GROUP BY id")
def post_keywords(spark, d):
    """X7."""
    return B.stories(spark, d).select("id", F.array_join(S.post_keywords("title", "text", "source_type"), "|").alias("keywords"))


# Normalizers


def _text(c: str, kind: str) -> Column:
    if kind.startswith("array"):
        return F.array_join(c, "|").alias(c)
    if kind.startswith("map"):
        return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 3).cast("string")))), "|").alias(c)
    return F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c)


def _flat(df: DataFrame) -> DataFrame:
    """Lists and maps as text, so that rows can be compared."""
    return df.select(*(_text(c, kind) for c, kind in df.dtypes))


_SUMMARY = "CASE WHEN length({0}) <= {1} THEN {0} WHEN contains(substr({0}, 1, {1}), '.') AND {1} - strpos(reverse(substr({0}, 1, {1})), '.') > {1} / 2 THEN substr({0}, 1, {1} - strpos(reverse(substr({0}, 1, {1})), '.') + 1) ELSE substr({0}, 1, {1}) || '...' END"


def _academic(spark, d) -> DataFrame:
    k = F.col("paper_id")
    p = B.papers(spark, d).select(
        F.lit("academic").alias("source_type"), F.concat(F.lit("p"), k.cast("string")).alias("source_id"), "title", "abstract", "authors", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published"), F.concat(F.lit("https://arxiv.org/abs/"), k.cast("string")).alias("url"),
        F.when(F.pmod(k, F.lit(4)) > 0, F.array(F.col("source_type"))).alias("keywords"), F.array(F.lit("cs.AI")).alias("categories"), F.pmod(k, F.lit(50)).alias("citations"), F.when(F.pmod(k, F.lit(3)) > 0, F.pmod(k, F.lit(7))).alias("downloads"), F.lit(None).cast("double").alias("impact_factor"), F.col("created_at").alias("collected_at"),
    )
    return normalize.academic(p)


@query("academic_documents", ("papers",), "SELECT md5('p' || paper_id || '_' || title) AS id, title, " + _SUMMARY.format("abstract", 200) + " AS summary, author_a || '|' || author_b AS authors, created_at AS published_date, CASE WHEN paper_id % 4 > 0 THEN source_type ELSE '' END AS keywords, 'cs.AI' AS categories, 'citations=' || (paper_id % 50) || '.0' || CASE WHEN paper_id % 3 > 0 THEN '|downloads=' || (paper_id % 7) || '.0' ELSE '' END AS metrics FROM papers")
def academic_documents(spark, d):
    """N1, X3."""
    return _flat(_academic(spark, d)).select("id", "title", "summary", "authors", "published_date", "keywords", "categories", "metrics")


def _sql_map(values: dict, key: str, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE {other} END"


_CATEGORIES = _sql_map({k: "|" + "|".join(v) for k, v in K.FILING_CATEGORIES.items()}, "form_type", "CASE WHEN starts_with(form_type, 'SC ') THEN '|tender_offer' WHEN starts_with(form_type, 'N-') THEN '|investment_company' ELSE '' END")
_IMPORTANCE = _sql_map({k: f"{v}.0" for k, v in K.FILING_IMPORTANCE.items()}, "form_type", "'3.0'")
_DESCRIPTION = _sql_map(K.FILING_FORMS, "form_type", "'Other Filing'")


@query(
    "filing_documents", ("fl",),
    f""", f AS (SELECT *, nullif(company_name, '') AS company, {_DESCRIPTION} AS description, date_diff('day', CASE WHEN arrival % 5 = 0 THEN day END, DATE '1998-08-02') AS age FROM fl)
    SELECT arrival, translate('sec_' || cik || '_' || form_type || coalesce('_' || filing_date, ''), '/-', '__') AS id, coalesce(form_type || ': ' || company, 'SEC Filing ' || form_type) || ' (CIK: ' || cik || ')' AS title,
    'Filing Type: ' || description || coalesce(' | Company: ' || company, '') || ' | Central Index Key (CIK): ' || cik AS content, description || ' filed by ' || coalesce(company, 'Unknown Company') AS summary, coalesce(company, '') AS authors, CAST(day AS TIMESTAMP) AS published_date,
    form_type || CASE WHEN company IS NULL THEN '' ELSE '|Company|No|' || cik END AS keywords, 'sec_filing|corporate' || {_CATEGORIES} AS categories,
    'sec_filing|form_' || translate(lower(form_type), '/-', '__') || CASE WHEN contains(form_type, '/A') THEN '|amendment' ELSE '' END || CASE WHEN form_type IN ('8-K', '8-K/A') THEN '|urgent' WHEN form_type = '4' THEN '|insider_activity' WHEN form_type IN ('10-K', '10-Q') THEN '|financial_report' ELSE '' END
    || CASE WHEN age <= 1 THEN '|recent' WHEN age <= 7 THEN '|this_week' WHEN age <= 30 THEN '|this_month' ELSE '' END AS tags, 'importance=' || {_IMPORTANCE} AS metrics FROM f""",
)
def filing_documents(spark, d):
    """N2, X8, X9, X10, J12."""
    raw = search.form_lookup(B.filings(spark, d)).select("*", F.lit("sec").alias("source_type"), F.col("arrival").cast("string").alias("source_id"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("timestamp").alias("collected_at"), F.concat(F.lit("https://x/"), "filename").alias("filing_url"))
    out = _flat(normalize.filing(raw, "1998-08-02"))
    return out.select(F.col("source_id").cast("long").alias("arrival"), "id", "title", "content", "summary", "authors", "published_date", "keywords", "categories", "tags", "metrics")


@query("public_documents", ("papers",), "SELECT 'public_doc_' || md5('d' || paper_id || '_' || title || '_' || strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS id, title, abstract AS content, 'public_document' AS categories, created_at AS published_date FROM papers")
def public_documents(spark, d):
    """N3."""
    p = B.papers(spark, d).select(
        F.lit("public").alias("source_type"), F.concat(F.lit("d"), F.col("paper_id").cast("string")).alias("source_id"), "title", F.lit(None).cast("string").alias("content"), F.col("abstract").alias("summary"), "authors",
        F.date_format("created_at", "yyyy-MM-dd").alias("published_date"), F.lit("u").alias("url"), F.lit(None).cast("array<string>").alias("keywords"), F.lit(None).cast("array<string>").alias("tags"), F.col("created_at").alias("collected_at"),
    )
    return _flat(normalize.public_document(p)).select("id", "title", "content", "categories", "published_date")


_FRAMES = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in own)} THEN '{name}' END" for name, own in K.FRAMEWORKS.items()) + "], lambda x: x IS NOT NULL)"


@query(
    "repository_documents", ("rp",),
    f""", r AS (SELECT *, lower(coalesce(description, '') || ' ' || array_to_string(topics, ' ')) AS t, n_chars + c_bytes AS bytes, date_diff('day', created_at::DATE, DATE '2024-03-01') AS age FROM rp)
    SELECT 'github_repo_' || id || '_' || replace(full_name, '/', '_') AS id, full_name AS title, concat_ws(' | ', 'Description: ' || description, 'README: ' || nullif(readme, ''), CASE WHEN id % 4 > 0 THEN 'Languages: C, Python' END, CASE WHEN len(topics) > 0 THEN 'Topics: ' || array_to_string(topics, ', ') END) AS content,
    'o' || (id % 9) AS authors, created_at AS published_date, array_to_string(list_append(topics, language), '|') AS keywords, array_to_string(list_sort(list_distinct(list_concat([lower(language)], list_transform(topics, lambda x: lower(x)), {_FRAMES}))), '|') AS categories,
    'repository' || CASE WHEN id % 10 = 0 THEN '|fork' ELSE '' END || CASE WHEN id % 15 = 0 THEN '|archived' ELSE '' END || CASE WHEN id % 2 = 0 THEN '|license-mit-license' ELSE '' END || CASE WHEN coalesce(stars, 0) > 10000 THEN '|popular' WHEN coalesce(stars, 0) > 1000 THEN '|trending' WHEN coalesce(stars, 0) > 100 THEN '|growing' ELSE '' END
    || CASE WHEN age < 7 THEN '|recently-updated' WHEN age < 30 THEN '|active' WHEN age > 365 THEN '|stale' ELSE '' END AS tags FROM r""",
)
def repository_documents(spark, d):
    """N4, N9, X11, X12."""
    raw = B.repositories(spark, d).select("*", F.lit("github").alias("source_type"), F.col("name").alias("source_id"), F.lit(None).cast("timestamp").alias("collected_at"))
    return _flat(normalize.repository(raw, "2024-03-01")).select("id", "title", "content", "authors", "published_date", "keywords", "categories", "tags")


@query("repository_languages", ("rp",), "SELECT id, language, CAST(bytes AS BIGINT) AS bytes, round(bytes * 100 / nullif(sum(bytes) OVER (PARTITION BY id), 0), 6) AS share FROM (SELECT id, 'Python' AS language, n_chars AS bytes FROM rp WHERE id % 4 > 0 UNION ALL SELECT id, 'C', c_bytes FROM rp WHERE id % 4 > 0)")
def repository_languages(spark, d):
    """W10, N5."""
    return _rounded(stats.language_rows(B.repositories(spark, d)))


def _project_rows(spark, d) -> DataFrame:
    k = F.col("doc_id")
    return B.table(spark, d, "documents").select(
        k.alias("id"), F.lit("github").alias("source_type"), k.cast("string").alias("source_id"), F.concat(F.lit("t "), "source").alias("title"), F.col("text").alias("body"), F.when(F.pmod(k, F.lit(2)) == 0, "open").otherwise("closed").alias("state"), F.struct(F.col("lang").alias("login")).alias("user"), F.array(F.struct(F.col("source").alias("name"))).alias("labels"),
        F.lit("2024-01-05T00:00:00").alias("created_at"), F.lit("u").alias("html_url"), F.pmod(k, F.lit(6)).cast("int").alias("comments"), (F.pmod(k, F.lit(5)) == 0).alias("draft"), F.struct(F.col("lang").alias("ref")).alias("head"), F.struct(F.lit("main").alias("ref")).alias("base"), F.lit("PushEvent").alias("type"), F.struct(F.col("lang").alias("login")).alias("actor"), F.struct(F.concat_ws("/", F.lit("o"), "source").alias("name")).alias("repo"),
        F.lit(None).cast("timestamp").alias("collected_at"),
    )


@query("project_documents", (), "SELECT 'github_issue_' || doc_id AS id, 't ' || source AS title, substr(text, 1, 1000) AS content, lang AS authors, source AS keywords, 'issue' AS categories, 'issue|' || CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'closed' END AS tags, 'comments=' || (doc_id % 6) || '.0' AS metrics FROM documents UNION ALL SELECT 'github_pr_' || doc_id, 't ' || source, substr(text, 1, 1000), lang, lang || '|main', 'pull_request', 'pull_request|' || CASE WHEN doc_id % 2 = 0 THEN 'open' ELSE 'closed' END || CASE WHEN doc_id % 5 = 0 THEN '|draft' ELSE '' END, '' FROM documents UNION ALL SELECT 'github_event_' || doc_id, lang || ' PushEvent on o/' || source, lang || ' PushEvent on o/' || source, lang, 'PushEvent|' || source, 'user_activity', 'event', '' FROM documents")
def project_documents(spark, d):
    """N6, N7, N8, U3."""
    raw = _project_rows(spark, d)
    every = normalize.union(normalize.issue(raw), normalize.pull_request(raw), normalize.user_event(raw))
    return _flat(every).select("id", "title", "content", "authors", "keywords", "categories", "tags", "metrics")


@query("analysis_children", ("kw", "ents"), "SELECT 'keyword' AS kind, doc_id AS id, keyword AS name FROM kw UNION ALL SELECT entity_type, document_id, entity_text FROM ents")
def analysis_children(spark, d):
    """N12."""
    k = B.keywords(spark, d).groupBy("document_id").agg(F.collect_list(F.struct("keyword", "score")).alias("keywords"))
    e = _ents(spark, d).groupBy("document_id").agg(F.collect_list("entity_text").alias("found"))
    nested = B.documents(spark, d).join(k, "document_id", "left").join(e, "document_id", "left").select(F.col("document_id").alias("id"), F.coalesce("keywords", F.array()).alias("keywords"), F.create_map(F.lit("AFTER_THE"), F.coalesce("found", F.array())).alias("entities"))
    words, found = normalize.child_rows(nested)
    return words.select(F.lit("keyword").alias("kind"), F.col("analysis_id").alias("id"), F.col("keyword").alias("name")).unionByName(found.select(F.col("entity_type").alias("kind"), F.col("analysis_id").alias("id"), F.col("entity_text").alias("name")))


# Joins and look-ups


@query("analyses_with_papers", ("an",), "SELECT an.id, an.paper_id, title, source_type FROM an LEFT JOIN papers USING (paper_id)")
def analyses_with_papers(spark, d):
    """J2."""
    return search.with_papers(B.analyses(spark, d).drop("created_at"), B.papers(spark, d)).select("id", "paper_id", "title", "source_type")


@query("newest_analysis", ("an", "kw", "ents"), "SELECT id, created_at, (SELECT string_agg(keyword, '|' ORDER BY keyword) FROM kw WHERE doc_id = 42) AS keywords, (SELECT string_agg(entity_text, '|' ORDER BY entity_text) FROM ents WHERE document_id = 42) AS entities FROM an WHERE document_id = 42 ORDER BY created_at DESC LIMIT 1")
def newest_analysis(spark, d):
    """The analysis of document 42."""
    own = lambda rows: rows.withColumn("analysis_id", F.col("document_id") * 2 + 1).drop("document_id")
    out = search.document_analysis(B.analyses(spark, d), own(B.keywords(spark, d)), own(_ents(spark, d)), 42)
    names = lambda c, f: F.nullif(F.array_join(F.array_sort(F.col(f"{c}.{f}")), "|"), F.lit("")).alias(c.replace("_rows", "s").replace("ys", "ies"))
    return out.select("id", "created_at", names("keyword_rows", "keyword"), names("entity_rows", "entity_text"))


@query("analysis_input", ("papers",), "SELECT paper_id AS id, CASE WHEN paper_id % 4 = 1 THEN 'enriched ' || paper_id ELSE abstract END AS content FROM papers WHERE paper_id NOT IN (SELECT doc_id FROM labels)")
def analysis_input(spark, d):
    """Enrichment succeeded for one id in four, failed for another."""
    k = F.col("id")
    c = B.contents(spark, d)
    tried = c.where(F.pmod(k, F.lit(4)) < 2).select("id", (F.pmod(k, F.lit(4)) == 1).alias("success"), F.concat(F.lit("enriched "), k.cast("string")).alias("enriched_content"))
    return search.analysis_input(c, B.table(spark, d, "labels").select(F.col("doc_id").alias("content_id")), tried).select("id", "content")


@query("topic_timeline", ("ev",), "SELECT topic, CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT paper_id) AS papers FROM ev GROUP BY ALL")
def topic_timeline(spark, d):
    """Topics of each stored row exploded; joining them back by the unique id would change nothing."""
    m = B.mentions(spark, d).withColumn("row_id", F.monotonically_increasing_id()).select("row_id", F.array("topic").alias("topics"), "ts", "paper_id")
    return search.topic_timeline(m)


@query("reports_with_keywords", ("kw", "reports"), ", m AS (SELECT r.document_id, keyword FROM reports r LEFT JOIN kw ON kw.doc_id = r.document_id WHERE contains(CAST(r.document_id AS VARCHAR), '77') OR contains(lower(keyword), '77') OR contains(lower(keyword), 'tion77') OR keyword ILIKE '%77%') SELECT document_id, coalesce(string_agg(keyword, ', ' ORDER BY keyword), '') AS keywords FROM m GROUP BY document_id")
def reports_with_keywords(spark, d):
    """J9."""
    return search.reports_with_keywords(B.reports(spark, d), B.keywords(spark, d).select("document_id", "keyword"), "77")


@query("generic_reports", ("reports", "papers"), ", c AS (SELECT document_id, trim(lower(unnest(contribs))) AS c FROM reports), t AS (SELECT paper_id, lower(trim(replace(title, chr(10), ' '))) AS t FROM papers WHERE paper_id % 2 = 0) SELECT DISTINCT document_id FROM c JOIN t ON t.paper_id = c.document_id WHERE contains(c, t) OR contains(t, c)")
def generic_reports(spark, d):
    """Titles are known of even ids."""
    p = B.papers(spark, d).where(F.pmod("paper_id", F.lit(2)) == 0).select(F.col("paper_id").alias("document_id"), "title")
    return search.generic_reports(B.reports(spark, d), p).select("document_id")


@query("document_lookup", (), "SELECT doc_id AS document_id, source AS source_type FROM documents WHERE doc_id = 42")
def document_lookup(spark, d):
    """Q2."""
    return search.lookup(B.documents(spark, d), "document_id", 42).select("document_id", "source_type")


@query("entity_search", ("ents",), "SELECT DISTINCT document_id, entity_text FROM ents WHERE entity_text ILIKE '%tion%' ORDER BY document_id, entity_text LIMIT 200")
def entity_search(spark, d):
    """Q4."""
    return search.search_entities(_ents(spark, d), "AFTER_THE", "tion", 200)


@query("entities_of_type", ("ents",), "SELECT document_id, string_agg(DISTINCT entity_text, '|' ORDER BY entity_text) AS entities FROM ents GROUP BY document_id ORDER BY document_id LIMIT 100")
def entities_of_type(spark, d):
    """Q5."""
    return search.search_entities(_ents(spark, d), "AFTER_THE", None, 100).withColumn("entities", F.array_join("entities", "|"))


@query("report_search", ("rr",), "SELECT document_id, ts AS timestamp FROM rr WHERE (contains(CAST(document_id AS VARCHAR), 'tion') OR len(list_filter(contribs, lambda x: x ILIKE '%tion%')) > 0 OR len(list_filter(concepts, lambda x: x.concept ILIKE '%tion%')) > 0) AND score >= 0.3 ORDER BY ts DESC, document_id LIMIT 50")
def report_search(spark, d):
    """Q6."""
    return search.search_reports(B.rich_reports(spark, d), "tion", None, 0.3).select("document_id", "timestamp")


@query("context_digest", ("papers",), "SELECT string_agg(title || ': ' || substr(abstract, 1, 200), chr(10) || chr(10) ORDER BY paper_id) AS context FROM (SELECT * FROM papers ORDER BY paper_id LIMIT 5)")
def context_digest(spark, d):
    """Q9."""
    return search.context_digest(B.contents(spark, d))


@query("search_many", ("cw",), ", q(query_id, term) AS (VALUES (1, 'tion'), (1, 'erst'), (2, 'anea'), (3, 'tion')) SELECT query_id, doc_id AS id FROM (SELECT DISTINCT doc_id, term FROM cw) JOIN q USING (term) GROUP BY query_id, doc_id HAVING count(*) = CASE query_id WHEN 1 THEN 2 ELSE 1 END")
def search_many(spark, d):
    """Q1 for many queries over an inverted index."""
    docs = B.documents(spark, d).select(F.col("document_id").alias("id"), F.lit("").alias("title"), F.col("text").alias("content"))
    wanted = spark.createDataFrame([(1, "tion"), (1, "erst"), (2, "anea"), (3, "tion")], "query_id int, term string")
    return _rounded(search.search_many(search.inverted_index(docs), wanted))


@query("first_filing", ("fl",), "SELECT cik, arrival, filename FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filename) AS k FROM fl) WHERE k = 1")
def first_filing(spark, d):
    """W3."""
    return stats.first_occurrence(B.filings(spark, d), "cik", [F.asc("filename")]).select("cik", "arrival", "filename")


@query("ranked_filings", ("fl",), f"SELECT arrival, form_type, CAST(CAST({_IMPORTANCE} AS DOUBLE) AS BIGINT) AS importance FROM (SELECT * FROM fl ORDER BY arrival LIMIT 200)")
def ranked_filings(spark, d):
    """W9, X9."""
    return _rounded(stats.ranked_filings(B.filings(spark, d).withColumn("importance", S.filing_importance("form_type")), 200, "arrival").select("arrival", "form_type", "importance"))


# Stored reports


@query("list_responses", (), r"SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 2 = 0 THEN source || '|' || lang ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^[-* 0-9.]+', ''))), lambda x: x <> ''), '|') END, '') AS items FROM documents WHERE NOT contains(text, '[')")
def list_responses(spark, d):
    """L2."""
    t = B.table(spark, d, "documents").where(~F.contains("text", F.lit("[")))
    raw = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("Here: "), F.to_json(F.array("source", "lang")), F.lit(" done"))).otherwise(F.col("text"))
    return t.select(F.col("doc_id").alias("id"), F.coalesce(F.array_join(rubric.list_response(raw), "|"), F.lit("")).alias("items"))


@query("quality_scores", ("rr",), "SELECT document_id, round(least(1.0::DOUBLE, CASE WHEN significant THEN (novelty + rigor + coalesce(practical, 5) + 5) / 40 ELSE 0 END + least(0.1::DOUBLE * len(contribs), 0.3::DOUBLE) + CASE WHEN has_method THEN 0.1::DOUBLE ELSE 0 END), 2) AS score FROM rr")
def quality_scores(spark, d):
    """L5."""
    return B.rich_reports(spark, d).select("document_id", rubric.quality_score("novel_contributions", "research_significance", "methodology").alias("score"))


@query("report_scores", (), r"SELECT doc_id AS id, least(5.0, 1.0 + CASE WHEN length(text) > 1000 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 > 3 THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'methodology') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(text), 'implications') THEN 0.5 ELSE 0 END)::DOUBLE AS score, TRY_CAST(nullif(regexp_extract(text, '\b([0-9]|10)\b', 1), '') AS BIGINT) AS first_number FROM documents")
def report_scores(spark, d):
    """L6, L7."""
    t = B.table(spark, d, "documents")
    found = F.array_repeat(F.lit("f"), F.pmod("doc_id", F.lit(5)).cast("int"))
    return _rounded(t.withColumn("findings", found).select(F.col("doc_id").alias("id"), rubric.deep_report_score("text", "findings").alias("score"), rubric.integer_score("text").alias("first_number")))


_WORDS = "w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(unnest({0})), '\\s+')) AS word FROM {1}) WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 5)"


@query("contribution_themes", ("reports",), ", x AS (SELECT unnest(contribs) AS x FROM reports), " + _WORDS.replace("unnest({0})", "x").replace("{1}", "x") + " SELECT word, n FROM w WHERE length(word) > 4")
def contribution_themes(spark, d):
    """L10."""
    return rubric.contribution_themes(B.reports(spark, d))


@query("implication_themes", ("reports",), ", x AS (SELECT unnest(impls) AS x FROM reports), " + _WORDS.replace("unnest({0})", "x").replace("{1}", "x").replace("LIMIT 5", "LIMIT 100") + " SELECT word, n FROM w WHERE length(word) > 4")
def implication_themes(spark, d):
    """Among the hundred most frequent words, as the five most frequent ones are short here."""
    return rubric.implication_themes(B.reports(spark, d), 100)


@query("contribution_density", ("reports",), "SELECT count(DISTINCT c) AS distinct_contributions, round(count(c) / (SELECT count(*) FROM reports), 6) AS density FROM (SELECT unnest(contribs) AS c FROM reports)")
def contribution_density(spark, d):
    """L10."""
    return _rounded(rubric.contribution_density(B.reports(spark, d)))


@query("impact_scores", ("rr",), "SELECT round(avg(coalesce(impact, 5)), 6) AS avg_impact, count(*) FILTER (coalesce(impact, 5) >= 8) AS high_impact, count(*) FILTER (coalesce(impact, 5) >= 9) AS breakthrough, round(avg(CASE WHEN significant THEN novelty END), 6) AS novelty, round(avg(CASE WHEN significant THEN rigor END), 6) AS technical_rigor, round(avg(practical), 6) AS practical_impact FROM rr")
def impact_scores(spark, d):
    """L12, L14."""
    r = B.rich_reports(spark, d)
    return _rounded(rubric.impact(r).crossJoin(F.broadcast(rubric.sub_scores(r))))


@query("concept_trends", ("rr",), ", c AS (SELECT unnest(concepts, recursive := true) FROM rr) SELECT concept, count(*) AS n, round(count(*) / (SELECT count(*) FROM rr), 6) AS coverage FROM c WHERE weight > 0.7::DOUBLE GROUP BY concept ORDER BY n DESC, concept LIMIT 10")
def concept_trends(spark, d):
    """L15."""
    return _rounded(rubric.concept_trends(B.rich_reports(spark, d)))


@query("completeness", ("rr",), ", s AS (SELECT avg(CASE WHEN len(contribs) > 0 AND significant THEN 1 ELSE 0 END) AS v FROM rr) SELECT round(v, 6) AS completeness, CASE WHEN v > 0.8 THEN 'complete' ELSE 'partial' END AS verdict FROM s")
def completeness(spark, d):
    """L18."""
    return _rounded(rubric.completeness(B.rich_reports(spark, d)))


@query("first_contributions", ("reports",), ', x AS (SELECT document_id, unnest(contribs) AS item, generate_subscripts(contribs, 1) - 1 AS "at" FROM reports) SELECT document_id, "at", item FROM x ORDER BY document_id, "at" LIMIT 10')
def first_contributions(spark, d):
    """L8."""
    return _rounded(rubric.first_items(B.reports(spark, d), "novel_contributions"))


@query("text_hashes", (), "SELECT doc_id AS document_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def text_hashes(spark, d):
    """S8."""
    return B.documents(spark, d).select("document_id", sinks.text_hash("text").alias("hash"))


# Report sections and logs


@query("batch_summary", ("an", "ents"), ", e AS (SELECT document_id, count(*) AS n FROM ents GROUP BY document_id) SELECT CASE WHEN paper_id IN (SELECT paper_id FROM an) THEN 'processed' WHEN trim(abstract) = '' THEN 'skipped' ELSE 'waiting' END AS status, count(*) AS n, CAST(coalesce(sum(e.n), 0) AS BIGINT) AS entities FROM papers LEFT JOIN e ON e.document_id = paper_id GROUP BY 1")
def batch_summary(spark, d):
    """A11."""
    return stats.batch_summary(B.papers(spark, d), B.analyses(spark, d), _ents(spark, d))


@query("technology_mentions", ("kw", "papers"), ", h AS (SELECT keyword AS term, score, CASE WHEN length(title) > 50 THEN substr(title, 1, 50) || '...' ELSE title END AS context, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, title) AS k FROM kw JOIN papers ON paper_id = doc_id WHERE keyword IN ('tion', 'erst', 'anea', 'tiond')) SELECT term, count(*) AS n, string_agg(context, '|' ORDER BY k) FILTER (k <= 3) AS contexts FROM h GROUP BY term ORDER BY n DESC, term LIMIT 10")
def technology_mentions(spark, d):
    """P5."""
    k = B.keywords(spark, d).join(B.papers(spark, d).select(F.col("paper_id").alias("document_id"), "title"), "document_id")
    return stats.technology_mentions(k, ["tion", "erst", "anea", "tiond"]).withColumn("contexts", F.array_join("contexts", "|"))


@query("recommendation_flags", ("papers", "an"), ", c AS (SELECT count(*) AS n, count(*) FILTER (created_at >= TIMESTAMP '2024-02-29' - INTERVAL 24 HOURS) AS fresh, count(DISTINCT source_type) AS sources FROM papers), a AS (SELECT count(*) AS n FROM an) SELECT CASE WHEN c.n = 0 THEN 0 ELSE round(a.n * 100 / c.n, 2) END < 80 AS low_coverage, fresh = 0 AS no_new, fresh < 5 AS few_new, sources < 3 AS few_sources FROM c, a")
def recommendation_flags(spark, d):
    """P6."""
    runs = B.analyses(spark, d).withColumn("analyzed_at", F.col("created_at"))
    return stats.recommendation_flags(stats.pipeline_stats(B.contents(spark, d), runs, "2024-02-29"))


@query("recent_metadata", ("papers",), ", r AS (SELECT source_type FROM papers WHERE created_at >= TIMESTAMP '2024-02-29' - INTERVAL 7 DAYS ORDER BY created_at DESC, paper_id LIMIT 100) SELECT count(*) AS items, string_agg(DISTINCT source_type, '|' ORDER BY source_type) AS sources FROM r")
def recent_metadata(spark, d):
    """P9."""
    return stats.recent_metadata(B.contents(spark, d), "2024-02-29", 7).withColumn("sources", F.array_join("sources", "|"))


@query("landscape_sources", ("papers",), ", g AS (SELECT source_type, count(*) AS n, count(*) FILTER (created_at >= TIMESTAMP '2024-02-29' - INTERVAL 24 HOURS) AS n_24h FROM papers GROUP BY source_type) SELECT source_type, n, round(n * 100 / sum(n) OVER (), 6) AS share, n_24h, row_number() OVER (ORDER BY n DESC, source_type) <= 3 AS top_source FROM g")
def landscape_sources(spark, d):
    """Shares, items of the last 24 hours, the top three sources."""
    return _rounded(stats.landscape_sources(B.contents(spark, d), "2024-02-29"))


@query("scheduler_summary", (), "SELECT 'enabled' AS section, CAST(count(*) FILTER (c_custkey % 3 > 0) AS VARCHAR) AS name, CAST(NULL AS TIMESTAMP) AS \"at\" FROM customer UNION ALL SELECT 'running', CAST(count(*) FILTER (c_custkey % 5 = 0) AS VARCHAR), NULL FROM customer UNION ALL SELECT * FROM (SELECT 'next', 't' || c_custkey, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 30 AS INT)) AS \"at\" FROM customer WHERE c_custkey % 3 > 0 ORDER BY \"at\", 't' || c_custkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'last', 'e' || event_id, CAST(ts AS TIMESTAMP) AS \"at\" FROM events ORDER BY \"at\" DESC, 'e' || event_id LIMIT 10)")
def scheduler_summary(spark, d):
    """H2."""
    k = F.col("c_custkey")
    tasks = B.table(spark, d, "customer").select(F.concat(F.lit("t"), k.cast("string")).alias("task_id"), (F.pmod(k, F.lit(3)) > 0).alias("enabled"), (F.pmod(k, F.lit(5)) == 0).alias("running"), (F.lit("2024-01-01").cast("date") + F.pmod(k, F.lit(30)).cast("int")).cast("timestamp_ntz").alias("next_run"))
    log = B.table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("execution_id"), F.col("ts").cast("timestamp_ntz").alias("started_at"))
    return stats.scheduler_summary(tasks, log)


@query("cycle_summary", (), "SELECT CAST(ts AS DATE) AS cycle, event_type AS query, CAST(sum(user_id % 5) AS BIGINT) AS collected, CAST(sum(user_id % 3) AS BIGINT) AS analyzed, count(*) AS reports, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL")
def cycle_summary(spark, d):
    """H3."""
    log = B.table(spark, d, "events").select(F.to_date("ts").alias("cycle"), F.col("event_type").alias("query"), F.pmod("user_id", F.lit(5)).alias("collected"), F.pmod("user_id", F.lit(3)).alias("analyzed"), F.lit(1).alias("reports"), (F.col("event_type") == "error").cast("int").alias("errors"))
    return stats.cycle_summary(log)


@query("clean_sentences", ("sent",), r"SELECT doc_id AS document_id, CASE WHEN c = '' OR regexp_matches(c, '[.!?]$') THEN c ELSE c || '.' END AS sentence FROM (SELECT doc_id, upper(substr(t, 1, 1)) || substr(t, 2) AS c FROM (SELECT doc_id, trim(regexp_replace(s[1], '\s+', ' ', 'g')) AS t FROM sent))")
def clean_sentences(spark, d):
    """X14."""
    from ..functions.text import sentences

    return B.documents(spark, d).select("document_id", S.clean_sentence(F.get(sentences("text"), F.lit(0))).alias("sentence"))


@query("decoded_readmes", (), "SELECT doc_id AS id, substr(text, 1, 2000) AS readme FROM documents")
def decoded_readmes(spark, d):
    """What was stored as base64 comes back, its first 2,000 characters."""
    return B.documents(spark, d).select(F.col("document_id").alias("id"), S.readme(F.base64(F.encode("text", "UTF-8"))).alias("readme"))


# Mined insights, labelled responses, families, roll-ups over analyses


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_NUMBERS = "|".join(K.NUMBER_PATTERNS)
_RULE = "CASE " + " ".join(f"WHEN contains(lower(title), '{w}') THEN '{t}'" for w, t in K.TITLE_IMPLICATIONS) + " END"


@query(
    "mined_insights", ("papers",),
    rf""", sx AS (SELECT paper_id, s, i, trim(regexp_replace(s, '\s+', ' ', 'g')) AS t FROM (SELECT paper_id, unnest(string_split(abstract, '. ')) AS s, generate_subscripts(string_split(abstract, '. '), 1) AS i FROM papers)),
    c AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN upper(substr(t, 1, 1)) || substr(t, 2) ELSE upper(substr(t, 1, 1)) || substr(t, 2) || '.' END AS c FROM sx),
    p AS (SELECT paper_id, arg_min(c, i) FILTER (length(c) > 20 AND {_any("lower(s)", K.NOVELTY_TERMS)}) AS novel, arg_min(c, i) FILTER (length(c) > 20 AND regexp_matches(s, '{_NUMBERS}')) AS number, arg_min(c, i) FILTER (length(c) > 20 AND {_any("lower(s)", K.METHOD_WORDS)}) AS method,
    arg_min(c, i) FILTER (length(c) > 20 AND {_any("lower(s)", K.BUSINESS_TERMS)}) AS business, arg_min(c, i) FILTER (length(c) > 20 AND {_any("lower(s)", K.IMPACT_TERMS)}) AS impact, arg_min(s, i) AS first FROM c GROUP BY paper_id)
    SELECT papers.paper_id, coalesce(substr(novel, 1, 200), CASE WHEN length(first) > 30 THEN 'From ' || split_part(title, ':', 1) || ': ' || substr(first, 1, 150) || '...' END) AS contribution, substr(coalesce(number, method), 1, 200) AS innovation, coalesce(substr(business, 1, 200), substr(impact, 1, 200), {_RULE}) AS implication FROM papers JOIN p ON p.paper_id = papers.paper_id""",
)
def mined_insights(spark, d):
    """L19, L20, L21."""
    return B.papers(spark, d).select("paper_id", rubric.mine_contribution().alias("contribution"), rubric.mine_innovation().alias("innovation"), rubric.mine_implication().alias("implication"))


@query("labelled_responses", (), "SELECT doc_id AS response_id, CASE WHEN doc_id % 2 = 0 THEN 'A long contribution of ' || source END AS contribution, 'short' AS approach, CASE WHEN doc_id % 3 = 0 THEN 'Unable to parse this response' ELSE 'Measured results of ' || lang || ' texts' END AS result, round(((CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END)) / 5 * 10, 6) AS completeness FROM documents")
def labelled_responses(spark, d):
    """L23, L24."""
    k = F.col("doc_id")
    line = F.concat_ws("\n", F.when(F.pmod(k, F.lit(2)) == 0, F.concat(F.lit("Key innovation: A long contribution of "), "source")), F.lit("Method: first"), F.lit("no label here"), F.lit("Approach:  short "), F.when(F.pmod(k, F.lit(3)) == 0, "Result: Unable to parse this response").otherwise(F.concat(F.lit("Results: Measured results of "), "lang", F.lit(" texts"))))
    r = rubric.labelled_lines(B.table(spark, d, "documents").select(k.alias("response_id"), line.alias("raw_response")))
    return _rounded(r.select("response_id", "contribution", "approach", "result", "completeness"))


@query("oldest_analyses", ("an",), "SELECT paper_id, min(id) AS id, min(created_at) AS created_at FROM an GROUP BY paper_id")
def oldest_analyses(spark, d):
    """C4: papers with several analyses count once."""
    from ..operators import correlate

    return correlate.one_analysis(B.analyses(spark, d)).select("paper_id", "id", "created_at")


@query("technical_terms", ("papers",), ", t AS (SELECT paper_id, lower(abstract || CASE WHEN paper_id % 10 = 0 THEN ' Graph ' || source_type || ' network, attention and fast training of a method' ELSE '' END) AS t FROM papers), x AS (SELECT paper_id, unnest(list_concat(list_filter(list_concat(" + ", ".join(f"regexp_extract_all(t, '{p}', {g})" for p in (K.TECHNICAL_PATTERNS[0], K.TECHNICAL_PATTERNS[2]) for g in (1, 2)).replace("), regexp", "), regexp", 1) + "), lambda w: length(w) > 2), regexp_extract_all(t, '" + K.TECHNICAL_PATTERNS[1] + "', 1))) AS term FROM t) SELECT DISTINCT paper_id, term FROM x")
def technical_terms(spark, d):
    """Y2, over texts in which every tenth document speaks of methods."""
    from ..operators import synthesis

    said = F.when(F.pmod("paper_id", F.lit(10)) == 0, F.concat(F.lit(" Graph "), "source_type", F.lit(" network, attention and fast training of a method"))).otherwise("")
    return B.papers(spark, d).select("paper_id", F.explode(synthesis.technical_terms(F.concat("abstract", said))).alias("term"))


@query("cross_source_section", ("kw", "papers"), ", g AS (SELECT source_type, keyword, row_number() OVER (PARTITION BY source_type ORDER BY count(*) DESC, keyword) AS rank FROM kw GROUP BY source_type, keyword), t AS (SELECT source_type, string_agg(keyword, '|' ORDER BY rank) AS themes FROM g WHERE rank <= 3 GROUP BY source_type) SELECT p.source_type, count(*) AS items, any_value(themes) AS themes, round(avg(length(" + _SUMMARY.format("abstract", 200) + ")), 6) AS avg_summary_length FROM papers p LEFT JOIN t ON t.source_type = p.source_type GROUP BY p.source_type")
def cross_source_section(spark, d):
    """P3."""
    c = B.contents(spark, d)
    s = c.select(F.col("id").alias("document_id"), S.summary("content").alias("summary"))
    return _rounded(stats.cross_source_section(B.keywords(spark, d), c, s).withColumn("themes", F.array_join("themes", "|")))


@query("landscape", ("kw",), "SELECT round((SELECT avg(length(text)) FROM documents), 6) AS avg_words, (SELECT count(*) FROM documents WHERE doc_id % 4 = 0) AS positive, (SELECT count(*) FROM documents WHERE doc_id % 4 = 1) AS negative, (SELECT count(*) FROM documents WHERE doc_id % 4 > 1) AS neutral, (SELECT count(*) FROM documents) AS contents, round((SELECT count(*) FROM kw) / (SELECT count(*) FROM documents), 6) AS avg_keywords")
def landscape(spark, d):
    """A missing label is neutral."""
    k = F.pmod("document_id", F.lit(4))
    a = B.documents(spark, d).select(F.char_length("text").alias("word_count"), F.when(k == 0, "positive").when(k == 1, "negative").when(k == 2, "neutral").alias("sentiment_label"))
    return _rounded(stats.landscape(B.contents(spark, d), a, B.keywords(spark, d)))


@query("cleaned_texts", ("papers",), rf"SELECT paper_id, trim(regexp_replace(regexp_replace(regexp_replace(abstract, '\s+', ' ', 'g'), '(?i)({K.WEB_BOILERPLATE})', '', 'g'), '(?i)({K.WEB_NAVIGATION})', '', 'g')) AS text FROM papers")
def cleaned_texts(spark, d):
    """E7."""
    return B.papers(spark, d).select("paper_id", enrich.clean("abstract").alias("text"))


def _family_hits(families: dict) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS family, paper_id FROM papers WHERE {_any('lower(title || chr(32) || abstract)', own)}" for name, own in families.items())


def _family_sql(families: dict, prefix: str, kind: str) -> str:
    hits = _family_hits(families)
    frame = "CASE WHEN count(*) >= all_papers * 0.5 THEN 'established' WHEN count(*) >= all_papers * 0.3 THEN 'growing' ELSE 'emerging' END"
    return f"SELECT '{prefix}' || family AS trend_id, '{kind}' AS trend_type, count(*) AS mentions, round(count(*) / any_value(all_papers), 6) AS confidence, {frame.replace('all_papers', 'any_value(all_papers)')} AS timeframe FROM ({hits}), (SELECT count(*) AS all_papers FROM papers) GROUP BY family"


@query("family_trends", ("papers",), _family_sql(K.METHOD_FAMILIES, "method_trend_", "methodological") + " UNION ALL " + _family_sql(K.APPLICATION_FAMILIES, "app_trend_", "application"))
def family_trends(spark, d):
    """Every family that any paper speaks of."""
    from ..operators import synthesis

    p = B.papers(spark, d).withColumn("innovations", F.lit(None).cast("array<string>")).withColumn("implications", F.lit(None).cast("array<string>"))
    every = synthesis.method_trends(p, least=1, confidence=0.0).unionByName(synthesis.application_trends(p, least=1, confidence=0.0))
    return _rounded(every.select("trend_id", "trend_type", "mentions", "confidence", "timeframe"))


@query("family_papers", ("papers",), _family_hits(K.METHOD_FAMILIES | K.APPLICATION_FAMILIES))
def family_papers(spark, d):
    """The papers behind each family."""
    from ..operators import synthesis

    p = B.papers(spark, d).withColumn("more", F.lit(None).cast("array<string>"))
    return synthesis.family_papers(p, K.METHOD_FAMILIES | K.APPLICATION_FAMILIES, "more").select("family", "paper_id")


@query("waiting_analyses", ("papers",), ", w AS (SELECT paper_id, abstract FROM papers WHERE trim(abstract) <> '' AND paper_id NOT IN (SELECT doc_id FROM labels) ORDER BY created_at DESC, paper_id LIMIT 40) SELECT paper_id AS document_id, len(regexp_extract_all(abstract, '[\\p{L}\\p{N}]+(?:[’-][\\p{L}\\p{N}]+)*|[^\\s\\p{L}\\p{N}]')) AS word_count FROM w")
def waiting_analyses(spark, d):
    """The newest contents without analysis are analysed."""
    done = B.table(spark, d, "labels").select(F.col("doc_id").alias("content_id"))
    return _rounded(analysis.analysis_cycle(B.contents(spark, d), done, 40).select("document_id", "word_count"))


@query("mended_reports", ("reports", "papers"), ", c AS (SELECT document_id, trim(lower(unnest(contribs))) AS c FROM reports), t AS (SELECT paper_id, lower(trim(replace(title, chr(10), ' '))) AS t FROM papers WHERE paper_id % 2 = 0), g AS (SELECT DISTINCT document_id FROM c JOIN t ON t.paper_id = c.document_id WHERE contains(c, t) OR contains(t, c)) SELECT r.document_id, g.document_id IS NOT NULL AS generic, CASE WHEN g.document_id IS NULL THEN array_to_string(contribs, '|') END AS kept FROM reports r LEFT JOIN g ON g.document_id = r.document_id")
def mended_reports(spark, d):
    """Reports that only repeat titles get their lists from the abstracts; the others keep theirs."""
    p = B.papers(spark, d).where(F.pmod("paper_id", F.lit(2)) == 0).select(F.col("paper_id").alias("document_id"), F.lit(0).alias("at"), "title", "abstract")
    r = B.reports(spark, d)
    flagged = search.generic_reports(r, p).select("document_id", F.lit(True).alias("generic"))
    out = rubric.replace_generic(r, p).join(flagged, "document_id", "left")
    generic = F.coalesce("generic", F.lit(False))
    return out.select("document_id", generic.alias("generic"), F.when(~generic, F.array_join("novel_contributions", "|")).alias("kept"))
