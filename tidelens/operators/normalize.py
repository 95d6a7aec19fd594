"""Raw feeds to the normalized document table (N, U3). Every normalizer returns the columns of ``DOCUMENT``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

DOCUMENT = ["id", "source_type", "source_id", "title", "content", "summary", "authors", "published_date", "collected_date", "url", "keywords", "categories", "tags", "metrics"]


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _metrics(**values: Column) -> Column:
    every = F.create_map(*(x for name, v in values.items() for x in (F.lit(name), v.cast("double"))))
    return F.map_filter(every, lambda k, v: v.isNotNull())


#: Fields that a normalizer reads from a raw record: a name, dotted for nested fields, to its column.
Fields = Callable[[str], Column]


def _fields(**columns: Column) -> dict[str, Column]:
    base = {
        "source_type": F.col("source_type"), "source_id": F.col("source_id"), "summary": F.lit(None).cast("string"), "authors": _none("string"), "published_date": F.lit(None).cast("timestamp"),
        "collected_date": F.col("collected_at"), "url": F.lit(None).cast("string"), "keywords": _none("string"), "categories": _none("string"), "tags": _none("string"), "metrics": F.create_map().cast("map<string,double>"),
    } | columns
    return {c: base[c] for c in DOCUMENT}


def _document(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    return df.select(*(v.alias(c) for c, v in fields.items()))


def academic(df: DataFrame) -> DataFrame:
    """source_id, title, abstract, authors, published, url, keywords, categories, citations, downloads, impact_factor."""
    return _document(df, _academic(F.col))


def _academic(c: Fields) -> dict[str, Column]:
    return _fields(
        id=F.md5(F.concat_ws("_", F.col("source_id"), c("title"))), title=c("title"), content=c("abstract"), summary=S.summary(c("abstract")), authors=F.coalesce(c("authors"), _none("string")),
        published_date=S.iso_timestamp(c("published")), url=c("url"), keywords=F.coalesce(c("keywords"), _none("string")), categories=F.coalesce(c("categories"), _none("string")),
        metrics=_metrics(citations=c("citations"), downloads=c("downloads"), impact_factor=c("impact_factor")),
    )


def filing(df: DataFrame, as_of) -> DataFrame:
    """form_type, company_name, cik, filing_date, form_description, summary, filing_url."""
    return _document(df, _filing(F.col, as_of))


def _filing(c: Fields, as_of) -> dict[str, Column]:
    company, form, cik = F.nullif(c("company_name"), F.lit("")), F.coalesce(c("form_type"), F.lit("")), F.nullif(c("cik"), F.lit(""))
    title = F.concat(F.coalesce(F.concat(form, F.lit(": "), company), F.concat(F.lit("SEC Filing "), form)), F.coalesce(F.concat(F.lit(" (CIK: "), cik, F.lit(")")), F.lit("")))
    parts = [("Filing Type: ", F.nullif(c("form_description"), F.lit(""))), ("Summary: ", F.nullif(c("summary"), F.lit(""))), ("Company: ", company), ("Central Index Key (CIK): ", cik)]
    fallback = F.concat(F.coalesce(c("form_description"), form), F.lit(" filed by "), F.coalesce(company, F.lit("Unknown Company")))
    return _fields(
        id=F.translate(F.concat_ws("_", F.lit("sec"), c("cik"), c("form_type"), c("filing_date")), "/-", "__"), title=title, content=F.concat_ws(" | ", *(F.concat(F.lit(label), v) for label, v in parts)),
        summary=F.coalesce(F.nullif(c("summary"), F.lit("")), fallback), authors=F.when(company.isNotNull(), F.array(company)).otherwise(_none("string")), published_date=S.filing_date(c("filing_date")).cast("timestamp"), url=c("filing_url"),
        keywords=F.concat(F.array(form), F.when(company.isNotNull(), F.slice(F.split(F.trim(company), r"\s+"), 1, 3)).otherwise(_none("string"))),
        categories=F.concat(F.array(F.lit("sec_filing"), F.lit("corporate")), S.filing_categories(form)), tags=S.filing_tags(form, c("filing_date"), F.lit(as_of)), metrics=_metrics(importance=S.filing_importance(form)),
    )


def public_document(df: DataFrame) -> DataFrame:
    """Title, content, summary, authors, published_date, url, keywords, tags."""
    return _document(df, _public_document(F.col))


def _public_document(c: Fields) -> dict[str, Column]:
    return _fields(
        id=F.concat(F.lit("public_doc_"), F.md5(F.concat_ws("_", F.col("source_id"), c("title"), F.col("collected_at").cast("string")))), title=F.coalesce(c("title"), F.lit("Public Document")), content=F.coalesce(c("content"), c("summary"), F.lit("")), summary=F.coalesce(c("summary"), F.lit("")),
        authors=F.coalesce(c("authors"), _none("string")), published_date=S.filing_date(c("published_date")).cast("timestamp"), url=c("url"), keywords=F.coalesce(c("keywords"), _none("string")), categories=F.array(F.lit("public_document")), tags=F.coalesce(c("tags"), _none("string")),
    )


def repository(df: DataFrame, as_of) -> DataFrame:
    """The raw repository fields (see ``sources.REPOSITORY``)."""
    return _document(df, _repository(F.col, as_of))


def _repository(c: Fields, as_of) -> dict[str, Column]:
    text = lambda n: F.nullif(c(n), F.lit(""))
    langs = F.array_join(F.array_sort(F.map_keys(c("languages"))), ", ")
    content = F.concat_ws(" | ", F.concat(F.lit("Description: "), text("description")), F.concat(F.lit("README: "), text("readme_content")), F.concat(F.lit("Languages: "), F.nullif(langs, F.lit(""))), F.concat(F.lit("Topics: "), F.nullif(F.array_join(c("topics"), ", "), F.lit(""))))
    topics = F.coalesce(c("topics"), _none("string"))
    shares = F.map_from_entries(F.transform(F.map_entries(F.coalesce(S.language_shares(c("languages")), F.create_map().cast("map<string,double>"))), lambda e: F.struct(F.concat(F.lit("language_"), e["key"]), e["value"])))
    return _fields(
        id=F.replace(F.concat_ws("_", F.lit("github_repo"), c("id").cast("string"), c("full_name")), F.lit("/"), F.lit("_")), title=F.coalesce(c("full_name"), c("name"), F.lit("")), content=content,
        summary=F.coalesce(text("description"), S.summary(content, 150)), authors=F.array(F.coalesce(c("owner.login"), F.lit(""))), published_date=S.iso_timestamp(c("created_at")), url=c("html_url"),
        keywords=F.array_compact(F.concat(topics, F.array(c("language")))), categories=F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(F.lower(c("language"))), F.transform(F.slice(topics, 1, 5), F.lower), S.frameworks(c("description"), c("topics")))))),
        tags=S.repository_tags(c("fork"), c("archived"), c("license.name"), c("stargazers_count"), c("updated_at"), F.lit(as_of)),
        metrics=F.map_concat(_metrics(stars=F.coalesce(c("stargazers_count"), F.lit(0)), watchers=F.coalesce(c("watchers_count"), F.lit(0)), forks=F.coalesce(c("forks_count"), F.lit(0)), open_issues=F.coalesce(c("open_issues_count"), F.lit(0)), size_kb=F.coalesce(c("size"), F.lit(0))), shares),
    )


def issue(df: DataFrame) -> DataFrame:
    """N6."""
    return _document(df, _issue(F.col))


def _issue(c: Fields) -> dict[str, Column]:
    return _fields(id=F.concat(F.lit("github_issue_"), c("id").cast("string")), title=c("title"), content=F.left(F.coalesce(c("body"), F.lit("")), F.lit(1000)), authors=F.array(c("user.login")), published_date=S.iso_timestamp(c("created_at")), url=c("html_url"), keywords=F.coalesce(c("labels.name"), _none("string")), categories=F.array(F.lit("issue")), tags=F.array(F.lit("issue"), c("state")), metrics=_metrics(comments=c("comments")))


def pull_request(df: DataFrame) -> DataFrame:
    """N7."""
    return _document(df, _pull_request(F.col))


def _pull_request(c: Fields) -> dict[str, Column]:
    tags = F.array_compact(F.array(F.lit("pull_request"), c("state"), F.when(c("draft"), "draft")))
    return _fields(id=F.concat(F.lit("github_pr_"), c("id").cast("string")), title=c("title"), content=F.left(F.coalesce(c("body"), F.lit("")), F.lit(1000)), authors=F.array(c("user.login")), published_date=S.iso_timestamp(c("created_at")), url=c("html_url"), keywords=F.array_compact(F.array(c("head.ref"), c("base.ref"))), categories=F.array(F.lit("pull_request")), tags=tags)


def user_event(df: DataFrame) -> DataFrame:
    """N8."""
    return _document(df, _user_event(F.col))


def _user_event(c: Fields) -> dict[str, Column]:
    title = F.concat_ws(" ", c("actor.login"), c("type"), F.lit("on"), c("repo.name"))
    return _fields(id=F.concat(F.lit("github_event_"), c("id").cast("string")), title=title, content=title, authors=F.array(c("actor.login")), published_date=S.iso_timestamp(c("created_at")), keywords=F.array(c("type"), F.element_at(F.split(c("repo.name"), "/"), -1)), categories=F.array(F.lit("user_activity")), tags=F.array(F.lit("event")))


#: The raw records of a mixed feed, by normalizer.
RECORDS = {
    "academic": "title string, abstract string, authors array<string>, published string, url string, keywords array<string>, categories array<string>, citations double, downloads double, impact_factor double",
    "filing": "form_type string, company_name string, cik string, filing_date string, form_description string, summary string, filing_url string",
    "public_document": "title string, content string, summary string, authors array<string>, published_date string, url string, keywords array<string>, tags array<string>",
    "repository": "id bigint, name string, full_name string, description string, owner struct<login:string>, html_url string, language string, languages map<string,bigint>, stargazers_count int, watchers_count int, forks_count int, open_issues_count int, created_at string, updated_at string, size int, topics array<string>, license struct<name:string>, readme_content string, fork boolean, archived boolean",
    "issue": "id bigint, title string, body string, state string, user struct<login:string>, labels array<struct<name:string>>, created_at string, html_url string, comments int",
    "pull_request": "id bigint, title string, body string, state string, user struct<login:string>, created_at string, html_url string, head struct<ref:string>, base struct<ref:string>, draft boolean",
    "user_event": "id string, type string, actor struct<login:string>, repo struct<name:string>, created_at string",
}
_DOCUMENT = "id string, source_type string, source_id string, title string, content string, summary string, authors array<string>, published_date timestamp, collected_date timestamp, url string, keywords array<string>, categories array<string>, tags array<string>, metrics map<string,double>"


def route(source_type: Column, kind: Column, source: Column) -> Column:
    """The normalizer of a landed result, by its source type and its metadata's type and source; null for a source type without one.

    Code projects of an unknown type are repositories, public documents of an unknown source are generic.
    """
    code = F.when(kind.isin("issue", "pull_request", "user_event"), kind).otherwise("repository")
    return F.when(source_type == "academic", "academic").when(source_type == "public_docs", F.when(source == "sec_edgar", "filing").otherwise("public_document")).when(source_type == "code_projects", code)


def landed(lines: DataFrame) -> DataFrame:
    """Landed results, a JSON object in each ``value``, as source_type, source_id, collected_at, route and data (VARIANT). Lines that are none are left out."""
    v = lines.select(F.try_parse_json("value").alias("v")).where("v is not null")
    get = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    rows = v.select(get("source_type").alias("source_type"), get("source_id").alias("source_id"), S.iso_timestamp(get("collected_at")).alias("collected_at"), get("metadata.type").alias("kind"), get("metadata.source").alias("source"), get("data", "variant").alias("data"))
    return rows.select("source_type", "source_id", "collected_at", route(F.col("source_type"), F.col("kind"), F.col("source")).alias("route"), "data")


def routed(results: DataFrame, as_of) -> DataFrame:
    """Landed results (``landed``) through the normalizer that each is routed to, in one pass: the columns of ``DOCUMENT`` and the route.

    A record is taken from its VARIANT by the fields that its own normalizer reads; a field that is missing or of another
    kind is null. Results without a normalizer are left out.
    """
    made = {
        "academic": _academic, "filing": lambda c: _filing(c, as_of), "public_document": _public_document, "repository": lambda c: _repository(c, as_of), "issue": _issue, "pull_request": _pull_request, "user_event": _user_event,
    }
    records = (F.when(F.col("route") == name, F.try_variant_get("data", "$", f"struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in fields.split(', ')))}>")).alias(f"of_{name}") for name, fields in RECORDS.items())
    rows = results.where("route is not null").select("source_type", "source_id", "collected_at", "route", *records)
    document = None
    for name, fields in made.items():
        own = F.struct(*(v.alias(c) for c, v in fields(lambda n, name=name: F.col(f"of_{name}.{n}")).items())).cast(f"struct<{_DOCUMENT}>")
        document = F.when(F.col("route") == name, own) if document is None else document.when(F.col("route") == name, own)
    return rows.select("route", document.alias("d")).select("route", "d.*")


def union(*parts: DataFrame) -> DataFrame:
    """The normalized parts of all sources."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def content_rows(df: DataFrame) -> DataFrame:
    """Content rows from landed results; fallbacks go by presence of a key, not by null.

    df: source_type, source_id, collected_at, data (map of strings).
    """
    d = F.col("data")
    has = lambda k: F.array_contains(F.map_keys(d), k)
    pick = lambda *keys: reduce(lambda rest, k: F.when(has(k), d[k]).otherwise(rest), reversed(keys), F.lit(None).cast("string"))
    out = df.select(
        F.concat_ws("_", "source_type", "source_id", F.unix_seconds(F.col("collected_at").cast("timestamp")).cast("string")).alias("id"), "source_type", "source_id", d["title"].alias("title"), pick("content", "abstract", "selftext").alias("content"),
        pick("url", "pdf_url").alias("url"), pick("author", "authors").alias("author"), S.iso_timestamp(pick("created_date", "published")).alias("published_date"), "collected_at",
    )
    return out.where(F.char_length(F.trim("content")) >= 10)


def child_rows(analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyword and entity rows of nested analyses (id, keywords: array of struct, entities: map of arrays)."""
    k = analyses.select(F.col("id").alias("analysis_id"), F.explode("keywords").alias("k")).select("analysis_id", "k.keyword", "k.score")
    e = analyses.select(F.col("id").alias("analysis_id"), F.explode("entities").alias("entity_type", "own")).select("analysis_id", "entity_type", F.explode("own").alias("entity_text"))
    return k, e
