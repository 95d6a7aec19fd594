"""Search, filters and joins over the stored tables (Q, F, J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import terms as K
from ..functions import text as X
from ..functions.scalars import filing_date, relevant, title_domain


def search_all(docs: DataFrame, query: str, source_types: list[str] | None = None, start=None, end=None, most: int = 100, stop_words: list[str] = K.STOP_WORDS) -> DataFrame:
    """Q1: documents that hold every term of the query, newest first. docs: id, title, content, source_type, published_date."""
    wanted = [w for w in query.lower().split() if w not in stop_words]
    if not wanted:  # an empty query matches nothing
        return docs.limit(0)
    toks = X.letter_words(F.concat_ws(" ", "title", "content"))
    d = docs.where(F.size(F.array_intersect(toks, F.array(*map(F.lit, sorted(set(wanted)))))) == len(set(wanted)))
    if source_types:
        d = d.where(F.col("source_type").isin(source_types))
    if start is not None:
        d = d.where(F.col("published_date") >= F.lit(start))
    if end is not None:
        d = d.where(F.col("published_date") <= F.lit(end))
    return d.orderBy(F.desc_nulls_last("published_date"), "id").limit(most)


def inverted_index(docs: DataFrame) -> DataFrame:
    """Q1 for many queries: (term, id) of all content words. docs: id, title, content."""
    return docs.select("id", F.explode(F.array_distinct(X.content_words(F.concat_ws(" ", "title", "content")))).alias("term"))


def search_many(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents that hold all terms of each query. queries: query_id, term."""
    size = queries.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    hits = index.join(queries.distinct(), "term").groupBy("query_id", "id").agg(F.count("*").alias("hits"))
    return hits.join(size, "query_id").where(F.col("hits") == F.col("n")).select("query_id", "id")


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """Q2: rows by id."""
    return table.where(F.col(key) == F.lit(value))


def search_keywords(keywords: DataFrame, wanted: list[str], most: int = 10) -> DataFrame:
    """Documents with any of the keywords, by matches, then mean score. keywords: document_id, keyword, score."""
    g = keywords.where(F.col("keyword").isin(wanted)).groupBy("document_id").agg(F.count_distinct("keyword").alias("matches"), F.round(F.avg("score"), 6).alias("avg_score"))
    return g.orderBy(F.desc("matches"), F.desc("avg_score"), "document_id").limit(most)


def search_entities(entities: DataFrame, entity_type: str, text: str | None = None, most: int = 10) -> DataFrame:
    """Q4, Q5: matches of a type and part of a text; or, without one, each document's entities of the type."""
    e = entities.where(F.col("entity_type") == entity_type)
    if text is not None:
        return e.where(F.col("entity_text").ilike(f"%{text}%")).select("document_id", "entity_text").distinct().orderBy("document_id", "entity_text").limit(most)
    return e.groupBy("document_id").agg(F.array_sort(F.collect_set("entity_text")).alias("entities")).orderBy("document_id").limit(most)


def search_reports(reports: DataFrame, query: str | None = None, provider: str | None = None, min_score: float | None = None, most: int = 50) -> DataFrame:
    """Q6: by id, concepts and contributions; provider; least score (a null score never passes); newest first."""
    r = reports
    if query is not None:
        like = f"%{query}%"
        in_lists = F.exists("novel_contributions", lambda x: x.ilike(like)) | F.exists(F.col("concept_keywords.concept"), lambda x: x.ilike(like))
        r = r.where(F.col("document_id").cast("string").ilike(like) | F.coalesce(in_lists, F.lit(False)))
    if provider is not None:
        r = r.where(F.col("provider") == provider)
    if min_score is not None:
        r = r.where(F.col("research_quality_score") >= min_score)
    return r.orderBy(F.desc("timestamp"), "document_id").limit(most)


def keyword_domains(mentions: DataFrame) -> DataFrame:
    """Q8: the domains of each keyword, ``general`` only where it is alone. mentions: keyword, title, abstract."""
    g = mentions.select("keyword", title_domain("title", "abstract").alias("domain")).groupBy("keyword").agg(F.collect_set("domain").alias("d"))
    named = F.filter("d", lambda x: x != "general")
    return g.select("keyword", F.when(F.size(named) > 0, F.array_sort(named)).otherwise(F.array(F.lit("general"))).alias("domains"))


def context_digest(docs: DataFrame, most: int = 5, preview: int = 200) -> DataFrame:
    """Q9: the first documents' titles and previews in one text."""
    few = docs.orderBy("id").limit(most).select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.left("content", F.lit(preview))).alias("t"))
    return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "t"))), lambda x: x["t"]), "\n\n").alias("context"))


def stories(raw: DataFrame, as_of, max_age_hours: int = 24, min_score: int = 10, terms: list[str] = K.TECH_TERMS, phrases: list[str] = K.TECH_PHRASES) -> DataFrame:
    """Recent, scored, relevant stories. raw: time (timestamp), score, title, text."""
    young = F.col("time") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {max_age_hours} HOURS")
    return raw.where(young & (F.col("score") >= min_score) & relevant(F.concat_ws(" ", "title", "text"), terms, phrases))


def comments(raw: DataFrame, terms: list[str] = K.TECH_TERMS, phrases: list[str] = K.TECH_PHRASES, least_words: int = 10) -> DataFrame:
    """comments of ten words or more that are relevant. raw: text."""
    return raw.where((F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= least_words) & relevant("text", terms, phrases))


def live_comments(raw: DataFrame) -> DataFrame:
    """comments that are not deleted, removed or blank. raw: body."""
    return raw.where(~F.col("body").isin("[deleted]", "[removed]") & (F.trim("body") != ""))


def issues_only(raw: DataFrame) -> DataFrame:
    """issues that are no pull requests."""
    return raw.where(F.col("pull_request").isNull())


def paper_filter(papers: DataFrame, term: str, category: str | None = None) -> DataFrame:
    """a term in title, abstract or comment, and optionally a category."""
    t = F.lit(term.lower())
    found = reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), t), F.lit(False)) for c in ("title", "abstract", "comment")))
    return papers.where(found if category is None else found & F.array_contains("categories", category))


PERIODS = {"week": 7, "month": 30, "year": 365}


def trending_repositories(repos: DataFrame, as_of, period: str = "week", language: str | None = None, most: int = 90) -> DataFrame:
    """repositories created in the period (an unknown one is a week), by stars."""
    r = repos.where(F.col("created_at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {PERIODS.get(period, 7)} DAYS"))
    r = r if language is None else r.where(F.col("language") == language)
    return r.orderBy(F.desc("stargazers_count"), "id").limit(most)


def insider_filings(filings: DataFrame, as_of, days: int = 7, per_form: int = 20) -> DataFrame:
    """F8: up to twenty filings of forms 3, 4, 5 filed in the last days; an unreadable date stays, a missing one goes."""
    from .stats import top_per_group

    own = top_per_group(filings.where(F.col("form_type").isin("3", "4", "5")), ["cik", "form_type"], [F.desc("filing_date"), F.asc("filename")], per_form).drop("rank")
    d = filing_date("filing_date")
    return own.where(F.col("filing_date").isNotNull() & (d.isNull() | (d >= F.date_sub(F.lit(as_of).cast("date"), days))))


def company_filings(filings: DataFrame, cik: str, form: str | None = None, most: int = 20) -> DataFrame:
    """F9."""
    f = filings.where(F.col("cik") == cik)
    f = f if form is None else f.where(F.col("form_type") == form)
    return f.orderBy(F.desc("filing_date"), "filename").limit(most)


def recent(rows: DataFrame, at: str, as_of, hours: int = 24, source_types: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Rows of the last hours and source types, newest first."""
    r = rows.where(F.col(at) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))
    r = r if source_types is None else r.where(F.col("source_type").isin(source_types))
    r = r.orderBy(F.desc(at), "id")
    return r if most is None else r.limit(most)


def stored_stories(contents: DataFrame, keyword: str, as_of, most: int = 20) -> DataFrame:
    """stories of the last 48 hours that hold the keyword."""
    return recent(contents.where(F.contains(F.lower("content"), F.lit(keyword.lower()))), "collected_at", as_of, 48, None, most)


def timeline_base(keywords: DataFrame, analyses: DataFrame) -> DataFrame:
    """Keywords with their analyses' times."""
    return keywords.join(analyses.select(F.col("id").alias("analysis_id"), "created_at", "paper_id"), "analysis_id")


def with_papers(analyses: DataFrame, papers: DataFrame) -> DataFrame:
    """J2."""
    return analyses.join(papers, "paper_id", "left")


def document_analysis(analyses: DataFrame, keywords: DataFrame, entities: DataFrame, document_id) -> DataFrame:
    """The newest analysis of a document with its distinct keywords and entities; children are aggregated before the join."""
    a = analyses.where(F.col("document_id") == F.lit(document_id)).orderBy(F.desc("created_at")).limit(1)
    k = keywords.groupBy("analysis_id").agg(F.array_sort(F.collect_set(F.struct("keyword", "score"))).alias("keyword_rows"))
    e = entities.groupBy("analysis_id").agg(F.array_sort(F.collect_set(F.struct("entity_type", "entity_text"))).alias("entity_rows"))
    return a.join(k, a["id"] == k["analysis_id"], "left").drop("analysis_id").join(e, a["id"] == e["analysis_id"], "left").drop("analysis_id")


def unanalyzed(papers: DataFrame, analyses: DataFrame, most: int | None = 10) -> DataFrame:
    """Papers with text and no analysis, newest first."""
    text = F.coalesce(F.nullif(F.col("full_text"), F.lit("")), F.col("abstract")) if "full_text" in papers.columns else F.col("abstract")
    out = papers.withColumn("text", text).where(F.coalesce(F.col("text"), F.lit("")) != "").join(analyses.select("paper_id"), "paper_id", "left_anti").orderBy(F.desc("created_at"), "paper_id")
    return out if most is None else out.limit(most)


def analysis_input(contents: DataFrame, analyses: DataFrame, enriched: DataFrame) -> DataFrame:
    """Contents without analysis, with the enriched text where enrichment succeeded."""
    waiting = contents.join(analyses.select(F.col("content_id").alias("id")), "id", "left_anti")
    e = enriched.select("id", "success", "enriched_content")
    return waiting.join(e, "id", "left").withColumn("content", F.when(F.coalesce("success", F.lit(False)), F.col("enriched_content")).otherwise(F.col("content"))).drop("success", "enriched_content")


def topic_timeline(rows: DataFrame) -> DataFrame:
    """Mentions and papers of each topic and day. rows: topics (array), ts, paper_id. Topics are exploded once; joined back to their rows by a unique id, they would be the same."""
    return rows.select(F.explode("topics").alias("topic"), F.to_date("ts").alias("day"), "paper_id").groupBy("topic", "day").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))


def reports_with_keywords(reports: DataFrame, keywords: DataFrame, query: str) -> DataFrame:
    """Reports whose id or a keyword matches, with the matching keywords (all of them where the id matches)."""
    like = f"%{query}%"
    joined = reports.join(keywords, "document_id", "left").where(F.col("document_id").cast("string").ilike(like) | F.col("keyword").ilike(like))
    return joined.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), ", ").alias("keywords"))


def generic_reports(reports: DataFrame, papers: DataFrame) -> DataFrame:
    """Reports (document_id, novel_contributions) in which a contribution holds a title of its papers, or a title it."""
    c = reports.select("document_id", F.explode("novel_contributions").alias("c")).withColumn("c", F.trim(F.lower("c")))
    t = papers.select("document_id", F.lower(F.trim(F.replace(F.col("title"), F.lit("\n"), F.lit(" ")))).alias("t"))
    hit = c.join(t, "document_id").where(F.contains("c", F.col("t")) | F.contains("t", F.col("c")))
    return reports.join(hit.select("document_id").distinct(), "document_id", "left_semi")


def form_lookup(filings: DataFrame) -> DataFrame:
    """The form's description, from a broadcast table of 12 rows."""
    forms = filings.sparkSession.createDataFrame(list(K.FILING_FORMS.items()), "form_type string, form_description string")
    return filings.join(F.broadcast(forms), "form_type", "left").withColumn("form_description", F.coalesce("form_description", F.lit("Other Filing")))
