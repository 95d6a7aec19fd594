"""Aggregates, windows, set operations, report sections and job-log roll-ups (A, W, U, P, H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import terms as K


def top_keywords(keywords: DataFrame, top: int = 20) -> DataFrame:
    """A1: keyword, documents, avg and max score; by documents, then average. keywords: document_id, keyword, score."""
    g = keywords.groupBy("keyword").agg(F.count_distinct("document_id").alias("document_count"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("max_score"))
    return g.orderBy(F.desc("document_count"), F.desc("avg_score"), "keyword").limit(top)


def top_entities(entities: DataFrame, entity_type: str | None = None, top: int = 20) -> DataFrame:
    """A2: distinct documents of each (text, type). entities: document_id, entity_type, entity_text."""
    e = entities if entity_type is None else entities.where(F.col("entity_type") == entity_type)
    g = e.groupBy("entity_text", "entity_type").agg(F.count_distinct("document_id").alias("document_count"))
    return g.orderBy(F.desc("document_count"), "entity_text", "entity_type").limit(top)


def sentiment_distribution(analyses: DataFrame, start=None, end=None) -> DataFrame:
    """A3: totals, averages and label counts in an optional time range. analyses: polarity, subjectivity, sentiment_label, created_at."""
    a = analyses
    if start is not None:
        a = a.where(F.col("created_at") >= F.lit(start))
    if end is not None:
        a = a.where(F.col("created_at") <= F.lit(end))
    labels = [F.count_if(F.col("sentiment_label") == s).alias(f"{s}_count") for s in ("positive", "negative", "neutral")]
    return a.agg(F.count("*").alias("total"), F.avg("polarity").alias("avg_polarity"), F.avg("subjectivity").alias("avg_subjectivity"), *labels)


def analysis_summary(analyses: DataFrame) -> DataFrame:
    """A4: counts, distinct papers, averages and the time span."""
    return analyses.agg(F.count("*").alias("total"), F.count_distinct("paper_id").alias("papers"), F.avg("word_count").alias("avg_words"), F.avg("sentence_count").alias("avg_sentences"), F.avg("readability").alias("avg_readability"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def report_stats(reports: DataFrame, as_of, high: float = 8, low: float = 5) -> DataFrame:
    """A5: bands of the quality score (null in none), mean, recent reports, tokens."""
    s = F.col("research_quality_score")
    return reports.agg(
        F.count("*").alias("total"), F.count_if(s >= high).alias("high_quality"), F.count_if((s >= low) & (s < high)).alias("medium_quality"), F.count_if(s < low).alias("low_quality"),
        F.avg(s).alias("avg_score"), F.count_if(F.col("timestamp") >= F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")).alias("recent"), F.sum("tokens_used").alias("tokens"),
    )


def provider_stats(reports: DataFrame) -> DataFrame:
    """Reports and mean score of each provider, most first."""
    return reports.groupBy("provider").agg(F.count("*").alias("n"), F.avg("research_quality_score").alias("avg_score")).orderBy(F.desc("n"), "provider")


def pipeline_stats(contents: DataFrame, analyses: DataFrame, as_of) -> DataFrame:
    """Totals, coverage in per cent, last 24 hours, last times. Both sides are one row."""
    day = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    c = contents.agg(F.count("*").alias("collected"), F.count_if(F.col("collected_at") >= day).alias("collected_24h"), F.max("collected_at").alias("last_collected"), F.count_distinct("source_type").alias("sources"))
    a = analyses.agg(F.count("*").alias("analyzed"), F.count_if(F.col("analyzed_at") >= day).alias("analyzed_24h"), F.max("analyzed_at").alias("last_analyzed"))
    return c.crossJoin(F.broadcast(a)).withColumn("coverage", F.when(F.col("collected") == 0, 0.0).otherwise(F.round(F.col("analyzed") * 100 / F.col("collected"), 2)))


def source_counts(contents: DataFrame) -> DataFrame:
    """Items of each source and their share in per cent."""
    g = contents.groupBy("source_type").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(contents.agg(F.count("*").alias("all")))).select("source_type", "n", (F.col("n") * 100 / F.col("all")).alias("share"))


def dashboard(docs: DataFrame, sample: int | None = 20, top: int = 10) -> DataFrame:
    """Sources and the most frequent first three categories, over the newest ``sample`` rows (None: all), as (section, name, n)."""
    newest = docs if sample is None else docs.orderBy(F.desc("collected_date"), "id").limit(sample)
    sources = newest.groupBy(F.col("source_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("source").alias("section"), "name", "n")
    cats = newest.select(F.explode(F.slice("categories", 1, 3)).alias("name")).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top)
    return sources.unionByName(cats.select(F.lit("category").alias("section"), "name", "n"))


def category_counts(docs: DataFrame, sample: int | None = 100) -> DataFrame:
    """Categories over the newest ``sample`` rows (None: all)."""
    newest = docs if sample is None else docs.orderBy(F.desc("collected_date"), "id").limit(sample)
    return newest.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    """A10: totals, successes by type, failures, mean and best ratio (1.0 without any), success rate."""
    ok = F.col("success")
    return enriched.agg(
        F.count("*").alias("total"), F.count_if(ok & (F.col("enrichment_type") == "pdf_extract")).alias("pdf_success"), F.count_if(ok & (F.col("enrichment_type") == "web_scrape")).alias("web_success"), F.count_if(~ok).alias("failures"),
        F.coalesce(F.avg(F.when(ok, F.col("ratio"))), F.lit(1.0)).alias("avg_ratio"), F.coalesce(F.max(F.when(ok, F.col("ratio"))), F.lit(1.0)).alias("max_ratio"), F.coalesce(F.avg(ok.cast("double")), F.lit(0.0)).alias("success_rate"),
    )


def batch_summary(papers: DataFrame, analyses: DataFrame, entities: DataFrame) -> DataFrame:
    """Papers analysed, waiting and without text, and entity rows of the analysed. papers: paper_id, abstract."""
    e = entities.groupBy(F.col("document_id").alias("paper_id")).agg(F.count("*").alias("entities"))
    joined = papers.join(analyses.select("paper_id", F.lit(True).alias("done")).distinct(), "paper_id", "left").join(e, "paper_id", "left")
    status = F.when(F.col("done"), "processed").when(F.coalesce(F.trim("abstract"), F.lit("")) == "", "skipped").otherwise("waiting")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"))


def failure_tally(log: DataFrame) -> DataFrame:
    """Failures by type with the last time. log: failure_type, ts."""
    return log.where("failure_type is not null").groupBy("failure_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))


def keyword_insights(keywords: DataFrame, top: int = 20) -> DataFrame:
    """Frequency, scores and sources of each keyword. keywords: keyword, score, source_type."""
    g = keywords.groupBy("keyword").agg(F.count("*").alias("frequency"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("score").alias("max_score"), F.array_sort(F.collect_set("source_type")).alias("sources"))
    return g.withColumn("n_sources", F.size("sources")).orderBy(F.desc("frequency"), F.desc("avg_score"), "keyword").limit(top)


def host_stats(pages: DataFrame) -> DataFrame:
    """Fetches and failures of each host. pages: url, success."""
    return pages.groupBy(F.try_parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failed"))


def usage_stats(log: DataFrame) -> DataFrame:
    """Requests, tokens, failures and the success rate with a divisor of 1 at least."""
    n, failed = F.count("*"), F.count_if(~F.col("success"))
    return log.agg(n.alias("requests"), F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"), failed.alias("failures"), ((n - failed) / F.greatest(n, F.lit(1))).alias("success_rate"))


def model_comparison(log: DataFrame) -> DataFrame:
    """Success, latency, tokens, score and structured output of each model, ranked by score. log: model, success, seconds, tokens_used, score, structured."""
    g = log.groupBy("model").agg(F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("seconds").alias("avg_seconds"), F.sum("tokens_used").alias("tokens"), F.avg("score").alias("avg_score"), F.max("structured").alias("structured"))
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.desc("avg_score"))))  # one row per model


def batch_rollup(tasks: DataFrame) -> DataFrame:
    """Sums per task type and up to ten distinct top keywords. tasks: task_type, results_count, duration_seconds, keywords."""
    g = tasks.groupBy("task_type").agg(F.count("*").alias("tasks"), F.sum("results_count").alias("results"), F.sum("duration_seconds").alias("seconds"))
    words = tasks.select("task_type", F.explode("keywords").alias("keyword")).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("task_type").orderBy("keyword"))).where(F.col("rank") <= 10)
    return g.join(words.groupBy("task_type").agg(F.array_sort(F.collect_list("keyword")).alias("top_keywords")), "task_type", "left")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each group in an order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top)


def source_top_themes(keywords: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent keywords within each source. keywords: source_type, keyword."""
    g = keywords.groupBy("source_type", "keyword").agg(F.count("*").alias("n"))
    return top_per_group(g, ["source_type"], [F.desc("n"), F.asc("keyword")], top)


def source_global_keywords(keywords: DataFrame, top: int = 5) -> DataFrame:
    """Keywords of each source ranked by their frequency over all sources, then average score."""
    overall = keywords.groupBy("keyword").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))
    own = keywords.select("source_type", "keyword").distinct().join(overall, "keyword")
    return top_per_group(own, ["source_type"], [F.desc("n"), F.desc("avg_score"), F.asc("keyword")], top)


def first_occurrence(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in order."""
    return top_per_group(rows, [key], order, 1).drop("rank")


def ranked_filings(filings: DataFrame, most: int, arrival: str = "at") -> DataFrame:
    """The first ``most`` by arrival, then by importance. filings: form_type, importance."""
    return filings.orderBy(arrival).limit(most).orderBy(F.desc("importance"), arrival)


def language_rows(repos: DataFrame) -> DataFrame:
    """Language shares of each repository, by bytes. repos: id, languages."""
    rows = repos.select("id", F.explode("languages").alias("language", "bytes"))
    total = F.sum("bytes").over(Window.partitionBy("id"))
    return rows.withColumn("share", F.when(total > 0, F.col("bytes") * 100 / total)).orderBy("id", F.desc("bytes"), "language")


def new_keywords(mentions: DataFrame) -> DataFrame:
    """Keywords of the latest day that the day before (with data) has not. mentions: keyword, ts."""
    rows = mentions.select("keyword", F.to_date("ts").alias("day")).distinct()
    last = [r["day"] for r in rows.select("day").distinct().orderBy(F.desc("day")).limit(2).collect()]  # two values
    if not last:
        return rows
    latest = rows.where(F.col("day") == F.lit(last[0]))
    return latest if len(last) < 2 else latest.join(rows.where(F.col("day") == F.lit(last[1])).select("keyword"), "keyword", "left_anti")


def source_overlap(keywords: DataFrame, shown: int = 5) -> DataFrame:
    """Keywords that two sources share: their number and the first few. keywords: source_type, keyword."""
    k = keywords.select("source_type", "keyword").distinct()
    pair = ["source_a", "source_b"]
    a, b = k.select(F.col("source_type").alias("source_a"), "keyword"), k.select(F.col("source_type").alias("source_b"), "keyword")
    joined = a.join(b, "keyword").where("source_a < source_b")
    # Ranked, not gathered: two sources may share any number of keywords.
    few = top_per_group(joined, pair, [F.asc("keyword")], shown).groupBy(pair).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("shared"))
    return joined.groupBy(pair).agg(F.count("*").alias("n_shared")).join(few, pair)


def executive_summary(contents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Contents, analyses, coverage, sources, mean length, span in days."""
    c = contents.agg(F.count("*").alias("contents"), F.count_distinct("source_type").alias("sources"), F.avg(F.char_length("content")).alias("avg_length"), F.date_diff(F.max("collected_at"), F.min("collected_at")).alias("span_days"))
    a = analyses.agg(F.count("*").alias("analyses"))
    return c.crossJoin(F.broadcast(a)).withColumn("coverage", F.when(F.col("contents") == 0, 0.0).otherwise(F.col("analyses") * 100 / F.col("contents")))


def trend_section(mentions: DataFrame, top: int = 10) -> DataFrame:
    """Keywords by count with mean score. mentions: keyword, score."""
    return mentions.groupBy("keyword").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score")).orderBy(F.desc("n"), "keyword").limit(top)


def cross_source_section(keywords: DataFrame, contents: DataFrame, summaries: DataFrame) -> DataFrame:
    """Items, three themes and mean summary length of each source."""
    themes = source_top_themes(keywords).groupBy("source_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("themes"))
    items = contents.groupBy("source_type").agg(F.count("*").alias("items"))
    length = contents.select(F.col("id").alias("document_id"), "source_type").join(summaries, "document_id").groupBy("source_type").agg(F.avg(F.char_length("summary")).alias("avg_summary_length"))
    return items.join(themes, "source_type", "left").join(length, "source_type", "left")


def landscape(contents: DataFrame, analyses: DataFrame, keywords: DataFrame) -> DataFrame:
    """Mean words, mean keywords of an item, sentiment counts (missing is neutral)."""
    a = analyses.agg(F.avg("word_count").alias("avg_words"), F.count_if(F.col("sentiment_label") == "positive").alias("positive"), F.count_if(F.col("sentiment_label") == "negative").alias("negative"), F.count_if(F.coalesce("sentiment_label", F.lit("neutral")) == "neutral").alias("neutral"))
    k = keywords.agg(F.count("*").alias("keywords")).crossJoin(F.broadcast(contents.agg(F.count("*").alias("contents"))))
    return a.crossJoin(F.broadcast(k)).withColumn("avg_keywords", F.col("keywords") / F.greatest("contents", F.lit(1))).drop("keywords")


def landscape_sources(contents: DataFrame, as_of, top: int = 3) -> DataFrame:
    """Items of each source, their share in per cent, those of the last 24 hours, and whether it is among the top sources."""
    day = F.lit(as_of).cast("timestamp_ntz") - F.expr("INTERVAL 24 HOURS")
    g = contents.groupBy("source_type").agg(F.count("*").alias("n"), F.count_if(F.col("collected_at") >= day).alias("n_24h"))
    whole = Window.partitionBy()  # one row per source
    return g.select("source_type", "n", (F.col("n") * 100 / F.sum("n").over(whole)).alias("share"), "n_24h", (F.row_number().over(whole.orderBy(F.desc("n"), "source_type")) <= top).alias("top_source"))


def technology_mentions(keywords: DataFrame, terms: list[str] = K.REPORT_TECH_TERMS, top: int = 10, samples: int = 3) -> DataFrame:
    """P5: keywords equal to a technology term, with sample titles. keywords: keyword, title, score."""
    hit = keywords.where(F.lower("keyword").isin(terms)).withColumn("term", F.lower("keyword"))
    n = hit.groupBy("term").agg(F.count("*").alias("n"))
    title = F.when(F.char_length("title") > 50, F.concat(F.left("title", F.lit(50)), F.lit("..."))).otherwise(F.col("title"))
    few = top_per_group(hit.withColumn("context", title), ["term"], [F.desc("score"), F.asc("title")], samples).groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context"))), lambda x: x["context"]).alias("contexts"))
    return n.join(few, "term").orderBy(F.desc("n"), "term").limit(top)


def recommendation_flags(stats: DataFrame) -> DataFrame:
    """Flags over a row of pipeline statistics."""
    return stats.select((F.col("coverage") < 80).alias("low_coverage"), (F.col("collected_24h") == 0).alias("no_new"), (F.col("collected_24h") < 5).alias("few_new"), (F.col("sources") < 3).alias("few_sources"))


def recent_metadata(contents: DataFrame, as_of, days: int, cap: int = 100) -> DataFrame:
    """Items and sources of the last days, over the newest ``cap`` items."""
    recent = contents.where(F.col("collected_at") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")).orderBy(F.desc("collected_at"), "id").limit(cap)
    return recent.agg(F.count("*").alias("items"), F.array_sort(F.collect_set("source_type")).alias("sources"))


def job_status(log: DataFrame) -> DataFrame:
    """H1: tasks and mean duration of each status. log: status, duration_seconds."""
    return log.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg("duration_seconds"), 6).alias("avg_seconds"))


def scheduler_summary(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """H2: enabled and running tasks, next five runs, last ten executions, as (section, name, at)."""
    flags = tasks.agg(F.count_if("enabled").alias("enabled"), F.count_if("running").alias("running")).selectExpr("stack(2, 'enabled', cast(enabled as string), 'running', cast(running as string)) as (section, name)").withColumn("at", F.lit(None).cast("timestamp_ntz"))
    upcoming = tasks.where("enabled").orderBy("next_run", "task_id").limit(5).select(F.lit("next").alias("section"), F.col("task_id").alias("name"), F.col("next_run").alias("at"))
    last = log.orderBy(F.desc("started_at"), "execution_id").limit(10).select(F.lit("last").alias("section"), F.col("execution_id").alias("name"), F.col("started_at").alias("at"))
    return flags.unionByName(upcoming).unionByName(last)


def cycle_summary(log: DataFrame) -> DataFrame:
    """H3: collected, analyzed, reports and errors of each cycle and query."""
    return log.groupBy("cycle", "query").agg(*(F.sum(c).alias(c) for c in ("collected", "analyzed", "reports", "errors")))
