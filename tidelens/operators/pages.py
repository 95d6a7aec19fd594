"""Report pages composed of other operators (P7, P8), as long rows (section, name, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import correlate, stats, trends


def _section(df: DataFrame, section: str, name, value) -> DataFrame:
    return df.select(F.lit(section).alias("section"), (F.col(name) if isinstance(name, str) else name).cast("string").alias("name"), F.col(value).cast("double").alias("value"))


def _top(df: DataFrame, top: int) -> DataFrame:
    return df.orderBy(F.desc("value"), "name").limit(top)


def analysis_report(mentions: DataFrame, elements: DataFrame, topics: DataFrame, keywords: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Ten keyword trends, five emerging topics, five pairs, three clusters, fifteen keywords.

    mentions: keyword, topic, ts, paper_id, domain; elements: paper_id, kind, element; topics: paper_id, topic, rank; keywords: document_id, keyword, score.
    """
    end = F.lit(as_of).cast("date")
    own = keywords.select(F.col("document_id").alias("paper_id"), "keyword")
    parts = [
        _top(_section(trends.keyword_trends(mentions, as_of, days), "keyword_trend", "keyword", "strength"), 10),
        _top(_section(trends.emerging_topics(mentions, F.date_sub(end, 3 * days), end), "emerging_topic", "topic", "emergence_score"), 5),
        _top(_section(correlate.top_pairs(elements, 5, by_name=True), "pair", F.concat_ws("-", "paper_a", "paper_b"), "score"), 5),
        _top(_section(correlate.topic_clusters(topics, own), "cluster", "cluster", "coherence"), 3),
        _section(stats.top_keywords(keywords, 15), "keyword", "keyword", "document_count"),
    ]
    return reduce(DataFrame.unionByName, parts)


def statistics_page(analyses: DataFrame, keywords: DataFrame, entities: DataFrame) -> DataFrame:
    """Analyses, papers and mean words; ten keywords, ten entities, sentiment shares in per cent.

    analyses: paper_id, word_count, sentence_count, readability, polarity, subjectivity, sentiment_label, created_at.
    """
    summary = stats.analysis_summary(analyses).selectExpr("stack(3, 'total', cast(total as double), 'papers', cast(papers as double), 'avg_words', avg_words) as (name, value)")
    moods = stats.sentiment_distribution(analyses).selectExpr("stack(3, 'positive', positive_count * 100.0D / total, 'negative', negative_count * 100.0D / total, 'neutral', neutral_count * 100.0D / total) as (name, value)")
    parts = [
        _section(summary, "summary", "name", "value"), _section(stats.top_keywords(keywords, 10), "keyword", "keyword", "document_count"),
        _section(stats.top_entities(entities, None, 10), "entity", "entity_text", "document_count"), _section(moods, "sentiment_share", "name", "value"),
    ]
    return reduce(DataFrame.unionByName, parts)
