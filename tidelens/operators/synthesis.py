"""Cross-paper synthesis (Y).

papers: paper_id, title, abstract, authors, innovations, implications (array<string>, null without analysis).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as K
from ..functions.scalars import paper_domain
from ..functions.text import contains_any


def classify(papers: DataFrame, domains: dict[str, list[str]] = K.PAPER_DOMAINS) -> DataFrame:
    """Y1."""
    return papers.withColumn("domain", paper_domain("title", "abstract", domains))


def technical_terms(text) -> Column:
    """Y2: groups of the three patterns, of over 2 letters, distinct; the single-word pattern keeps all."""
    t = F.lower(text)
    a, b, c = K.TECHNICAL_PATTERNS
    pairs = F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(g)) for p in (a, c) for g in (1, 2)))
    return F.array_distinct(F.concat(F.filter(pairs, lambda w: F.char_length(w) > 2), F.regexp_extract_all(t, F.lit(b), F.lit(1))))


def timeframe(support: Column, papers: Column) -> Column:
    """Y6."""
    return F.when(support == 0, "unknown").when(support >= papers * 0.5, "established").when(support >= papers * 0.3, "growing").otherwise("emerging")


def _total(papers: DataFrame) -> DataFrame:
    return F.broadcast(papers.agg(F.count("*").alias("papers")))


def technical_mentions(papers: DataFrame) -> DataFrame:
    """paper_id and term, a row for each innovation of a paper that has the term."""
    return papers.select("paper_id", F.explode("innovations").alias("x")).select("paper_id", F.explode(technical_terms(F.col("x"))).alias("term"))


def technical_trends(papers: DataFrame, least: int = 3, confidence: float = 0.6) -> DataFrame:
    """Terms of innovations by mentions (several per paper count); ``evidence`` is the number of their papers, which are rows of ``technical_mentions``."""
    each = technical_mentions(papers).groupBy("term", "paper_id").agg(F.count("*").alias("n"))
    g = each.groupBy("term").agg(F.sum("n").alias("mentions"), F.count("*").alias("evidence")).crossJoin(_total(papers))
    c = F.least(F.col("mentions") / F.col("papers"), F.lit(1.0))
    out = g.select(F.concat(F.lit("tech_trend_"), F.left(F.md5("term"), F.lit(8))).alias("trend_id"), F.col("term").alias("trend_name"), F.lit("technical").alias("trend_type"), "mentions", "evidence", c.alias("confidence"), timeframe(F.col("evidence"), F.col("papers")).alias("timeframe"))
    return out.where((F.col("mentions") >= least) & (F.col("confidence") >= confidence))


def family_papers(papers: DataFrame, families: dict[str, list[str]], extra: str, lower_extra: bool = False) -> DataFrame:
    """paper_id and family, a row for each family that a paper speaks of; the list column ``extra`` is searched as well."""
    more = F.coalesce(F.array_join(extra, " "), F.lit(""))
    text = F.concat(F.lower(F.concat_ws(" ", "title", "abstract")), F.lit(" "), F.lower(more) if lower_extra else more)
    hits = F.array_compact(F.array(*(F.when(contains_any(text, own), name) for name, own in families.items())))
    return papers.select("paper_id", F.explode(hits).alias("family"))


def _families(papers: DataFrame, families: dict[str, list[str]], extra: str, lower_extra: bool, kind: str, prefix: str, least: int, confidence: float) -> DataFrame:
    each = family_papers(papers, families, extra, lower_extra).groupBy("family", "paper_id").agg(F.count("*").alias("n"))
    g = each.groupBy("family").agg(F.sum("n").alias("mentions"), F.count("*").alias("evidence")).crossJoin(_total(papers))
    out = g.select(F.concat(F.lit(prefix), "family").alias("trend_id"), F.initcap(F.replace(F.col("family"), F.lit("_"), F.lit(" "))).alias("trend_name"), F.lit(kind).alias("trend_type"), "mentions", "evidence", (F.col("mentions") / F.col("papers")).alias("confidence"), timeframe(F.col("evidence"), F.col("papers")).alias("timeframe"))
    return out.where((F.col("mentions") >= least) & (F.col("confidence") >= confidence))


def method_trends(papers: DataFrame, families: dict[str, list[str]] = K.METHOD_FAMILIES, least: int = 3, confidence: float = 0.6) -> DataFrame:
    """Papers of each family; innovations are searched without lower-casing."""
    return _families(papers, families, "innovations", False, "methodological", "method_trend_", least, confidence)


def application_trends(papers: DataFrame, families: dict[str, list[str]] = K.APPLICATION_FAMILIES, least: int = 3, confidence: float = 0.6) -> DataFrame:
    """Y5."""
    return _families(papers, families, "implications", False, "application", "app_trend_", least, confidence)


def all_trends(papers: DataFrame, least: int = 3, confidence: float = 0.6) -> DataFrame:
    """U4: the three families of trends."""
    return technical_trends(papers, least, confidence).unionByName(method_trends(papers, least=least, confidence=confidence)).unionByName(application_trends(papers, least=least, confidence=confidence))


def emerging_themes(trends: DataFrame, floor: float = 0.7, most: int = 10) -> DataFrame:
    """Y7."""
    return trends.where(F.col("confidence") > floor).orderBy(F.desc("confidence"), "trend_id").limit(most).select("trend_name", "trend_type", "confidence", "evidence", "timeframe")


def research_gaps(papers: DataFrame) -> DataFrame:
    """Least covered domains under an imbalance of over 3, and missing themes of innovations. papers have a domain."""
    d = papers.groupBy("domain").agg(F.count("*").alias("n"))
    span = F.broadcast(d.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("domains")))
    under = d.crossJoin(span).where((F.col("domains") > 1) & (F.col("high") / F.col("low") > 3) & (F.col("n") == F.col("low"))).select(F.lit("underrepresented").alias("gap"), F.col("domain").alias("detail"))
    x = papers.select(F.explode_outer("innovations").alias("x"))
    said = x.agg(F.coalesce(F.bool_or(contains_any(F.lower("x"), ["evaluation", "benchmark"])), F.lit(False)).alias("evaluation"), F.coalesce(F.bool_or(contains_any(F.lower("x"), ["interpretabil", "explain"])), F.lit(False)).alias("interpretability"))
    missing = said.selectExpr("stack(2, 'evaluation', evaluation, 'interpretability', interpretability) as (detail, said)").where("not said").select(F.lit("missing_theme").alias("gap"), "detail")
    return under.unionByName(missing)


def collaboration(papers: DataFrame) -> DataFrame:
    """Authors of several papers, the first five, and distinct over all authors."""
    g = papers.select(F.explode("authors").alias("author")).groupBy("author").agg(F.count("*").alias("n"))
    return g.agg(F.count_if(F.col("n") > 1).alias("prolific"), F.slice(F.array_sort(F.collect_set(F.when(F.col("n") > 1, F.col("author")))), 1, 5).alias("researchers"), (F.count("*") / F.sum("n")).alias("diversity"))


def convergence(papers: DataFrame) -> DataFrame:
    """Words of over 3 letters that the innovations of a domain repeat, five of them, and their share of its words. papers have a domain."""
    x = papers.select("domain", F.explode("innovations").alias("x"))
    big = x.groupBy("domain").agg(F.count("*").alias("k")).where(F.col("k") > 2).select("domain")
    w = x.join(big, "domain").select("domain", F.explode(F.filter(F.split(F.lower("x"), r"\s+"), lambda s: s != "")).alias("word")).groupBy("domain", "word").agg(F.count("*").alias("n"))
    common = (F.col("n") > 1) & (F.char_length("word") > 3)
    g = w.groupBy("domain").agg(F.slice(F.array_sort(F.collect_set(F.when(common, F.col("word")))), 1, 5).alias("common_elements"), F.count_if(common).alias("c"), F.count("*").alias("all"))
    return g.where(F.col("c") > 0).select("domain", "common_elements", (F.col("c") / F.col("all")).alias("strength"))


def synthesis_quality(papers: DataFrame, trends: DataFrame) -> DataFrame:
    """Quality, confidence interval and flags, one row. papers have a domain."""
    p = papers.agg(F.count("*").alias("papers"), F.count_distinct("domain").alias("domains"), F.coalesce(F.avg(F.col("innovations").isNotNull().cast("double")), F.lit(0.0)).alias("analyzed"))
    t = trends.agg(F.count("*").alias("trends"), F.avg("confidence").alias("mean"), F.coalesce(F.stddev_samp("confidence"), F.lit(0.0)).alias("std"), F.max_by("trend_name", "confidence").alias("top_trend"), F.coalesce(F.bool_or(F.col("trend_type") == "methodological"), F.lit(False)).alias("any_method"))
    d = papers.groupBy("domain").agg(F.count("*").alias("n")).agg(F.max_by("domain", F.struct("n", "domain")).alias("dominant_domain"))
    part = lambda x, n: F.least(F.col(x) / n, F.lit(1.0))
    j = p.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(d))
    return j.select(
        "papers", "trends", "domains", ((part("papers", 20) + part("trends", 10) + part("domains", 5) + F.col("analyzed")) / 4).alias("quality"),
        F.greatest(F.lit(0.0), F.col("mean") - 1.96 * F.col("std")).alias("confidence_low"), F.least(F.lit(1.0), F.col("mean") + 1.96 * F.col("std")).alias("confidence_high"),
        (F.col("papers") < 10).alias("small_sample"), (F.col("analyzed") < 0.8).alias("incomplete"), (F.col("domains") <= 1).alias("single_domain"), (F.col("papers") < 20).alias("expand_sample"), "top_trend", "dominant_domain", "any_method",
    )


def synthesize(papers: DataFrame, least_papers: int = 5) -> DataFrame:
    """The synthesis row of recent papers; none under five papers."""
    p = classify(papers)
    return synthesis_quality(p, all_trends(papers)).where(F.col("papers") >= least_papers)
