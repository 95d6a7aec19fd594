"""Roll-ups over stored model responses (L)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import terms as K
from ..functions.scalars import clean_sentence
from ..functions.text import contains_any

RESPONSE = "research_quality_score double, novel_contributions array<string>, technical_innovations array<string>, business_implications array<string>"


def parse_responses(responses: DataFrame, schema: str = RESPONSE) -> DataFrame:
    """L1, L3, L4: the JSON object of each raw_response: fenced or bare, notes after numbers and trailing commas repaired, else the parts that patterns find."""
    raw = F.coalesce("raw_response", F.lit(""))
    fenced = F.regexp_extract(raw, r"(?s)```json(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(raw), r"(?s)\{.*\}", 0)
    noted = F.regexp_replace(body, r"(\d+(?:\.\d+)?)\s*\([^)]+\)", "$1")
    fixed = F.regexp_replace(noted, r",\s*([}\]])", "$1")
    items = lambda key: F.regexp_extract_all(F.regexp_extract(raw, rf'(?s)"{key}"\s*:\s*\[(.*?)\]', 1), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    score = F.regexp_extract(raw, r'"research_quality_score"\s*:\s*(\d+(?:\.\d+)?)', 1)
    names = [c.split()[0] for c in schema.split(", ")]
    manual = F.struct(F.nullif(score, F.lit("")).cast("double").alias(names[0]), *(items(n).alias(n) for n in names[1:]))
    parsed = lambda text: F.when((text != "") & F.from_json(text, "map<string,string>").isNotNull(), F.from_json(text, schema))
    any_ = (score != "") | F.exists(F.array(*(F.size(items(n)) for n in names[1:])), lambda n: n > 0)
    out = responses.withColumn("analysis", F.coalesce(parsed(noted), parsed(fixed), F.when(any_, manual)))
    return out.withColumn("error", F.when(F.col("analysis").isNull(), "no JSON found")).select(*responses.columns, "analysis.*", "error")


def list_response(text) -> Column:
    """L2: the JSON list, or without brackets the lines without bullets."""
    t = F.col(text) if isinstance(text, str) else text
    listed = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-* 0-9.]+", ""))), lambda x: x != "")
    return F.when(listed != "", F.from_json(listed, "array<string>")).otherwise(lines)


def quality_score(contributions, significance, methodology) -> Column:
    """Mean of four sub-scores over 10 (missing: 5), a bonus for contributions up to 0.3 and for a methodology; 1 at most."""
    s = F.col(significance)
    subs = [F.coalesce(s[k], F.lit(5.0)) for k in ("novelty", "technical_rigor", "practical_impact", "theoretical_contribution")]
    base = F.when(s.isNotNull(), (subs[0] + subs[1] + subs[2] + subs[3]) / 40).otherwise(0.0)
    n = F.coalesce(F.size(contributions), F.lit(0))
    return F.round(F.least(F.lit(1.0), base + F.least(0.1 * F.greatest(n, F.lit(0)), F.lit(0.3)) + F.when(F.coalesce(F.size(methodology), F.lit(0)) > 0, 0.1).otherwise(0.0)), 2)


def deep_report_score(text, findings) -> Column:
    """1 to 5."""
    t = F.lower(text)
    return F.least(F.lit(5.0), F.lit(1.0) + F.when(F.char_length(text) > 1000, 1.0).otherwise(0.0) + F.when(F.size(findings) > 3, 1.0).otherwise(0.0) + F.when(F.contains(t, F.lit("methodology")), 0.5).otherwise(0.0) + F.when(F.contains(t, F.lit("implications")), 0.5).otherwise(0.0))


def integer_score(text) -> Column:
    """The first number 0 to 10."""
    return F.nullif(F.regexp_extract(text, r"\b([0-9]|10)\b", 1), F.lit("")).cast("int")


def _themes(reports: DataFrame, column: str, top: int = 5, longer_than: int = 4, filter_first: bool = False) -> DataFrame:
    """The most frequent words of a list column; the length filter comes after the top, as a rule."""
    words = reports.select(F.explode(column).alias("x")).select(F.explode(F.split(F.lower("x"), r"\s+")).alias("word")).where("word <> ''")
    if filter_first:
        words = words.where(F.char_length("word") > longer_than)
    g = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)
    return g.where(F.char_length("word") > longer_than)


def intelligence_summary(reports: DataFrame) -> DataFrame:
    """Papers, mean score, contributions, papers over 0.8, papers with two contributions."""
    n = F.size("novel_contributions")
    return reports.agg(F.count("*").alias("papers"), F.round(F.avg("research_quality_score"), 6).alias("avg_score"), F.sum(n).alias("contributions"), F.count_if(F.col("research_quality_score") > 0.8).alias("high_quality"), F.count_if(n >= 2).alias("several_contributions"))


def first_items(reports: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The first entries of a list column over all reports, in order of document and place."""
    return reports.select("document_id", F.posexplode(column).alias("at", "item")).orderBy("document_id", "at").limit(most)


def contribution_themes(reports: DataFrame) -> DataFrame:
    """L10."""
    return _themes(reports, "novel_contributions")


def implication_themes(reports: DataFrame, top: int = 5) -> DataFrame:
    """L13."""
    return _themes(reports, "business_implications", top)


def contribution_density(reports: DataFrame) -> DataFrame:
    """Distinct contributions, and how many a paper has."""
    c = reports.select("document_id", F.explode_outer("novel_contributions").alias("c"))
    return c.agg(F.count_distinct("c").alias("distinct_contributions"), (F.count("c") / F.greatest(F.count_distinct("document_id"), F.lit(1))).alias("density"))


def quality_bands(reports: DataFrame) -> DataFrame:
    """Three and five bands with shares, mean, range, sample deviation."""
    s, n = F.col("research_quality_score"), F.greatest(F.count("*"), F.lit(1))
    three = {"high": s > 0.8, "medium": (s >= 0.5) & (s <= 0.8), "low": s < 0.5}
    five = {"exceptional": s >= 0.9, "excellent": (s >= 0.8) & (s < 0.9), "good": (s >= 0.6) & (s < 0.8), "fair": (s >= 0.4) & (s < 0.6), "weak": s < 0.4}
    return reports.agg(
        F.count("*").alias("total"), F.avg(s).alias("mean"), F.max(s).alias("max"), (F.max(s) - F.min(s)).alias("range"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("std"),
        *(F.count_if(c).alias(k) for k, c in (three | five).items()), *((F.count_if(c) / n).alias(f"{k}_share") for k, c in three.items()),
        (F.count_if(F.size("technical_innovations") > 0) / n).alias("innovation_rate"), (F.count_if(F.size("business_implications") > 0) / n).alias("implication_rate"),
    )


def sub_scores(reports: DataFrame) -> DataFrame:
    """Means of the sub-scores that are there."""
    return reports.agg(*(F.avg(f"research_significance.{k}").alias(k) for k in ("novelty", "technical_rigor", "practical_impact")))


def impact(reports: DataFrame) -> DataFrame:
    """Mean impact score (missing: 5), counts from 8 and 9 on."""
    s = F.coalesce("impact_prediction.impact_score", F.lit(5.0))
    return reports.agg(F.avg(s).alias("avg_impact"), F.count_if(s >= 8).alias("high_impact"), F.count_if(s >= 9).alias("breakthrough"))


def business_depth(reports: DataFrame) -> DataFrame:
    """Distinct implications, rate, and mean number over papers above 0.8 (0 if none)."""
    n = F.size("business_implications")
    return reports.agg((F.count_if(n > 0) / F.greatest(F.count("*"), F.lit(1))).alias("rate"), F.coalesce(F.avg(F.when(F.col("research_quality_score") > 0.8, n)), F.lit(0.0)).alias("mean_high_quality"))


def concept_trends(reports: DataFrame, floor: float = 0.7, top: int = 10) -> DataFrame:
    """Concepts above a weight, by reports, with coverage."""
    c = reports.select("document_id", F.explode("concept_keywords").alias("k")).where(F.col("k.weight") > floor)
    g = c.groupBy(F.col("k.concept").alias("concept")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(reports.agg(F.count("*").alias("all")))).select("concept", "n", (F.col("n") / F.col("all")).alias("coverage")).orderBy(F.desc("n"), "concept").limit(top)


def innovation_trends(reports: DataFrame, top: int = 5) -> DataFrame:
    """Innovations by number, with their share of reports."""
    g = reports.select(F.explode("technical_innovations").alias("innovation")).groupBy("innovation").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(reports.agg(F.count("*").alias("all")))).select("innovation", "n", (F.col("n") / F.greatest("all", F.lit(1))).alias("frequency")).orderBy(F.desc("n"), "innovation").limit(top)


def contribution_trends(reports: DataFrame) -> DataFrame:
    """Contribution words of over 5 letters."""
    return _themes(reports, "novel_contributions", 5, 5, True)


def recommendation_data(reports: DataFrame) -> DataFrame:
    """Band of the mean score and the suggested threshold."""
    m = F.avg("research_quality_score")
    return reports.agg(m.alias("avg_score"), F.when(m > 0.8, "high").when(m > 0.6, "medium").otherwise("low").alias("band"), F.greatest(F.lit(0.6), m - 0.1).alias("suggested_threshold"))


def completeness(reports: DataFrame) -> DataFrame:
    """Share of reports with contributions, significance and concepts."""
    full = (F.size("novel_contributions") > 0) & F.col("research_significance").isNotNull() & (F.size("concept_keywords") > 0)
    share = F.coalesce(F.avg(F.coalesce(full, F.lit(False)).cast("int")), F.lit(0.0))
    return reports.agg(share.alias("completeness"), F.when(share > 0.8, "complete").otherwise("partial").alias("verdict"))


def _pick(abstract: Column, test, least: int = 20) -> Column:
    """The first sentence (by ``. ``) that passes and is long enough once cleaned."""
    found = F.filter(F.split(abstract, r"\. "), test)
    return F.get(F.filter(F.transform(found, clean_sentence), lambda s: F.char_length(s) > least), F.lit(0))


def mine_contribution(abstract="abstract", title="title") -> Column:
    """L19."""
    a, first = F.col(abstract), F.get(F.split(F.col(abstract), r"\. "), F.lit(0))
    fallback = F.when(F.char_length(first) > 30, F.concat(F.lit("From "), F.get(F.split(F.col(title), ":"), F.lit(0)), F.lit(": "), F.left(first, F.lit(150)), F.lit("...")))
    return F.coalesce(F.left(_pick(a, lambda s: contains_any(F.lower(s), K.NOVELTY_TERMS)), F.lit(200)), fallback)


def mine_innovation(abstract="abstract") -> Column:
    """L20."""
    a = F.col(abstract)
    return F.left(F.coalesce(_pick(a, lambda s: s.rlike("|".join(K.NUMBER_PATTERNS))), _pick(a, lambda s: contains_any(F.lower(s), K.METHOD_WORDS))), F.lit(200))


def mine_implication(abstract="abstract", title="title") -> Column:
    """L21."""
    a = F.col(abstract)
    rule = F.when(F.lit(False), "")
    for word, text in K.TITLE_IMPLICATIONS:
        rule = rule.when(F.contains(F.lower(title), F.lit(word)), text)
    return F.coalesce(F.left(_pick(a, lambda s: contains_any(F.lower(s), K.BUSINESS_TERMS)), F.lit(200)), F.left(_pick(a, lambda s: contains_any(F.lower(s), K.IMPACT_TERMS)), F.lit(200)), rule)


def mine_insights(papers: DataFrame, most: int = 5) -> DataFrame:
    """L19-L21 for each report: papers (document_id, at, title, abstract) to three lists of up to five."""
    p = papers.select("document_id", "at", mine_contribution().alias("c"), mine_innovation().alias("i"), mine_implication().alias("b"))
    listed = lambda c: F.slice(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("at", F.col(c).alias("x"))), lambda s: s["x"].isNotNull())), lambda s: s["x"]), 1, most)
    return p.groupBy("document_id").agg(listed("c").alias("mined_contributions"), listed("i").alias("mined_innovations"), listed("b").alias("mined_implications"))


def replace_generic(reports: DataFrame, papers: DataFrame) -> DataFrame:
    """Where a report only repeats its papers' titles, its lists are mined from their abstracts."""
    from .search import generic_reports

    flagged = generic_reports(reports, papers).select("document_id", F.lit(True).alias("generic"))
    j = reports.join(flagged, "document_id", "left").join(mine_insights(papers), "document_id", "left")
    swap = lambda own, mined: F.when(F.coalesce("generic", F.lit(False)), F.col(mined)).otherwise(F.col(own)).alias(own)
    lists = {"novel_contributions": "mined_contributions", "technical_innovations": "mined_innovations", "business_implications": "mined_implications"}
    return j.select(*(swap(c, lists[c]) if c in lists else F.col(c) for c in reports.columns))


LABELS = [("contribution", ["contribution", "innovation"]), ("approach", ["approach", "method"]), ("result", ["result"]), ("significance", ["significance", "matter"]), ("application", ["application", "use"])]


def labelled_lines(responses: DataFrame) -> DataFrame:
    """The last line of each label in a text response, and the completeness score. responses: response_id, raw_response."""
    lines = responses.select("response_id", F.posexplode(F.split("raw_response", "\n")).alias("at", "line")).where(F.contains("line", F.lit(":")))
    label = F.when(F.lit(False), "")
    for name, words in LABELS:
        label = label.when(contains_any(F.lower(F.substring_index("line", ":", 1)), words), name)
    rows = lines.withColumn("label", label).withColumn("value", F.trim(F.expr("substr(line, locate(':', line) + 1)"))).where("label is not null")
    g = rows.groupBy("response_id").agg(*(F.max_by(F.when(F.col("label") == n, F.col("value")), F.when(F.col("label") == n, F.col("at"))).alias(n) for n, _ in LABELS))
    good = sum((F.when((F.char_length(n) > 20) & ~F.col(n).startswith("Unable to parse"), 1).otherwise(0) for n, _ in LABELS), F.lit(0))
    return responses.select("response_id").join(g, "response_id", "left").withColumn("completeness", good / 5 * 10)
