"""The logical tables of the library over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import sentences
from .operators import analysis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies; texts of a file that one task would read are dealt over the cores. A large table has more parts than cores, and is not shuffled."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", F.col("source").alias("source_type"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    created = F.lit("2024-01-01").cast("date") + F.pmod("doc_id", F.lit(60)).cast("int")
    return d.select(
        F.col("doc_id").alias("paper_id"), F.left(F.get(sentences("text"), F.lit(0)), F.lit(200)).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("source_type"), created.cast("timestamp_ntz").alias("created_at"),
        F.array(F.concat(F.lit("a"), F.pmod("doc_id", F.lit(97)).cast("string")), F.concat(F.lit("a"), F.pmod("doc_id", F.lit(89)).cast("string"))).alias("authors"),
    )


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select(F.col("paper_id").alias("id"), "source_type", "title", F.col("abstract").alias("content"), F.col("created_at").alias("collected_at"), F.col("created_at").alias("published_date"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.frequency_keywords(documents(spark, sf_dir), also=("source_type",))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mentions from the event stream: keyword, topic, ts, paper_id."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_type").alias("keyword"), F.concat_ws("_", "event_type", F.pmod(k, F.lit(10)).cast("string")).alias("topic"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("user_id").alias("paper_id"), F.lit("general").alias("domain"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored reports: labels with the first sentences of their documents as lists."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    s = sentences("text")
    return (
        table(spark, sf_dir, "labels").join(d, "doc_id")
        .select(
            F.col("doc_id").alias("document_id"), F.col("source").alias("provider"), (F.col("quality") * 0.6 + (1 - F.col("toxic")) * 0.3).alias("research_quality_score"),
            (F.lit("2024-01-01").cast("date") + F.pmod("doc_id", F.lit(60)).cast("int")).cast("timestamp_ntz").alias("timestamp"), F.length("text").cast("long").alias("tokens_used"),
            F.slice(s, 1, 2).alias("novel_contributions"), F.slice(s, 3, 1).alias("technical_innovations"), F.slice(s, 4, 1).alias("business_implications"),
        )
    )


def _pick(key, *values):
    """The value at ``key`` modulo the number of values."""
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(key, F.lit(len(values))).cast("int"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of a discussion feed: id, title, text, url, score, time, source_type."""
    p, k = papers(spark, sf_dir), F.col("paper_id")
    title = F.concat(F.coalesce(_pick(k, "Ask HN: ", "Show HN: ", "Tell HN: ", "", "Study: ", "", "Funding: ", ""), F.lit("")), F.coalesce("title", F.lit("")))
    url = F.concat(_pick(k, "https://github.com/x/", "https://ex.org/f", "https://arxiv.org/abs/", "https://www.example.com/p/", "http://reddit.com/r/", None), k.cast("string"), _pick(k, "", ".PDF", "", "", "", ""))
    return p.select(k.alias("id"), title.alias("title"), F.col("abstract").alias("text"), url.alias("url"), F.pmod(k, F.lit(40)).alias("score"), F.col("created_at").alias("time"), "source_type")


FORMS = ["10-K", "10-Q", "8-K", "4", "3", "5", "SC 13D", "N-CSR", "10-K/A", "XX"]


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings of an index: arrival, cik, company_name, form_type, filing_date (text in several formats, some unreadable or missing), filename."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    c = F.pmod("o_custkey", F.lit(40)).cast("string")
    day = F.get(F.array(*(F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "MM-dd-yyyy", "yyyyMMdd")), F.when(F.pmod(k, F.lit(2)) == 0, "unknown")), F.pmod(k, F.lit(5)).cast("int"))
    company = F.when(F.pmod("o_custkey", F.lit(11)) == 0, "").otherwise(F.concat(F.lit("Company  No "), c))
    return o.select(k.alias("arrival"), c.alias("cik"), company.alias("company_name"), _pick(k, *FORMS).alias("form_type"), day.alias("filing_date"), F.concat_ws("/", F.lit("edgar"), c, k.cast("string")).alias("filename"))


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code projects, in the fields of ``readers.REPOSITORY`` that the normalizer reads."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    langs = F.when(F.pmod(k, F.lit(4)) == 0, F.create_map().cast("map<string,long>")).otherwise(F.create_map(F.lit("Python"), F.col("n_chars"), F.lit("C"), F.pmod(k, F.lit(7))))
    created = F.date_format(F.lit("2024-01-01").cast("date") + F.pmod(k, F.lit(60)).cast("int"), "yyyy-MM-dd'T'HH:mm:ss")
    return d.select(
        k.alias("id"), F.concat(F.lit("r"), k.cast("string")).alias("name"), F.concat(F.lit("o"), F.pmod(k, F.lit(9)).cast("string"), F.lit("/r"), k.cast("string")).alias("full_name"), F.when(F.pmod(k, F.lit(5)) == 0, F.lit(None)).otherwise(F.concat(F.lit("A flask and pandas tool in "), "lang")).alias("description"),
        F.struct(F.concat(F.lit("o"), F.pmod(k, F.lit(9)).cast("string")).alias("login")).alias("owner"), F.concat(F.lit("https://github.com/r"), k.cast("string")).alias("html_url"), F.col("lang").alias("language"), langs.alias("languages"),
        F.when(F.pmod(k, F.lit(6)) != 0, F.pmod(k * 37, F.lit(20000)).cast("int")).alias("stargazers_count"), F.pmod(k, F.lit(13)).cast("int").alias("watchers_count"), F.pmod(k, F.lit(17)).cast("int").alias("forks_count"), F.pmod(k, F.lit(3)).cast("int").alias("open_issues_count"), created.alias("created_at"), created.alias("updated_at"),
        F.col("n_chars").cast("int").alias("size"), F.when(F.pmod(k, F.lit(3)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Docker"), F.col("source"), F.lit("nlp"))).alias("topics"), F.struct(F.when(F.pmod(k, F.lit(2)) == 0, "MIT License").otherwise("").alias("name")).alias("license"),
        F.col("text").alias("readme_content"), (F.pmod(k, F.lit(10)) == 0).alias("fork"), (F.pmod(k, F.lit(15)) == 0).alias("archived"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored analyses: two of every paper with an even id, one of those with an id divisible by three: id, document_id, paper_id, created_at, word_count."""
    p = papers(spark, sf_dir)
    runs = F.when(F.pmod("paper_id", F.lit(2)) == 0, F.array(F.lit(0), F.lit(1))).when(F.pmod("paper_id", F.lit(3)) == 0, F.array(F.lit(0)))
    p = p.select("*", F.explode(runs).alias("run"))
    at = F.col("created_at") + F.make_dt_interval(F.col("run") + 1)
    return p.select((F.col("paper_id") * 2 + F.col("run")).alias("id"), F.col("paper_id").alias("document_id"), "paper_id", at.alias("created_at"), F.char_length("abstract").alias("word_count"))


def rich_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with nested fields: concepts with weights, significance, impact, seq."""
    k = F.col("document_id")
    half = F.pmod(k, F.lit(2)) == 0
    scores = F.struct((2 * F.pmod(k, F.lit(6))).cast("double").alias("novelty"), (2 * F.pmod(k, F.lit(4))).cast("double").alias("technical_rigor"), (1 + 2 * F.pmod(k, F.lit(5))).cast("double").alias("practical_impact"), F.lit(None).cast("double").alias("theoretical_contribution"))
    concept = lambda n, w: F.struct(F.concat(F.lit(" Concept "), F.pmod(k, F.lit(n)).cast("string")).alias("concept"), w.alias("weight"))
    return reports(spark, sf_dir).select(
        "*", F.array(concept(5, F.pmod(k, F.lit(4)) / 4), concept(3, F.pmod(k, F.lit(10)) / 10)).alias("concept_keywords"), F.when(F.pmod(k, F.lit(3)) > 0, scores).alias("research_significance"),
        F.when(half, F.struct(F.pmod(k, F.lit(11)).cast("double").alias("impact_score"))).alias("impact_prediction"), F.when(half, F.array(F.lit("survey"))).otherwise(F.array().cast("array<string>")).alias("methodology"), F.concat(F.lit("m"), F.pmod(k, F.lit(3)).cast("string")).alias("model"), k.alias("seq"),
    )
