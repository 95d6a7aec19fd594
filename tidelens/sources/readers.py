"""Readers of landed raw feeds (S1-S4, S10, S11, S13), all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import form_lookup

STORY = "id long, type string, title string, text string, url string, time long, `by` string, score int, descendants int, kids array<long>"
COMMENT = "id long, type string, text string, time long, `by` string, parent long"
POST = "id string, title string, selftext string, url string, permalink string, author string, score int, upvote_ratio double, num_comments int, created_utc double, link_flair_text string, domain string, is_self boolean"
REPOSITORY = "id long, name string, full_name string, description string, owner struct<login:string>, html_url string, language string, languages map<string,long>, stargazers_count int, watchers_count int, forks_count int, open_issues_count int, created_at string, updated_at string, pushed_at string, size int, topics array<string>, license struct<name:string>, readme_content string, fork boolean, archived boolean, default_branch string"
ISSUE = "id long, number int, title string, body string, state string, user struct<login:string>, labels array<struct<name:string>>, created_at string, html_url string, comments int, pull_request struct<url:string>, head struct<ref:string>, base struct<ref:string>, mergeable boolean, draft boolean"
EVENT = "id string, type string, actor struct<login:string>, repo struct<name:string>, created_at string"
ENTRY = "id string, title string, summary string, author array<struct<name:string>>, published string, updated string, category array<struct<_term:string,_scheme:string>>, link array<struct<_href:string,_rel:string,_title:string,_type:string>>, primary_category struct<_term:string>, comment string, journal_ref string, doi string"


def json_rows(spark: SparkSession, path: str, schema: str, time: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and the rejected lines as they came; epoch seconds in ``time`` become ``created_at``."""
    parsed = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good, bad = parsed.where("r._corrupt is null").select("r.*").drop("_corrupt"), parsed.where("r._corrupt is not null")
    if time:
        good = good.withColumn("created_at", F.timestamp_seconds(time))
    return good, bad.select(F.lit(False).alias("success"), F.col("r._corrupt").alias("raw_content"), F.lit("not readable").alias("error_message"))


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry; the title stays the entry's own."""
    e = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(ENTRY).load(path)
    link = lambda test: F.get(F.filter("link", test), F.lit(0))["_href"]
    terms = F.col("category._term")
    return e.select(
        F.element_at(F.split("id", "/"), -1).alias("id"), F.trim(F.regexp_replace("title", r"\s+", " ")).alias("title"), F.trim("summary").alias("abstract"), F.col("author.name").alias("authors"), "published", "updated", terms.alias("categories"),
        F.col("primary_category._term").alias("primary_category"), link(lambda x: x["_rel"] == "alternate").alias("url"), link(lambda x: x["_title"] == "pdf").alias("pdf_url"), "comment", "journal_ref", "doi", terms.alias("keywords"),
    )


def filing_index(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """S3: records of pipe-delimited daily indexes: the lines after each file's header that have five fields. A file without header has none.

    Files are read by line, so a large one is split over tasks. A line's place is its split's offset in the file and its number among the
    task's rows, which grows along a split; lines with five fields are joined with the place of their file's first header.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("place"))
    header = lines.where(F.col("value").startswith("CIK|Company Name|")).groupBy("file_path").agg(F.min("place").alias("header"))
    f = F.transform(F.split("value", r"\|"), lambda x: F.trim(F.regexp_replace(x, r"\r$", "")))
    rows = lines.select("file_path", "place", f.alias("f")).where(F.size("f") >= 5).join(header, "file_path").where(F.col("place") > F.col("header"))
    out = rows.select(*(F.col("f")[k].alias(c) for k, c in enumerate(("cik", "company_name", "form_type", "filing_date", "filename"))))
    out = out if form is None else out.where(F.col("form_type") == form)
    return form_lookup(out.withColumn("filing_url", F.concat(F.lit("https://www.sec.gov/Archives/"), "filename")))


def filing_feed(spark: SparkSession, path: str) -> DataFrame:
    """Form, company, date and CIK of a company's feed of filings."""
    e = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema("title string, updated string, link array<struct<_href:string>>, summary string").load(path)
    href = F.get("link", F.lit(0))["_href"]
    title = r"^Form\s+([^\s]+)\s+.*?by\s+(.+?)\s*\("
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return e.select(F.regexp_extract("title", title, 1).alias("form_type"), F.regexp_extract("title", title, 2).alias("company_name"), F.left("updated", F.lit(10)).alias("filing_date"), F.coalesce(found(href, r"CIK=(\d+)"), found("title", r"\((\d+)\)")).alias("cik"), href.alias("filing_url"), "summary")


def recent_reports(spark: SparkSession, path: str, schema: str, modified_after: str) -> DataFrame:
    """Saved reports changed after a time, those with both papers and analysis."""
    rows = spark.read.schema(schema).option("multiLine", True).option("modifiedAfter", modified_after).json(path)
    return rows.where("papers is not null and analysis is not null")


def footprint(spark: SparkSession, path: str) -> DataFrame:
    """Megabytes of a directory's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.agg(F.count("*").alias("files"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1048576, 2).alias("megabytes"))


def pipeline_state(spark: SparkSession, path: str, item: str) -> DataFrame:
    """Collected rows of a saved state file; ``item`` is the schema of one."""
    return spark.read.schema(f"collected_items array<struct<{item}>>").option("multiLine", True).json(path).select(F.explode("collected_items").alias("x")).select("x.*")
