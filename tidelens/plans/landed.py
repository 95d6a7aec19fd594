"""Registered queries over landed files and streams (S V): the tables are written in a feed's form to the shared folder, and read by the library's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from .. import terms as K
from ..sources import readers, sinks
from ..sources.scratch import folder
from ..streaming import jobs
from .queries import CTE, _NEEDS, _rounded, query


def _lines(df: DataFrame, name: str) -> str:
    path = folder(df.sparkSession, name)
    df.write.text(path)
    return path


def _feed(df: DataFrame, name: str) -> str:
    path = folder(df.sparkSession, name)
    df.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return path


CTE["clean"] = r"clean AS (SELECT paper_id, trim(regexp_replace(regexp_replace(title, '[^\p{L}\p{N}., ]', ' ', 'g'), ' +', ' ', 'g')) AS title, trim(regexp_replace(abstract, '[^\p{L}\p{N}., ]', ' ', 'g')) AS abstract, author_a, author_b, source_type, created_at FROM papers)"
_NEEDS["clean"] = ["papers"]


def _clean(c: str):
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}., ]", " "))


def _stories(spark, d) -> str:
    s = B.stories(spark, d)
    own = F.to_json(F.struct("id", F.lit("story").alias("type"), "title", "text", "url", F.unix_seconds(F.col("time").cast("timestamp")).alias("time"), F.col("source_type").alias("by"), F.col("score").cast("int").alias("score")))
    return _lines(s.select(F.when(F.pmod("id", F.lit(50)) == 7, F.concat(F.lit("{broken "), F.col("id").cast("string"))).otherwise(own).alias("value")), "stories")


@query("landed_stories", ("st",), "SELECT id, title, text, score, time AS created_at FROM st WHERE id % 50 <> 7")
def landed_stories(spark, d):
    """S1, S13."""
    good, _ = readers.json_rows(spark, _stories(spark, d), readers.STORY, "time")
    return _rounded(good.select("id", "title", "text", "score", F.col("created_at").cast("timestamp_ntz").alias("created_at")))


@query("rejected_lines", (), "SELECT '{broken ' || doc_id AS raw_content, 'not readable' AS error_message FROM documents WHERE doc_id % 50 = 7")
def rejected_lines(spark, d):
    """Lines that cannot be read stay as they came."""
    _, bad = readers.json_rows(spark, _stories(spark, d), readers.STORY, "time")
    return bad.select("raw_content", "error_message")


@query("landed_papers", ("clean",), "SELECT '2401.' || paper_id AS id, title, abstract, author_a || '|' || author_b AS authors, 'cs.AI|' || source_type AS categories, 'http://arxiv.org/abs/2401.' || paper_id AS url, 'http://arxiv.org/pdf/2401.' || paper_id AS pdf_url, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS published FROM clean")
def landed_papers(spark, d):
    """S2."""
    k = F.col("paper_id").cast("string")
    link = lambda kind, rel, title: F.struct(F.concat(F.lit(f"http://arxiv.org/{kind}/2401."), k).alias("_href"), F.lit(rel).alias("_rel"), F.lit(title).cast("string").alias("_title"))
    feed = B.papers(spark, d).select(
        F.concat(F.lit("http://arxiv.org/abs/2401."), k).alias("id"), _clean("title").alias("title"), _clean("abstract").alias("summary"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("author"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"),
        F.array(F.struct(F.lit("cs.AI").alias("_term")), F.struct(F.col("source_type").alias("_term"))).alias("category"), F.array(link("abs", "alternate", None), link("pdf", "related", "pdf")).alias("link"),
    )
    e = readers.atom_entries(spark, _feed(feed, "papers"))
    return e.select("id", "title", "abstract", F.array_join("authors", "|").alias("authors"), F.array_join("categories", "|").alias("categories"), "url", "pdf_url", "published")


_FORM_CASE = "CASE form_type " + " ".join(f"WHEN '{form}' THEN '{said}'" for form, said in K.FILING_FORMS.items()) + " ELSE 'Other Filing' END"


@query("landed_filings", ("fl",), f"SELECT cik, trim(company_name) AS company_name, form_type, trim(coalesce(filing_date, '')) AS filing_date, filename, {_FORM_CASE} AS form_description, 'https://www.sec.gov/Archives/' || filename AS filing_url FROM fl")
def landed_filings(spark, d):
    """S3: a daily index for each partition, with lines before and after the header that are no records."""
    fields = F.concat_ws(" | ", F.col("cik"), F.col("company_name"), "form_type", F.coalesce("filing_date", F.lit("")), "filename")
    path = folder(spark, "filings")
    B.filings(spark, d).select(fields.alias("CIK|Company Name|Form Type|Date Filed|Filename")).write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return readers.filing_index(spark, path).select("cik", "company_name", "form_type", "filing_date", "filename", "form_description", "filing_url")


@query("landed_feed", ("fl",), "SELECT '4' AS form_type, 'Acme ' || cik AS company_name, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS filing_date, cik FROM fl JOIN orders ON o_orderkey = arrival WHERE form_type = '4'")
def landed_feed(spark, d):
    """S4."""
    o = B.filings(spark, d).where("form_type = '4'").join(B.table(spark, d, "orders").select(F.col("o_orderkey").alias("arrival"), "o_orderdate"), "arrival")
    feed = o.select(F.concat(F.lit("Form 4 statement by Acme "), "cik", F.lit(" (000"), "cik", F.lit(")")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("updated"), F.array(F.struct(F.concat(F.lit("http://x?CIK="), "cik").alias("_href"))).alias("link"))
    return readers.filing_feed(spark, _feed(feed, "feed")).select("form_type", "company_name", "filing_date", "cik")


@query("snapshot", ("papers",), "SELECT 'contents' AS name, count(*) AS n FROM papers UNION ALL SELECT 'enriched', count(*) FROM pages")
def snapshot(spark, d):
    """Pipeline tables written and read again, without the analyses that a reload drops."""
    path = folder(spark, "snapshot")
    sinks.write_snapshot({"contents": B.contents(spark, d), "enriched": B.table(spark, d, "pages"), "analyses": B.analyses(spark, d)}, path)
    back = sinks.read_snapshot(spark, path)
    out = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in back.items()]
    return out[0].unionByName(out[1])


@query("replaced_children", ("kw",), "SELECT doc_id AS parent, keyword, score FROM kw WHERE doc_id % 3 <> 0 UNION ALL SELECT DISTINCT doc_id, substr(keyword, 1, 5), 1.0::DOUBLE FROM kw WHERE doc_id % 3 = 0")
def replaced_children(spark, d):
    """Every third document is analysed again; the others keep their rows."""
    k = B.keywords(spark, d).select(F.col("document_id").alias("parent"), "keyword", "score", F.col("rank").alias("seq"))
    fresh = k.where(F.pmod("parent", F.lit(3)) == 0).select("parent", F.left("keyword", F.lit(5)).alias("keyword"), F.lit(1.0).alias("score"), "seq")
    return sinks.replace_children(k, fresh, "parent", ["keyword"]).select("parent", "keyword", "score")


@query("merged_reports", ("rr",), "SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 1.0::DOUBLE ELSE score END AS research_quality_score, provider FROM rr UNION ALL SELECT 1000000 + document_id, 0.5::DOUBLE, 'later' FROM rr WHERE document_id % 5 = 0")
def merged_reports(spark, d):
    """Known reports get a new score and keep their provider; unknown ones come in."""
    r = B.reports(spark, d).select("document_id", "research_quality_score", "provider", F.lit(1).alias("seq"))
    again = r.where(F.pmod("document_id", F.lit(2)) == 0).select("document_id", F.lit(1.0).alias("research_quality_score"), F.lit("later").alias("provider"), F.lit(2).alias("seq"))
    new = r.where(F.pmod("document_id", F.lit(5)) == 0).select((F.col("document_id") + 1000000).alias("document_id"), F.lit(0.5).alias("research_quality_score"), F.lit("later").alias("provider"), F.lit(2).alias("seq"))
    return sinks.merge_reports(r, again.unionByName(new)).select("document_id", "research_quality_score", "provider")


@query("report_files", ("rr",), "SELECT provider, model, strftime(ts, '%Y-%m') AS month, count(*) AS n, CAST(sum(len(contribs)) AS BIGINT) AS contributions FROM rr GROUP BY ALL")
def report_files(spark, d):
    """Reports by provider, model and month, read from their folders."""
    path = folder(spark, "reports")
    sinks.write_reports(B.rich_reports(spark, d), path)
    r = spark.read.parquet(path)
    return r.groupBy(F.col("provider").cast("string").alias("provider"), F.col("model").cast("string").alias("model"), F.col("month").cast("string").alias("month")).agg(F.count("*").alias("n"), F.sum(F.size("novel_contributions")).alias("contributions"))


@query("report_keywords", ("rr",), "SELECT DISTINCT document_id, lower(trim(concept)) AS keyword FROM (SELECT document_id, unnest(concepts, recursive := true) FROM rr)")
def report_keywords(spark, d):
    """The index's keywords."""
    return sinks.report_index(B.rich_reports(spark, d))[1]


@query("exported_rows", ("papers",), "SELECT paper_id AS id, title, abstract AS content FROM papers")
def exported_rows(spark, d):
    """Exported as JSON and read again."""
    path = folder(spark, "export")
    sinks.export_json(B.contents(spark, d).select("id", "title", "content"), path)
    return spark.read.schema("id long, title string, content string").json(path)


# Streams: all that has landed, then stop


def _events(spark, d) -> str:
    path = folder(spark, "events")
    B.mentions(spark, d).select("keyword", F.col("ts").cast("string").alias("ts"), F.col("paper_id").cast("string").alias("source_id")).write.json(path)
    return path


_EVENT = "keyword string, ts timestamp, source_id string"


def _replayed(spark, d, job, schema: str) -> DataFrame:
    """What a stream over the landed events has written when it stops."""
    out = folder(spark, "stream-out")
    stream = job(jobs.landed(spark, _events(spark, d), _EVENT, 100_000))
    jobs.ingest(stream, out, folder(spark, "stream-state")).awaitTermination()
    return spark.read.schema(schema).parquet(out)


@query("ingested_events", ("ev",), "SELECT keyword, ts, CAST(paper_id AS VARCHAR) AS source_id FROM ev")
def ingested_events(spark, d):
    """V1."""
    return _replayed(spark, d, lambda s: s, _EVENT).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("deduplicated_stream", ("ev",), "SELECT DISTINCT CAST(paper_id AS VARCHAR) AS source_id FROM ev")
def deduplicated_stream(spark, d):
    """V2: all events land at once, so one row of each source_id stays."""
    return _replayed(spark, d, lambda s: jobs.deduplicated(s, "ts", "365 days"), _EVENT).select("source_id")


@query("streamed_daily_counts", ("ev",), ", m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM ev) SELECT keyword, CAST(ts AS DATE) AS day, count(*) AS n FROM ev, m WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= mark GROUP BY ALL")
def streamed_daily_counts(spark, d):
    """V3: the days that the watermark has passed."""
    return _replayed(spark, d, jobs.daily_counts, "keyword string, day date, n long")


@query("streamed_weekly_counts", ("ev",), ", m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM ev), x AS (SELECT keyword, date_trunc('day', ts) - to_days(CAST(i AS INT)) AS \"start\" FROM ev, range(7) r(i)) SELECT keyword, \"start\", \"start\" + INTERVAL 7 DAY AS \"end\", count(*) AS n FROM x, m WHERE \"start\" + INTERVAL 7 DAY <= mark GROUP BY ALL")
def streamed_weekly_counts(spark, d):
    """V4."""
    out = _replayed(spark, d, jobs.sliding_counts, "keyword string, start timestamp, `end` timestamp, n long")
    return out.select("keyword", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("upserted_stream", ("ev",), "SELECT CAST(paper_id AS VARCHAR) AS source_id, max(ts) AS ts FROM ev GROUP BY paper_id")
def upserted_stream(spark, d):
    """V5: each micro-batch is merged into the stored rows, the last of a key wins."""
    versions = [folder(spark, "upserted")]
    spark.createDataFrame([], _EVENT).write.parquet(versions[0])

    def merge(batch: DataFrame, _: int) -> None:
        stored = spark.read.schema(_EVENT).parquet(versions[-1])
        path = folder(spark, "upserted")
        sinks.latest_wins(stored, batch, ["source_id"], ["keyword"], "ts").write.parquet(path)
        versions.append(path)

    jobs.upsert(jobs.landed(spark, _events(spark, d), _EVENT), merge, folder(spark, "stream-state")).awaitTermination()
    return spark.read.schema(_EVENT).parquet(versions[-1]).select("source_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("streamed_measures", ("sent",), r"SELECT d.doc_id AS id, len(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]')) AS word_count, len(s) AS sentence_count FROM documents d JOIN sent ON sent.doc_id = d.doc_id")
def streamed_measures(spark, d):
    """V6."""
    path, out = folder(spark, "contents"), folder(spark, "stream-out")
    B.documents(spark, d).select(F.col("document_id").alias("id"), F.col("text").alias("content")).write.json(path)
    stream = jobs.analyzed(jobs.landed(spark, path, "id long, content string", 100_000)).select("id", "word_count", "sentence_count")
    jobs.ingest(stream, out, folder(spark, "stream-state")).awaitTermination()
    return _rounded(spark.read.schema("id long, word_count int, sentence_count int").parquet(out))


@query("saved_reports", ("rr",), "SELECT document_id AS id FROM rr WHERE document_id % 3 > 0 AND document_id % 4 > 0")
def saved_reports(spark, d):
    """Saved reports that have both papers and analysis, changed since a time."""
    k = F.col("document_id")
    saved = B.reports(spark, d).select(k.alias("id"), F.when(F.pmod(k, F.lit(3)) > 0, F.array(F.lit("p"))).alias("papers"), F.when(F.pmod(k, F.lit(4)) > 0, F.struct(F.lit("a").alias("text"))).alias("analysis"))
    path = folder(spark, "saved-reports")
    files = saved.groupBy(F.floor(F.col("id") / 1000).alias("bucket")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("id", "papers", "analysis"))), ",\n"), F.lit("]")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)  # each file is one list of up to 1,000 reports over many lines
    return readers.recent_reports(spark, path, "id long, papers array<string>, analysis struct<text:string>", "2020-01-01T00:00:00").select("id")


@query("corpus_footprint", (), "SELECT round(sum(coalesce(strlen(text), 0) + 1) / 1048576, 2) AS megabytes FROM documents")
def corpus_footprint(spark, d):
    """What the texts take up as plain files."""
    path = folder(spark, "plain-texts")
    B.table(spark, d, "documents").select("text").write.text(path)
    return readers.footprint(spark, path).select("megabytes")
