"""Readers on small files; streams against their batch form; the driver contract without the optional parts."""

import json
import subprocess
import sys
from datetime import datetime, timedelta

from tidelens.operators import trends
from tidelens.sources import readers
from tidelens.streaming import jobs

from .conftest import ROOT

ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1907.40312v4</id><title>Tidal lenses
  over   shallow   basins</title><summary>
 Waves bend. </summary><author><name>Ilse Brandt</name></author><author><name>Q. Okoro</name></author><author><name>Rui</name></author><published>2019-07-22T08:15:30Z</published><category term="physics.ao-ph"/><category term="math.NA"/><category term="stat.AP"/>
<link href="http://arxiv.org/pdf/1907.40312v4" title="pdf"/><link href="http://arxiv.org/abs/1907.40312v4" rel="alternate"/></entry></feed>"""
INDEX = "Description: index\nsome|text\n7|before|the|header|x\nCIK|Company Name|Form Type|Date Filed|Filename\n-----\n123| Acme |8-K|2024-01-02|edgar/a.txt\nCIK0124|Beta|XX|2024-01-02|edgar/b.txt\n125|short|8-K|x\n"


def test_atom(spark, tmp_path):
    (tmp_path / "f.xml").write_text(ATOM)
    r = readers.atom_entries(spark, str(tmp_path / "f.xml")).first()
    assert (r["id"], r["title"], r["published"]) == ("1907.40312v4", "Tidal lenses over shallow basins", "2019-07-22T08:15:30Z")
    assert r["authors"] == ["Ilse Brandt", "Q. Okoro", "Rui"] and r["categories"] == r["keywords"] == ["physics.ao-ph", "math.NA", "stat.AP"]
    assert r["url"].endswith("/abs/1907.40312v4") and r["pdf_url"].endswith("/pdf/1907.40312v4") and r["abstract"].strip() == "Waves bend."


def test_filing_index(spark, tmp_path):
    (tmp_path / "i.txt").write_text(INDEX)
    rows = {r["cik"]: r for r in readers.filing_index(spark, str(tmp_path / "i.txt")).collect()}
    assert set(rows) == {"123", "CIK0124"} and rows["123"]["company_name"] == "Acme" and rows["123"]["form_description"] == "Current Report" and rows["CIK0124"]["form_description"] == "Other Filing"


def test_filing_feed(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<feed><entry><title>Form 4 statement by Acme Corp (0000123)</title><updated>2024-01-02T00:00:00</updated><link href="http://x?CIK=99"/></entry></feed>')
    r = readers.filing_feed(spark, str(tmp_path / "x.xml")).first()
    assert (r["form_type"], r["company_name"], r["filing_date"], r["cik"]) == ("4", "Acme Corp", "2024-01-02", "99")


def test_json_rejects(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": 1, "title": "x", "time": 0}\n{broken\n')
    good, bad = readers.json_rows(spark, str(tmp_path / "s.json"), readers.STORY, "time")
    assert good.count() == 1 and bad.select("raw_content").collect()[0][0] == "{broken"


def test_daily_counts_equal_batch_on_closed_days(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [{"keyword": k, "ts": (day + timedelta(days=d, hours=h)).isoformat(), "source_id": f"{k}{d}{h}"} for d in range(6) for h in range(3) for k in "ab"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "keyword string, ts timestamp, source_id string"
    stream = jobs.daily_counts(jobs.landed(spark, str(tmp_path / "in"), schema))
    jobs.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["keyword"], r["day"]): r["n"] for r in spark.read.schema("keyword string, day date, n long").parquet(str(tmp_path / "out")).collect()}
    batch = {(r["keyword"], r["day"]): r["n"] for r in trends.timeline(spark.read.schema(schema).json(str(tmp_path / "in"))).collect()}
    assert got and all(batch[k] == n for k, n in got.items()) and len(got) < len(batch)


def test_filing_index_is_split(spark, tmp_path):
    """A large index is read by several tasks; lines with five fields before the header are no records, and a file without header has none."""
    head = "a | b | c | d | e\nDescription: index\n"
    lines = [f"{k} | Company {k} | 8-K | 2024-01-0{k % 9 + 1} | edgar/{k}" for k in range(20_000)]
    (tmp_path / "a.txt").write_text(head + "CIK|Company Name|Form Type|Date Filed|Filename\n" + "\r\n".join(lines) + "\n1|2\n")
    (tmp_path / "b.txt").write_text(head * 20_000)
    (tmp_path / "c.txt").write_text("CIK|Company Name|Form Type|Date Filed|Filename\n7 | C | XX | | f")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        got = readers.filing_index(spark, str(tmp_path))
        tasks = spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions()
        rows = [(r["cik"], r["company_name"], r["filename"], r["form_description"]) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    want = [(str(k), f"Company {k}", f"edgar/{k}", "Current Report") for k in range(20_000)] + [("7", "C", "f", "Other Filing")]
    assert tasks > 5 and sorted(rows) == sorted(want)


def test_upsert_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "x", "content": "One two. Three."}')
    seen = []
    jobs.upsert(jobs.analyzed(jobs.landed(spark, str(tmp_path / "in"), "id string, content string")), lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert [(r["id"], r["word_count"], r["sentence_count"]) for r in seen] == [("x", 5, 2)]


def test_entry_imports_without_optional_parts():
    code = "import sys; sys.modules['tidelens.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'top_keywords' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
