"""Column expressions on hand-made rows."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidelens.functions import scalars as S
from tidelens.functions import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_syllables(spark):
    for word, n in (("reading", 2), ("the", 1), ("make", 1), ("rhythm", 1), ("queue", 1)):
        assert one(spark, X.syllables("w"), w=word) == n


def test_sentences_and_tokens(spark):
    assert one(spark, X.sentences("t"), t="One. Two! Three? 3.5 is four.") == ["One.", "Two!", "Three?", "3.5 is four."]
    assert one(spark, X.tokens("t"), t="It's re-run, 5%.") == ["It", "'", "s", "re-run", ",", "5", "%", "."]
    assert one(spark, X.letter_words("t"), t="Ab c1 d-e É") == ["ab", "é"]


def test_phrases(spark):
    assert one(spark, X.phrases(F.split("t", " "), 1), t="ab cde fg") == ["ab cde", "ab cde fg", "cde fg"]
    assert one(spark, X.phrases(F.split("t", " "), 2), t="ab cde") == ["ab cde"]
    assert one(spark, X.phrases(F.split("t", " "), 2), t="abc") == []
    assert len(one(spark, X.phrases(F.split("t", " "), 1), t=" ".join(["word"] * 50))) == 20
    assert one(spark, X.grams(F.split("t", " ")), t="a b") == ["a", "b", "a b"]


def test_filing_dates(spark):
    for text in ("2023-12-31", "12/31/2023", "12-31-2023", "20231231", " 2023-12-31 "):
        assert one(spark, S.filing_date("t"), t=text) == date(2023, 12, 31)
    assert one(spark, S.filing_date("t"), t="soon") is None


def test_summary(spark):
    assert one(spark, S.summary("t", 20), t="short") == "short"
    assert one(spark, S.summary("t", 20), t="A sentence here. And then more") == "A sentence here."
    assert one(spark, S.summary("t", 20), t="A. " + "x" * 40) == "A. " + "x" * 17 + "..."
    assert one(spark, S.summary("t", 20), t="y" * 40) == "y" * 20 + "..."


def test_story_class(spark):
    for title, url, kind in (("Ask HN: why", None, "ask_hn"), ("Show HN: x", "https://github.com/a", "show_hn"), ("A tool", "https://github.com/a", "open_source"), ("A study", None, "research"), ("Startup news", None, "business"), ("Other", "", "general")):
        assert one(spark, S.story_class("t", F.lit(url).cast("string")), t=title) == kind


def test_filing_labels(spark):
    assert one(spark, S.filing_categories("f"), f="SC 13D") == ["tender_offer"]
    assert one(spark, S.filing_categories("f"), f="N-PX") == ["investment_company"]
    assert one(spark, S.filing_categories("f"), f="10-K/A") == ["annual_report", "financial_statement"]
    assert [one(spark, S.filing_importance("f"), f=f) for f in ("8-K", "4", "5", "X")] == [9, 8, 4, 3]
    assert one(spark, S.filing_tags("f", "d", F.lit("2024-01-10")), f="8-K/A", d="2024-01-05") == ["sec_filing", "form_8_k_a", "amendment", "urgent", "this_week"]


def test_repository_labels(spark):
    def tags(stars, updated):
        return one(spark, S.repository_tags(F.lit(True), F.lit(False), F.lit("MIT License"), F.lit(stars), F.lit(updated), F.lit("2024-03-01T00:00:00Z").cast("timestamp")))

    assert tags(10001, "2024-02-24T00:00:00Z") == ["repository", "fork", "license-mit-license", "popular", "recently-updated"]
    assert tags(10000, "2024-02-23T00:00:00Z")[3:] == ["trending", "active"]
    assert tags(100, "2023-02-28T00:00:00Z")[3:] == ["stale"]
    assert one(spark, S.frameworks("d", F.array(F.lit("k8s"))), d="A React app for bringing") == ["react", "angular", "kubernetes"]
    assert one(spark, S.language_shares("m"), m=F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.lit(3).cast("long"))) == {"a": 25.0, "b": 75.0}
    assert one(spark, S.readme("t"), t="aGVs\nbG8=") == "hello"


def test_sentences_and_labels(spark):
    assert one(spark, S.clean_sentence("t"), t="  a  b ") == "A b."
    assert one(spark, S.clean_sentence("t"), t="Done!") == "Done!"
    assert [one(spark, S.sentiment_label("p"), p=p) for p in (0.1, 0.11, -0.1, -0.2)] == ["neutral", "positive", "neutral", "negative"]
    assert one(spark, S.web_eligible("u"), u="https://a.org/x") and not one(spark, S.web_eligible("u"), u="https://a.org/x.pdf") and not one(spark, S.web_eligible("u"), u="https://github.com/x")


def test_domains(spark):
    assert one(spark, S.title_domain("t", "a"), t="Said", a="x") == "artificial_intelligence"  # substrings match inside words
    assert one(spark, S.title_domain("t", "a"), t="x", a="Quantum") == "quantum_computing"
    assert one(spark, S.paper_domain("t", "a"), t="A vision model", a="image detection and text") == "computer_vision"
    assert one(spark, S.paper_domain("t", "a"), t="zzz", a="qq") == "general_ai"
    assert one(spark, S.iso_timestamp("t"), t="2024-01-02T03:04:05Z") == datetime(2024, 1, 2, 3, 4, 5)


def test_clean_sentence_capitals_of_one_code_point(spark):
    """As DuckDB's upper has them; Spark's gives SS, FI and ἈΙ."""
    for text, want in (("ßheit", "ẞheit."), ("ﬁn", "ﬁn."), ("ᾀ b", "ᾈ b."), ("ᾈ", "ᾈ."), ("éa", "Éa."), ("ǆ", "Ǆ."), ("", ""), ("a.\u2028", "A.\u2028.")):
        assert one(spark, S.clean_sentence("t"), t=text) == want


def test_capital_is_that_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    wide = [c for c in range(1, 0x1E944) if len(chr(c).upper()) > 1 or c < 0x600 and c not in (0x19B, 0x264)]  # these capitals are newer than DuckDB's tables
    want = dict(duckdb.connect().execute("SELECT c, upper(chr(c)) FROM (SELECT unnest(?::INT[]) AS c)", [wide]).fetchall())
    got = spark.createDataFrame([(c, chr(c)) for c in wide], "c int, t string").select("c", S.capital("t").alias("u")).collect()
    assert {r["c"]: (r["u"], want[r["c"]]) for r in got if r["u"] != want[r["c"]]} == {}
