"""Registered queries of the library over the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as B
from .. import terms as K
from ..functions import scalars as S
from ..functions import text as X
from ..operators import analysis, correlate, enrich, normalize, pages, rubric, search, stats, synthesis, trends
from ..sources import sinks
from ..sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

STOPS = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_WORD = r"[\p{L}\p{N}]+(?:[’-][\p{L}\p{N}]+)*"
_MARK = r"regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g')"
#: Logical tables of the oracle.
CTE = {
    "words": rf"words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS term FROM documents)",
    "lw": r"lw AS (SELECT doc_id, term FROM words WHERE regexp_full_match(term, '\p{L}+'))",
    "cw": f"cw AS (SELECT doc_id, term FROM lw WHERE term NOT IN ({STOPS}))",
    "kwn": "kwn AS (SELECT doc_id, term, count(*) AS n FROM cw WHERE length(term) > 3 GROUP BY doc_id, term)",
    "kwr": "kwr AS (SELECT doc_id, term AS keyword, n / max(n) OVER (PARTITION BY doc_id) AS score, n AS frequency, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM kwn)",
    "kw": "kw AS (SELECT k.doc_id, k.keyword, k.score, k.frequency, k.rank, d.source AS source_type FROM kwr k JOIN documents d ON k.doc_id = d.doc_id WHERE rank <= 10)",
    "sent": f"sent AS (SELECT doc_id, string_split({_MARK}, chr(1)) AS s FROM documents)",
    "papers": "papers AS (SELECT d.doc_id AS paper_id, substr(s[1], 1, 200) AS title, text AS abstract, source AS source_type, CAST(DATE '2024-01-01' + CAST(d.doc_id % 60 AS INTEGER) AS TIMESTAMP) AS created_at, 'a' || (d.doc_id % 97) AS author_a, 'a' || (d.doc_id % 89) AS author_b FROM documents d JOIN sent ON sent.doc_id = d.doc_id)",
    "reports": "reports AS (SELECT l.doc_id AS document_id, d.source AS provider, quality * 0.6::DOUBLE + (1 - toxic) * 0.3::DOUBLE AS score, CAST(DATE '2024-01-01' + CAST(l.doc_id % 60 AS INTEGER) AS TIMESTAMP) AS ts, length(d.text) AS tokens_used, s[1:2] AS contribs, s[3:3] AS innovs, s[4:4] AS impls FROM labels l JOIN documents d ON l.doc_id = d.doc_id JOIN sent ON sent.doc_id = d.doc_id)",
    "ev": "ev AS (SELECT event_type AS keyword, event_type || '_' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS topic, CAST(ts AS TIMESTAMP) AS ts, user_id AS paper_id FROM events)",
    "pos": f"pos AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS l FROM documents)) WHERE regexp_full_match(term, '\\p{{L}}+') AND term NOT IN ({STOPS}))",
}
_NEEDS = {"lw": ["words"], "cw": ["lw"], "kwn": ["cw"], "kwr": ["kwn"], "kw": ["kwr"], "papers": ["sent"], "reports": ["sent"]}


def _with(*names: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join(CTE[n] for n in order) + " "


def query(name: str, needs: tuple[str, ...] = (), sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = (_with(*needs) if needs else "") + sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def _list(column: str) -> str:
    return f"array_join({column}, '|')"


# Text analysis


@query("top_keywords", ("kw",), "SELECT keyword, count(DISTINCT doc_id) AS document_count, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score FROM kw GROUP BY keyword ORDER BY document_count DESC, avg_score DESC, keyword LIMIT 20")
def top_keywords(spark, d):
    return _rounded(stats.top_keywords(B.keywords(spark, d)))


@query("frequency_keywords", ("kw",), "SELECT doc_id AS document_id, keyword, round(score, 6) AS score, frequency, rank FROM kw")
def frequency_keywords(spark, d):
    return _rounded(B.keywords(spark, d).drop("source_type"))


@query("local_weights", ("cw",), "SELECT doc_id AS document_id, term, n, round(n * ln(1 + 1 / (1 + n)), 6) AS weight FROM (SELECT doc_id, term, count(*) AS n FROM cw GROUP BY doc_id, term)")
def local_weights(spark, d):
    return _rounded(analysis.local_weights(B.documents(spark, d)))


@query("word_sentence_counts", ("sent",), rf"SELECT d.doc_id AS document_id, len(regexp_extract_all(text, '{X.TOKEN}')) AS word_count, CASE WHEN trim(text) = '' THEN 0 ELSE len(s) END AS sentence_count FROM documents d JOIN sent ON d.doc_id = sent.doc_id")
def word_sentence_counts(spark, d):
    return _rounded(analysis.counts(B.documents(spark, d)))


@query(
    "flesch", ("lw", "sent"),
    rf"""SELECT d.doc_id AS document_id, round(CASE WHEN w = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * w / ns - 84.6::DOUBLE * coalesce(y, 0) / w)) END, 6) AS readability
    FROM (SELECT d.doc_id, len(regexp_extract_all(text, '{X.TOKEN}')) AS w, len(s) AS ns FROM documents d JOIN sent ON d.doc_id = sent.doc_id) d
    LEFT JOIN (SELECT doc_id, sum(greatest(len(regexp_extract_all(term, '[aeiouy]+')) - CASE WHEN term LIKE '%e' THEN 1 ELSE 0 END, 1)) AS y FROM lw GROUP BY doc_id) y ON y.doc_id = d.doc_id""",
)
def flesch(spark, d):
    return _rounded(analysis.readability(B.documents(spark, d)))


_GRAMS = """g AS (SELECT a.doc_id, a.i, 1 AS k, a.term AS p FROM pos a UNION ALL SELECT a.doc_id, a.i, 2, a.term || ' ' || b.term FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.i = a.i + 1
    UNION ALL SELECT a.doc_id, a.i, 3, a.term || ' ' || b.term || ' ' || c.term FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND b.i = a.i + 1 JOIN pos c ON a.doc_id = c.doc_id AND c.i = a.i + 2)"""


@query("ngrams", ("pos",), f", {_GRAMS}, r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS place FROM g WHERE length(p) > 3) SELECT doc_id AS document_id, place, p AS phrase FROM r WHERE place <= 20")
def ngrams(spark, d):
    return analysis.phrase_lists(B.documents(spark, d)).select("document_id", F.posexplode("phrases").alias("place", "phrase")).withColumn("place", F.col("place").cast("long") + 1)


@query(
    "topics", ("pos",),
    f", {_GRAMS}, r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS pl FROM g WHERE length(p) > 3 AND k >= 2), c AS (SELECT doc_id, p, count(*) AS n, min(pl) AS pl FROM r WHERE pl <= 20 GROUP BY doc_id, p), q AS (SELECT doc_id, p, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pl) AS rank FROM c) SELECT doc_id AS document_id, p AS topic, n, rank FROM q WHERE rank <= 5",
)
def topics(spark, d):
    return _rounded(analysis.topics(B.documents(spark, d)))


@query(
    "tfidf", ("pos",),
    ", p2 AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM pos WHERE length(term) > 1), " + _GRAMS.replace("pos ", "p2 ")
    + ", c AS (SELECT doc_id, p, count(*) AS n FROM g GROUP BY doc_id, p), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM c) SELECT doc_id AS document_id, p AS term, n, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS score FROM r WHERE rank <= 100",
)
def tfidf(spark, d):
    return _rounded(analysis.tfidf_keywords(B.documents(spark, d)))


@query("corpus_tfidf", ("cw",), ", t AS (SELECT doc_id, term, count(*) AS n FROM cw GROUP BY doc_id, term) SELECT doc_id AS document_id, term, round(n * (ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*) OVER (PARTITION BY term))) + 1), 6) AS score FROM t")
def corpus_tfidf(spark, d):
    return _rounded(analysis.corpus_tfidf(B.documents(spark, d)))


_P2 = "p2 AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM pos WHERE length(term) > 1)"


@query(
    "hybrid_keywords", ("pos", "kwr"),
    f""", {_P2}, {_GRAMS.replace("pos ", "p2 ").replace("g AS (", "g2 AS (", 1)}, c2 AS (SELECT doc_id, p, count(*) AS n FROM g2 GROUP BY doc_id, p), r2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM c2),
    a AS (SELECT doc_id, p AS term, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS a FROM r2 WHERE rank <= 100), b AS (SELECT doc_id, keyword AS term, score AS b FROM kwr WHERE rank <= 10),
    ab AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.term, b.term) AS term, CASE WHEN a IS NULL THEN b * 0.8::DOUBLE WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS score FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.term = b.term),
    {_GRAMS}, ph AS (SELECT DISTINCT doc_id, p AS term FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS place FROM g WHERE length(p) > 3) WHERE place <= 20),
    e AS (SELECT * FROM ab UNION ALL SELECT doc_id, term, 0.5::DOUBLE FROM ph WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.doc_id = ph.doc_id AND ab.term = ph.term)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM e)
    SELECT doc_id AS document_id, term, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
)
def hybrid_keywords(spark, d):
    return _rounded(analysis.hybrid_keywords(B.documents(spark, d)))


@query(
    "summary_sentences", ("cw", "sent"),
    f""", w AS (SELECT doc_id, term, n * ln(1 + 1 / (1 + n)) AS weight FROM (SELECT doc_id, term, count(*) AS n FROM cw GROUP BY doc_id, term)), sx AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM sent WHERE len(s) > 5),
    sw AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(x), '{_WORD}')) AS term FROM sx), sc AS (SELECT sw.doc_id, i, round(avg(weight), 9) AS score FROM sw JOIN w ON w.doc_id = sw.doc_id AND w.term = sw.term GROUP BY sw.doc_id, i),
    rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM sc)
    SELECT sx.doc_id AS document_id, string_agg(x, ' ' ORDER BY sx.i) AS summary FROM rk JOIN sx ON sx.doc_id = rk.doc_id AND sx.i = rk.i WHERE k <= 5 GROUP BY sx.doc_id UNION ALL SELECT d.doc_id, text FROM documents d JOIN sent ON sent.doc_id = d.doc_id WHERE len(s) <= 5""",
)
def summary_sentences(spark, d):
    return analysis.summaries(B.documents(spark, d))


_DEMO = {"AFTER_THE": r"\bthe\s+([A-Za-z]{6,})", "AFTER_OF": r"\bof\s+([A-Za-z]{6,})"}


@query(
    "entities", (),
    "WITH e AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '(?i){p}', 1)) AS t FROM documents" for k, p in _DEMO.items()) + "), r AS (SELECT doc_id, kind, t, row_number() OVER (PARTITION BY doc_id, kind ORDER BY t) AS k FROM (SELECT DISTINCT * FROM e)) SELECT doc_id AS document_id, kind AS entity_type, t AS entity_text FROM r WHERE k <= 5",
)
def entities(spark, d):
    return analysis.entities(B.documents(spark, d), _DEMO)


@query(
    "top_entities", (),
    "WITH e AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '(?i){p}', 1)) AS t FROM documents" for k, p in _DEMO.items()) + "), r AS (SELECT doc_id, kind, t, row_number() OVER (PARTITION BY doc_id, kind ORDER BY t) AS k FROM (SELECT DISTINCT * FROM e)) SELECT t AS entity_text, kind AS entity_type, count(DISTINCT doc_id) AS document_count FROM r WHERE k <= 5 GROUP BY t, kind ORDER BY document_count DESC, t, kind LIMIT 20",
)
def top_entities(spark, d):
    return stats.top_entities(entities(spark, d))


_LEX = "lex(word, polarity, subjectivity) AS (VALUES " + ", ".join(f"('{w}', {p}::DOUBLE, {s}::DOUBLE)" for w, p, s in K.LEXICON) + ")"
_SENTIMENT = f", {_LEX}, m AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS s FROM lw JOIN lex ON lw.term = lex.word GROUP BY doc_id), se AS (SELECT d.doc_id, coalesce(p, 0.0) AS polarity, coalesce(s, 0.0) AS subjectivity FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id), sl AS (SELECT *, CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM se)"


@query("sentiment", ("lw",), _SENTIMENT + " SELECT doc_id AS document_id, round(polarity, 6) AS polarity, round(subjectivity, 6) AS subjectivity, sentiment_label FROM sl")
def sentiment(spark, d):
    return _rounded(analysis.sentiment(B.documents(spark, d)))


@query("sentiment_distribution", ("lw",), _SENTIMENT + " SELECT count(*) AS total, round(avg(polarity), 6) AS avg_polarity, round(avg(subjectivity), 6) AS avg_subjectivity, count(*) FILTER (sentiment_label = 'positive') AS positive_count, count(*) FILTER (sentiment_label = 'negative') AS negative_count, count(*) FILTER (sentiment_label = 'neutral') AS neutral_count FROM sl")
def sentiment_distribution(spark, d):
    return _rounded(stats.sentiment_distribution(analysis.sentiment(B.documents(spark, d))))


@query(
    "sentence_sentiment", ("sent",),
    f""", {_LEX}, sx AS (SELECT doc_id, unnest(s[1:50]) AS x, generate_subscripts(s[1:50], 1) AS i FROM sent), sw AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(x), '{_WORD}')) AS term FROM sx),
    m AS (SELECT doc_id, i, avg(polarity) AS p FROM sw JOIN lex ON lex.word = sw.term GROUP BY doc_id, i), sp AS (SELECT sx.doc_id, coalesce(p, 0.0) AS p FROM sx LEFT JOIN m ON m.doc_id = sx.doc_id AND m.i = sx.i)
    SELECT doc_id AS document_id, round(avg(p), 4) AS avg_sentence_polarity, round(stddev_pop(p), 4) AS std_sentence_polarity, count(*) FILTER (p > 0.1) AS positive_sentences, count(*) FILTER (p < -0.1) AS negative_sentences, count(*) FILTER (abs(p) <= 0.1) AS neutral_sentences FROM sp GROUP BY doc_id""",
)
def sentence_sentiment(spark, d):
    return _rounded(analysis.sentence_sentiment(B.documents(spark, d)), 4)


@query("full_analysis")
def full_analysis(spark, d):
    """T1, the lists joined."""
    out = analysis.analyze(B.documents(spark, d))
    joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    kinds = F.array_sort(F.transform(F.map_entries("entities"), lambda e: F.concat_ws(":", e["key"], F.array_join(e["value"], ","))))
    return _rounded(out.select("document_id", "word_count", "sentence_count", "readability", "summary", joined("keywords.keyword").alias("keywords"), joined("topics").alias("topics"), joined(kinds).alias("entities"), "polarity", "subjectivity", "sentiment_label", "positive_sentences", "negative_sentences"))


# Keyword statistics over sources


@query("keyword_insights", ("kw",), "SELECT keyword, count(*) AS frequency, round(avg(score), 6) AS avg_score, round(max(score), 6) AS max_score, string_agg(DISTINCT source_type, '|' ORDER BY source_type) AS sources, count(DISTINCT source_type) AS n_sources FROM kw GROUP BY keyword ORDER BY frequency DESC, avg_score DESC, keyword LIMIT 20")
def keyword_insights(spark, d):
    return _rounded(stats.keyword_insights(B.keywords(spark, d)).withColumn("sources", F.array_join("sources", "|")))


@query("source_top_themes", ("kw",), "SELECT source_type, keyword, n, rank FROM (SELECT source_type, keyword, count(*) AS n, row_number() OVER (PARTITION BY source_type ORDER BY count(*) DESC, keyword) AS rank FROM kw GROUP BY source_type, keyword) WHERE rank <= 3")
def source_top_themes(spark, d):
    return _rounded(stats.source_top_themes(B.keywords(spark, d)))


@query("source_global_keywords", ("kw",), ", o AS (SELECT keyword, count(*) AS n, round(avg(score), 6) AS avg_score FROM kw GROUP BY keyword), r AS (SELECT keyword, source_type, n, avg_score, row_number() OVER (PARTITION BY source_type ORDER BY n DESC, avg_score DESC, keyword) AS rank FROM (SELECT DISTINCT source_type, keyword FROM kw) JOIN o USING (keyword)) SELECT * FROM r WHERE rank <= 5")
def source_global_keywords(spark, d):
    return _rounded(stats.source_global_keywords(B.keywords(spark, d)))


@query("source_overlap", ("kw",), ", k AS (SELECT DISTINCT source_type, keyword FROM kw), j AS (SELECT a.source_type AS source_a, b.source_type AS source_b, a.keyword, row_number() OVER (PARTITION BY a.source_type, b.source_type ORDER BY a.keyword) AS i FROM k a JOIN k b ON a.keyword = b.keyword AND a.source_type < b.source_type) SELECT source_a, source_b, count(*) AS n_shared, string_agg(keyword, '|' ORDER BY keyword) FILTER (i <= 5) AS shared FROM j GROUP BY source_a, source_b")
def source_overlap(spark, d):
    return stats.source_overlap(B.keywords(spark, d)).withColumn("shared", F.array_join("shared", "|"))


@query("trend_section", ("kw",), "SELECT keyword, count(*) AS n, round(avg(score), 6) AS avg_score FROM kw GROUP BY keyword ORDER BY n DESC, keyword LIMIT 10")
def trend_section(spark, d):
    return _rounded(stats.trend_section(B.keywords(spark, d)))


@query("search_keywords", ("kw",), "SELECT doc_id AS document_id, count(DISTINCT keyword) AS matches, round(avg(score), 6) AS avg_score FROM kw WHERE keyword IN ('tion', 'heen', 'anea', 'ciónde', 'tiond') GROUP BY doc_id ORDER BY matches DESC, avg_score DESC, document_id LIMIT 10")
def search_keywords(spark, d):
    return _rounded(search.search_keywords(B.keywords(spark, d), ["tion", "heen", "anea", "ciónde", "tiond"]))


@query("search_all_terms", ("papers",), "SELECT paper_id AS id, title, created_at AS published_date, source_type FROM papers WHERE list_contains(regexp_extract_all(lower(title || ' ' || abstract), '" + _WORD + "'), 'tion') AND list_contains(regexp_extract_all(lower(title || ' ' || abstract), '" + _WORD + "'), 'erst') ORDER BY published_date DESC, id LIMIT 100")
def search_all_terms(spark, d):
    return search.search_all(B.contents(spark, d), "the tion erst").select("id", "title", "published_date", "source_type")


@query("keyword_domains", ("kw", "papers"), ", c AS (SELECT keyword, CASE WHEN lower(title) LIKE '%quantum%' OR lower(abstract) LIKE '%quantum%' THEN 'quantum_computing' WHEN lower(title) LIKE '%machine learning%' OR lower(title) LIKE '%ai%' THEN 'artificial_intelligence' WHEN lower(title) LIKE '%blockchain%' OR lower(title) LIKE '%crypto%' THEN 'blockchain' WHEN lower(title) LIKE '%climate%' OR lower(title) LIKE '%environment%' THEN 'climate_science' WHEN lower(title) LIKE '%bio%' OR lower(title) LIKE '%medical%' THEN 'biotechnology' ELSE 'general' END AS domain FROM kw JOIN papers p ON p.paper_id = kw.doc_id) SELECT keyword, coalesce(string_agg(DISTINCT domain, '|' ORDER BY domain) FILTER (domain <> 'general'), 'general') AS domains FROM c GROUP BY keyword")
def keyword_domains(spark, d):
    p = B.papers(spark, d).select(F.col("paper_id").alias("document_id"), "title", "abstract")
    return search.keyword_domains(B.keywords(spark, d).join(p, "document_id")).withColumn("domains", F.array_join("domains", "|"))


# Trends


@query("keyword_timeline", ("ev",), "SELECT keyword, CAST(ts AS DATE) AS day, count(*) AS n FROM ev GROUP BY ALL")
def keyword_timeline(spark, d):
    return trends.timeline(B.mentions(spark, d))


_SERIES = ", s AS (SELECT keyword, CAST(ts AS DATE) AS day, count(*) AS n, row_number() OVER (PARTITION BY keyword ORDER BY CAST(ts AS DATE)) - 1 AS i FROM ev GROUP BY keyword, CAST(ts AS DATE)), g AS (SELECT keyword, count(*) AS days, sum(n) AS total, avg(n) AS mean, coalesce(regr_slope(n, i), 0) AS slope, coalesce(stddev_samp(n), 0) AS std, max(n) AS top, min(day) AS first_day, min(day) FILTER (n = mx) AS peak_day FROM (SELECT *, max(n) OVER (PARTITION BY keyword) AS mx FROM s) GROUP BY keyword), m AS (SELECT *, CASE WHEN days < 2 THEN 0.0 ELSE slope / greatest(mean, 1.0) END AS v FROM g), f AS (SELECT *, greatest(0.0, least(1.0, 0.4::DOUBLE * abs(v) + 0.3::DOUBLE * (1 - std / greatest(mean, 1.0)) + 0.3::DOUBLE * least(1.0, top / 10))) AS strength FROM m)"


@query("keyword_trends", ("ev",), _SERIES + " SELECT f.keyword, days, CAST(total AS BIGINT) AS total, first_day, peak_day, round(v, 6) AS velocity, round(strength, 6) AS strength, CASE WHEN abs(v) < 0.1 THEN 'stable' WHEN v > 0.1 THEN 'emerging' WHEN v < -0.1 THEN 'declining' WHEN days > 3 AND std * std > 2 * mean THEN 'volatile' ELSE 'stable' END AS trend_type, n_papers FROM f JOIN (SELECT keyword, count(DISTINCT paper_id) AS n_papers FROM ev GROUP BY keyword) p ON p.keyword = f.keyword WHERE days >= 3 AND strength > 0.3")
def keyword_trends(spark, d):
    t = trends.keyword_trends(B.mentions(spark, d)).drop("domains")
    return _rounded(t)


@query("trend_papers", ("ev",), _SERIES + " SELECT DISTINCT ev.keyword, paper_id FROM ev JOIN f ON f.keyword = ev.keyword WHERE days >= 3 AND strength > 0.3")
def trend_papers(spark, d):
    """The papers behind each signal."""
    m = B.mentions(spark, d)
    return trends.trend_papers(trends.keyword_trends(m), m)


_DENSE = ", bd AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS len FROM ev), f AS (SELECT topic, CAST(ts AS DATE) AS day, count(*) AS n FROM ev GROUP BY ALL), z AS (SELECT topic, CAST(lo + CAST(i AS INTEGER) AS DATE) AS day, i FROM (SELECT DISTINCT topic FROM f), (SELECT lo, unnest(range(len)) AS i FROM bd)), dn AS (SELECT z.topic, z.day, z.i, coalesce(f.n, 0) AS n FROM z LEFT JOIN f ON f.topic = z.topic AND f.day = z.day)"


def _days(spark, d) -> tuple:
    """The first and the last day of the events."""
    return tuple(B.mentions(spark, d).agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first())  # two values


@query("topic_timeline_dense", ("ev",), _DENSE + " SELECT topic, day, i, n FROM dn")
def topic_timeline_dense(spark, d):
    return _rounded(trends.dense_timeline(B.mentions(spark, d), *_days(spark, d)))


@query("emerging_topics", ("ev",), _DENSE + ", l AS (SELECT *, lag(n) OVER (PARTITION BY topic ORDER BY i) AS p, avg(n) FILTER (i < len // 3) OVER (PARTITION BY topic) AS tm FROM dn, bd), g AS (SELECT topic, CAST(sum(n) AS BIGINT) AS total, avg(n) FILTER (i < len // 2) AS b, avg(n) FILTER (i >= len // 2) AS r, min(i) FILTER (i >= len // 3 AND n > 1.5 * tm) AS rise, coalesce(avg((n - p) / p) FILTER (p > 0), 0) AS growth, string_agg(n, '|' ORDER BY i) FILTER (i >= len - 7) AS recent_points FROM l GROUP BY topic), e AS (SELECT *, CASE WHEN b = 0 THEN CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END ELSE 1 / (1 + exp(-2 * (r / b - 1))) END AS score FROM g) SELECT topic, round(score, 6) AS emergence_score, CAST(hi - CAST(len - rise AS INTEGER) AS DATE) AS emergence_date, round(growth, 6) AS growth_rate, total, recent_points FROM e, bd WHERE score > 0.5")
def emerging_topics(spark, d):
    t = trends.emerging_topics(B.mentions(spark, d), *_days(spark, d))
    return _rounded(t.withColumn("recent_points", F.array_join(F.col("recent_points").cast("array<string>"), "|")))


@query("cross_domain_trends", ("ev",), _DENSE.replace("topic", "kd").replace("AS n FROM ev GROUP", "AS n FROM (SELECT keyword || '#' || CAST(paper_id % 3 AS VARCHAR) AS kd, ts FROM ev) GROUP") + ", x AS (SELECT split_part(kd, '#', 1) AS keyword, 'd' || split_part(kd, '#', 2) AS domain, i, n FROM dn) SELECT a.keyword, a.domain AS domain_a, b.domain AS domain_b, round(corr(a.n, b.n), 6) AS score, CAST(sum(a.n) + sum(b.n) AS BIGINT) AS total FROM x a JOIN x b ON a.keyword = b.keyword AND a.i = b.i AND a.domain < b.domain GROUP BY ALL HAVING corr(a.n, b.n) > 0.0")
def cross_domain_trends(spark, d):
    m = B.mentions(spark, d).withColumn("domain", F.concat(F.lit("d"), F.pmod("paper_id", F.lit(3)).cast("string")))
    return _rounded(trends.cross_domain_trends(m, *_days(spark, d), 0.0))


@query("new_keywords_by_day", ("ev",), ", x AS (SELECT DISTINCT topic || '_' || (paper_id % 50) AS keyword, CAST(ts AS DATE) AS day FROM ev), r AS (SELECT *, dense_rank() OVER (ORDER BY day DESC) AS k FROM x) SELECT keyword, day FROM r a WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.k = 2 AND b.keyword = a.keyword)")
def new_keywords_by_day(spark, d):
    own = F.concat_ws("_", "topic", F.pmod("paper_id", F.lit(50)).cast("string"))
    return stats.new_keywords(B.mentions(spark, d).select(own.alias("keyword"), "ts"))


@query("trend_report")
def trend_report(spark, d):
    return _rounded(trends.trend_report(B.mentions(spark, d).drop("topic"), "2024-01-30"))


# Correlation


def _elements(spark, d):
    return B.keywords(spark, d).select(F.col("document_id").alias("paper_id"), F.lit("keyword").alias("kind"), F.col("keyword").alias("element"))


def _three_kinds(spark, d):
    """Keywords, the letters that a document's five first keywords begin with as entities, and its source as a topic."""
    k = stored(B.keywords(spark, d), "keywords")
    first = k.where("rank <= 5").select(F.col("document_id").alias("paper_id"), F.lit("entity").alias("kind"), F.left("keyword", F.lit(2)).alias("element")).distinct()
    topic = B.documents(spark, d).select(F.col("document_id").alias("paper_id"), F.lit("topic").alias("kind"), F.concat_ws("_", "source_type", F.pmod("document_id", F.lit(7)).cast("string")).alias("element"))
    own = k.select(F.col("document_id").alias("paper_id"), F.lit("keyword").alias("kind"), F.col("keyword").alias("element"))
    return own.unionByName(first).unionByName(topic)


@query(
    "paper_correlations_of_three_kinds", ("kw",),
    """, k AS (SELECT DISTINCT doc_id, 'keyword' AS kind, lower(keyword) AS e FROM kw UNION SELECT DISTINCT doc_id, 'entity', substr(keyword, 1, 2) FROM kw WHERE rank <= 5 UNION SELECT doc_id, 'topic', source || '_' || (doc_id % 7) FROM documents),
    n AS (SELECT doc_id, kind, count(*) AS n FROM k GROUP BY doc_id, kind), p AS (SELECT a.doc_id AS paper_a, b.doc_id AS paper_b, a.kind, count(*) AS i, list(a.e ORDER BY a.e)[1:10] AS shared FROM k a JOIN k b ON a.kind = b.kind AND a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
    j AS (SELECT p.*, i / (na.n + nb.n - i) AS j FROM p JOIN n na ON na.doc_id = paper_a AND na.kind = p.kind JOIN n nb ON nb.doc_id = paper_b AND nb.kind = p.kind),
    w AS (SELECT paper_a, paper_b, coalesce(max(j) FILTER (kind = 'keyword'), 0) AS jk, coalesce(max(j) FILTER (kind = 'entity'), 0) AS je, coalesce(max(j) FILTER (kind = 'topic'), 0) AS jt FROM j GROUP BY ALL),
    s AS (SELECT *, 0.4::DOUBLE * jk + 0.3::DOUBLE * je + 0.3::DOUBLE * jt AS score, CASE WHEN jk >= je AND jk >= jt THEN 'keyword' WHEN je >= jt THEN 'entity' ELSE 'topic' END AS kind FROM w)
    SELECT s.paper_a, s.paper_b, round(score, 6) AS score, s.kind, coalesce(array_to_string(j.shared, '|'), '') AS shared, round(least(1.0, coalesce(len(j.shared), 0) / 5), 6) AS confidence FROM s LEFT JOIN j ON j.paper_a = s.paper_a AND j.paper_b = s.paper_b AND j.kind = s.kind WHERE score >= 0.3 - 1e-12""",
)
def paper_correlations_of_three_kinds(spark, d):
    return _rounded(correlate.paper_pairs(_three_kinds(spark, d)).withColumn("shared", F.array_join("shared", "|")))


@query("paper_correlations", ("kw",), ", k AS (SELECT DISTINCT doc_id, lower(keyword) AS e FROM kw), n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id), p AS (SELECT a.doc_id AS paper_a, b.doc_id AS paper_b, count(*) AS i, string_agg(a.e, '|' ORDER BY a.e) AS shared FROM k a JOIN k b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL), s AS (SELECT p.*, 0.4::DOUBLE * i / (na.n + nb.n - i) AS score FROM p JOIN n na ON na.doc_id = paper_a JOIN n nb ON nb.doc_id = paper_b) SELECT paper_a, paper_b, round(score, 6) AS score, 'keyword' AS kind, shared, least(1.0, i / 5) AS confidence FROM s WHERE score >= 0.3 - 1e-12")
def paper_correlations(spark, d):
    return _rounded(correlate.paper_pairs(_elements(spark, d)).withColumn("shared", F.array_join("shared", "|")))


@query("top_correlations", sql=ORACLE["paper_correlations_of_three_kinds"] + " ORDER BY round(s.score, 9) DESC, s.paper_a, s.paper_b LIMIT 100")
def top_correlations(spark, d):
    """C1 with its limit."""
    return _rounded(correlate.top_pairs(_three_kinds(spark, d), 100).withColumn("shared", F.array_join("shared", "|")))


@query("top_correlations_of_papers", sql=ORACLE["paper_correlations_of_three_kinds"] + " AND s.paper_a IN (SELECT doc_id FROM labels WHERE quality = 1) AND s.paper_b IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY round(s.score, 9) DESC, s.paper_a, s.paper_b LIMIT 40")
def top_correlations_of_papers(spark, d):
    """C1 with its limit and a list of papers, those labelled good."""
    good = B.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("paper_id"))
    return _rounded(correlate.top_pairs(_three_kinds(spark, d), 40, papers=good).withColumn("shared", F.array_join("shared", "|")))


@query("topic_clusters", ("kw",), ", c AS (SELECT keyword AS cluster, count(*) AS size FROM kw WHERE rank = 1 GROUP BY keyword HAVING count(*) >= 3), m AS (SELECT k.doc_id, c.cluster, c.size FROM kw k JOIN c ON c.cluster = k.keyword WHERE rank = 1), o AS (SELECT m.cluster, m.doc_id, kw.keyword FROM m JOIN kw ON kw.doc_id = m.doc_id), z AS (SELECT cluster, doc_id, count(*) AS k FROM o GROUP BY ALL), j AS (SELECT a.cluster, a.doc_id AS pa, b.doc_id AS pb, count(*) AS i FROM o a JOIN o b ON a.cluster = b.cluster AND a.keyword = b.keyword AND a.doc_id < b.doc_id GROUP BY ALL), t AS (SELECT j.cluster, sum(i / (za.k + zb.k - i)) AS s FROM j JOIN z za ON za.cluster = j.cluster AND za.doc_id = pa JOIN z zb ON zb.cluster = j.cluster AND zb.doc_id = pb GROUP BY j.cluster), cn AS (SELECT cluster, keyword, count(*) AS n FROM o GROUP BY cluster, keyword), ck AS (SELECT cluster, keyword, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, keyword) AS r FROM cn), rt AS (SELECT cluster, keyword, row_number() OVER (PARTITION BY cluster ORDER BY keyword) AS r FROM cn WHERE keyword <> cluster), cs AS (SELECT cluster, string_agg(keyword, '|' ORDER BY r) AS s FROM ck WHERE r <= 10 GROUP BY cluster), rs AS (SELECT cluster, string_agg(keyword, '|' ORDER BY r) AS s FROM rt WHERE r <= 5 GROUP BY cluster) SELECT c.cluster, c.size, cs.s AS central_keywords, round(coalesce(t.s, 0) / (c.size * (c.size - 1) / 2), 6) AS coherence, rs.s AS related_topics FROM c LEFT JOIN t ON t.cluster = c.cluster LEFT JOIN cs ON cs.cluster = c.cluster LEFT JOIN rs ON rs.cluster = c.cluster")
def topic_clusters(spark, d):
    k = stored(B.keywords(spark, d).select(F.col("document_id").alias("paper_id"), "keyword", F.col("keyword").alias("topic"), "rank"), "keywords")
    out = correlate.topic_clusters(k.drop("keyword"), k.select("paper_id", "keyword"))
    return _rounded(out.withColumn("central_keywords", F.array_join("central_keywords", "|")).withColumn("related_topics", F.array_join("related_topics", "|")))


@query("correlation_report")
def correlation_report(spark, d):
    """C10."""
    k = stored(B.keywords(spark, d).select(F.col("document_id").alias("paper_id"), "keyword", F.col("keyword").alias("topic"), "rank"), "keywords")
    return _rounded(correlate.correlation_report(k.select("paper_id", F.lit("keyword").alias("kind"), F.col("keyword").alias("element")), k.drop("keyword"), k.select("paper_id", "keyword")))


@query("research_connections", ("kw",), ", p AS (SELECT DISTINCT doc_id AS paper_id, substr(keyword, 1, 1) AS domain FROM kw), b AS (SELECT x.domain AS domain_a, y.domain AS domain_b, count(*) AS bridges FROM p x JOIN p y ON x.paper_id = y.paper_id AND x.domain < y.domain GROUP BY ALL), s AS (SELECT domain, count(*) AS n FROM p GROUP BY domain) SELECT domain_a, domain_b, bridges, round(bridges / (sa.n + sb.n - bridges), 6) AS strength FROM b JOIN s sa ON sa.domain = domain_a JOIN s sb ON sb.domain = domain_b WHERE bridges >= 2")
def research_connections(spark, d):
    k = B.keywords(spark, d).select(F.col("document_id").alias("paper_id"), "keyword")
    out = correlate.research_connections(k.select("paper_id", F.left("keyword", F.lit(1)).alias("domain")), k)
    return _rounded(out.select("domain_a", "domain_b", "bridges", "strength"))


@query("bridge_papers", ("kw",), ", p AS (SELECT DISTINCT doc_id AS paper_id, substr(keyword, 1, 1) AS domain FROM kw) SELECT x.domain AS domain_a, y.domain AS domain_b, x.paper_id FROM p x JOIN p y ON x.paper_id = y.paper_id AND x.domain < y.domain")
def bridge_papers(spark, d):
    """The papers behind each connection."""
    k = B.keywords(spark, d)
    return correlate.bridge_papers(k.select(F.col("document_id").alias("paper_id"), F.left("keyword", F.lit(1)).alias("domain")))


# Stored tables, reports, pages


@query("unanalyzed", ("papers",), "SELECT paper_id, title, created_at FROM papers p WHERE abstract <> '' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.paper_id) ORDER BY created_at DESC, paper_id LIMIT 50")
def unanalyzed(spark, d):
    done = B.table(spark, d, "labels").select(F.col("doc_id").alias("paper_id"))
    return search.unanalyzed(B.papers(spark, d), done, 50).select("paper_id", "title", "created_at")


@query("report_stats", ("reports",), "SELECT count(*) AS total, count(*) FILTER (score >= 0.8) AS high_quality, count(*) FILTER (score >= 0.5 AND score < 0.8) AS medium_quality, count(*) FILTER (score < 0.5) AS low_quality, round(avg(score), 6) AS avg_score, count(*) FILTER (ts >= TIMESTAMP '2024-02-29' - INTERVAL 30 DAYS) AS recent, CAST(sum(tokens_used) AS BIGINT) AS tokens FROM reports")
def report_stats(spark, d):
    return _rounded(stats.report_stats(B.reports(spark, d), "2024-02-29", 0.8, 0.5))


@query("provider_stats", ("reports",), "SELECT provider, count(*) AS n, round(avg(score), 6) AS avg_score FROM reports GROUP BY provider")
def provider_stats(spark, d):
    return _rounded(stats.provider_stats(B.reports(spark, d)))


@query("quality_bands", ("reports",), "SELECT count(*) AS total, round(avg(score), 6) AS mean, round(max(score), 6) AS max, round(max(score) - min(score), 6) AS \"range\", round(coalesce(stddev_samp(score), 0), 6) AS std, count(*) FILTER (score > 0.8) AS high, count(*) FILTER (score >= 0.5 AND score <= 0.8) AS medium, count(*) FILTER (score < 0.5) AS low, count(*) FILTER (score >= 0.9) AS exceptional, count(*) FILTER (score >= 0.8 AND score < 0.9) AS excellent, count(*) FILTER (score >= 0.6 AND score < 0.8) AS good, count(*) FILTER (score >= 0.4 AND score < 0.6) AS fair, count(*) FILTER (score < 0.4) AS weak, round(count(*) FILTER (score > 0.8) / count(*), 6) AS high_share, round(count(*) FILTER (score >= 0.5 AND score <= 0.8) / count(*), 6) AS medium_share, round(count(*) FILTER (score < 0.5) / count(*), 6) AS low_share, round(count(*) FILTER (len(innovs) > 0) / count(*), 6) AS innovation_rate, round(count(*) FILTER (len(impls) > 0) / count(*), 6) AS implication_rate FROM reports")
def quality_bands(spark, d):
    return _rounded(rubric.quality_bands(B.reports(spark, d)))


@query("intelligence_summary", ("reports",), "SELECT count(*) AS papers, round(avg(score), 6) AS avg_score, CAST(sum(len(contribs)) AS BIGINT) AS contributions, count(*) FILTER (score > 0.8) AS high_quality, count(*) FILTER (len(contribs) >= 2) AS several_contributions FROM reports")
def intelligence_summary(spark, d):
    return _rounded(rubric.intelligence_summary(B.reports(spark, d)))


@query("contribution_trends", ("reports",), ", w AS (SELECT unnest(regexp_split_to_array(lower(x), '\\s+')) AS word FROM (SELECT unnest(contribs) AS x FROM reports)) SELECT word, count(*) AS n FROM w WHERE length(word) > 5 GROUP BY word ORDER BY n DESC, word LIMIT 5")
def contribution_trends(spark, d):
    return rubric.contribution_trends(B.reports(spark, d))


@query("innovation_trends", ("reports",), "SELECT x AS innovation, count(*) AS n, round(count(*) / (SELECT count(*) FROM reports), 6) AS frequency FROM (SELECT unnest(innovs) AS x FROM reports) GROUP BY x ORDER BY n DESC, x LIMIT 5")
def innovation_trends(spark, d):
    return _rounded(rubric.innovation_trends(B.reports(spark, d)))


@query("business_depth", ("reports",), "SELECT round(count(*) FILTER (len(impls) > 0) / count(*), 6) AS rate, round(coalesce(avg(len(impls)) FILTER (score > 0.8), 0), 6) AS mean_high_quality FROM reports")
def business_depth(spark, d):
    return _rounded(rubric.business_depth(B.reports(spark, d)))


@query("recommendation_data", ("reports",), "SELECT round(avg(score), 6) AS avg_score, CASE WHEN avg(score) > 0.8 THEN 'high' WHEN avg(score) > 0.6 THEN 'medium' ELSE 'low' END AS band, round(greatest(0.6, avg(score) - 0.1), 6) AS suggested_threshold FROM reports")
def recommendation_data(spark, d):
    return _rounded(rubric.recommendation_data(B.reports(spark, d)))


@query("pipeline_stats", ("papers",), ", a AS (SELECT l.doc_id, created_at FROM labels l JOIN papers p ON p.paper_id = l.doc_id) SELECT count(*) AS collected, count(*) FILTER (created_at >= TIMESTAMP '2024-02-29' - INTERVAL 24 HOURS) AS collected_24h, max(created_at) AS last_collected, count(DISTINCT source_type) AS sources, (SELECT count(*) FROM a) AS analyzed, (SELECT count(*) FROM a WHERE created_at >= TIMESTAMP '2024-02-29' - INTERVAL 24 HOURS) AS analyzed_24h, (SELECT max(created_at) FROM a) AS last_analyzed, round((SELECT count(*) FROM a) * 100 / count(*), 2) AS coverage FROM papers")
def pipeline_stats(spark, d):
    c = B.contents(spark, d)
    a = B.table(spark, d, "labels").select(F.col("doc_id").alias("id")).join(c, "id").select("id", F.col("collected_at").alias("analyzed_at"))
    return stats.pipeline_stats(c, a, "2024-02-29")


@query("source_counts", (), "SELECT source AS source_type, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def source_counts(spark, d):
    return _rounded(stats.source_counts(B.contents(spark, d)))


@query("executive_summary", ("papers",), "SELECT count(*) AS contents, count(DISTINCT source_type) AS sources, round(avg(length(abstract)), 6) AS avg_length, date_diff('day', min(created_at), max(created_at)) AS span_days, (SELECT count(*) FROM labels) AS analyses, round((SELECT count(*) FROM labels) * 100 / count(*), 6) AS coverage FROM papers")
def executive_summary(spark, d):
    return _rounded(stats.executive_summary(B.contents(spark, d), B.table(spark, d, "labels")))


@query("host_stats", (), r"SELECT regexp_extract(url, '^\w+://([^/?#:]+)', 1) AS host, count(*) AS n, count(*) FILTER (html NOT LIKE '%</html>%') AS failed FROM pages GROUP BY ALL")
def host_stats(spark, d):
    return stats.host_stats(B.table(spark, d, "pages").select("url", F.contains("html", F.lit("</html>")).alias("success")))


def _pattern(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _page_sql() -> str:
    """Page fields from tokens: tags of one name are paired by their depth, in windows, and noise is blanked by its places."""
    bare = "coalesce(html, '')"
    for raw in ("<!--.*?-->", *(rf"(?i)<{n}\b.*?</{n}\s*>" for n in ("script", "style", "noscript"))):
        bare = f"regexp_replace({bare}, '{raw}', ' ', 'gs')"
    decoded = "x"
    for name, value in [(n, v) for n, v in enrich._ENTITIES.items() if n != "&amp;"] + [("&amp;", "&")]:
        decoded = f"replace({decoded}, '{name}', {_pattern(value)})"
    decoded = f"trim(regexp_replace({decoded}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
    text = lambda toks, a, b: decoded.replace("(x,", f"(array_to_string(list_transform({toks}[{a}:{b}], lambda y: CASE WHEN y[1] = '<' THEN ' ' ELSE y END), ''),", 1)
    ones = enrich.TITLE + enrich.AUTHOR + enrich.DATE
    first = ", ".join(f"arg_min(whole, i) FILTER (regexp_matches(t, {_pattern(p)})) AS one{k}" for k, p in enumerate(ones))
    best = ", ".join(f"arg_max(kept, length(kept) * 1000000 - i) FILTER (regexp_matches(t, {_pattern(p)})) AS long{k}" for k, p in enumerate(enrich.CONTENT))
    meta = lambda p: f"nullif(trim(regexp_extract(head, {_pattern(p)}, 1)), '')"
    m = enrich._meta
    one = [f"nullif(one{k}, '')" for k in range(len(ones))]
    a, b = len(enrich.TITLE), len(enrich.TITLE) + len(enrich.AUTHOR)
    over = lambda x: f"CASE WHEN length({x}) > 5 THEN {x} END"
    title = ", ".join(over(x) for x in (*one[:a], meta(m("property", "og:title")), meta(m("name", "twitter:title"))))
    author = ", ".join((*one[a : a + 3], meta(m("property", "article:author")), meta(m("name", "author")), *one[a + 3 : b]))
    date = ", ".join((meta(m("property", "article:published_time")), meta(m("property", "datePublished")), meta(r'(?is)<time[^>]*datetime="([^"]*)"'), *one[b:]))
    told = ", ".join(meta(m(k, v)) for k, v in (("name", "description"), ("property", "og:description"), ("name", "twitter:description")))
    content = ", ".join(f"CASE WHEN length(long{k}) > 100 THEN long{k} END" for k in range(len(enrich.CONTENT)))
    names = lambda found: ", ".join(f"'{n}'" for n in sorted(found))
    clean = rf"trim(regexp_replace(regexp_replace(regexp_replace(content, '\s+', ' ', 'g'), '(?i)({K.WEB_BOILERPLATE})', '', 'g'), '(?i)({K.WEB_NAVIGATION})', '', 'g'))"
    return rf"""WITH bare AS (SELECT page_id, url, {bare} AS h FROM pages), tok AS (SELECT page_id, url, array_to_string(regexp_extract_all(h, '(?i)<(?:meta|time)\b[^>]*>'), '') AS head, regexp_extract_all(h, '<[^>]*>|[^<]+') AS toks FROM bare),
    tg AS (SELECT page_id, i, t, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, t[2] = '/' AS closing FROM (SELECT page_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM tok) WHERE t[1] = '<'),
    lv AS (SELECT *, sum(CASE WHEN closing THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY i) + closing::INT AS level FROM tg WHERE name <> '' AND name NOT IN ({names(enrich.VOID)}) AND NOT ends_with(t, '/>')),
    el AS (SELECT *, lead(i) OVER (PARTITION BY page_id, name, level ORDER BY i) AS stop FROM lv), iv AS (SELECT page_id, list(struct_pack(a := i, b := stop)) AS iv FROM el WHERE NOT closing AND name IN ({names(enrich.NO_TEXT)}) GROUP BY page_id),
    kt AS (SELECT tok.page_id, url, head, toks, list_transform(toks, lambda y, k: CASE WHEN len(list_filter(iv, lambda v: k >= v.a AND (v.b IS NULL OR k < v.b))) > 0 THEN '<' ELSE y END) AS kts FROM tok LEFT JOIN iv ON iv.page_id = tok.page_id),
    ex AS (SELECT el.page_id, i, t, {text("toks", "i + 1", "coalesce(stop - 1, len(toks))")} AS whole, {text("kts", "i + 1", "coalesce(stop - 1, len(toks))")} AS kept, name FROM el JOIN kt ON kt.page_id = el.page_id WHERE NOT closing AND (name IN ('h1', 'title', 'article', 'main', 'body') OR regexp_matches(t, '(?i)\s(class|role|id|rel)='))),
    fd AS (SELECT page_id, {first}, {best}, arg_min(kept, i) FILTER (name = 'body') AS body FROM ex GROUP BY page_id),
    pf AS (SELECT kt.page_id, url, coalesce({title}) AS title, coalesce({author}) AS author, coalesce({date}) AS day, coalesce({told}) AS description, coalesce({content}, body, {text("kts", "1", "len(kts)")}) AS content FROM kt LEFT JOIN fd ON fd.page_id = kt.page_id),
    fields AS (SELECT page_id, url, title, author, CAST(coalesce(try_strptime(day, '%Y-%m-%dT%H:%M:%S%z'), try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%Y-%m-%dT%H:%M:%S')) AS TIMESTAMP) AS published_date, description, content, {clean} AS clean_text FROM pf)"""


_PAGE_SQL = _page_sql()


@query("page_fields", sql=_PAGE_SQL + " SELECT * EXCLUDE (page_id), len(list_filter(string_split(clean_text, ' '), lambda w: w <> '')) AS word_count FROM fields")
def page_fields(spark, d):
    """E4-E7, X4."""
    return _rounded(enrich.page_fields(B.table(spark, d, "pages")))


@query("enrichment_stats", sql=_PAGE_SQL + """, u AS (SELECT url, max(clean_text) AS clean_text FROM fields GROUP BY url), e AS (SELECT length(clean_text) > 200 AS ok, CASE WHEN ends_with(lower(url), '.pdf') THEN 'pdf_extract' ELSE 'web_scrape' END AS kind, (length(html) + 28 + length(clean_text)) / length(html) AS ratio FROM pages JOIN u USING (url))
    SELECT count(*) AS total, count(*) FILTER (ok AND kind = 'pdf_extract') AS pdf_success, count(*) FILTER (ok AND kind = 'web_scrape') AS web_success, count(*) FILTER (NOT ok) AS failures, round(coalesce(avg(ratio) FILTER (ok), 1.0), 6) AS avg_ratio, round(coalesce(max(ratio) FILTER (ok), 1.0), 6) AS max_ratio, round(avg(ok::DOUBLE), 6) AS success_rate FROM e""")
def enrichment_stats(spark, d):
    """Pages with over 200 code points of text are successes."""
    p = B.table(spark, d, "pages")
    fields = enrich.page_fields(p).groupBy("url").agg(F.max("clean_text").alias("clean_text")).withColumn("success", F.char_length("clean_text") > 200)
    c = p.select(F.col("page_id").alias("id"), "url", F.lit("web").alias("source_type"), F.col("html").alias("content"))
    return _rounded(stats.enrichment_stats(enrich.merge_pages(c, fields)))


# Comments, merges, logs

_TERMS = ["tion", "heen", "anea"]


@query("comment_filter", (), r"SELECT conv_id, turn FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) >= 10 AND (contains(lower(text), 'tion') OR contains(lower(text), 'heen') OR contains(lower(text), 'anea'))")
def comment_filter(spark, d):
    return search.comments(B.table(spark, d, "conversations"), _TERMS, []).select("conv_id", "turn")


@query("per_story_cap", (), "SELECT conv_id, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rank FROM conversations) WHERE rank <= 2")
def per_story_cap(spark, d):
    return _rounded(stats.top_per_group(B.table(spark, d, "conversations"), ["conv_id"], [F.asc("turn"), F.asc("role"), F.asc("text")], 2).select("conv_id", "turn", "rank"))


@query("latest_wins", (), "SELECT user_id, arg_max(event_type, event_id) AS event_type, round(arg_max(value, event_id), 6) AS value, max(event_id) AS seq, arg_min(CAST(ts AS TIMESTAMP), event_id) AS created_at FROM events GROUP BY user_id")
def latest_wins(spark, d):
    e = B.table(spark, d, "events").select("user_id", "event_type", "value", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("created_at"))
    half = F.pmod("seq", F.lit(2)) == 0
    return _rounded(sinks.latest_wins(e.where(half), e.where(~half), ["user_id"], ["created_at"]))


@query("task_history", (), "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 5")
def task_history(spark, d):
    return _rounded(stats.top_per_group(B.table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "rank"))


@query("job_status", (), "SELECT event_type AS status, count(*) AS n, round(avg(value), 6) AS avg_seconds FROM events GROUP BY event_type")
def job_status(spark, d):
    return stats.job_status(B.table(spark, d, "events").select(F.col("event_type").alias("status"), F.col("value").alias("duration_seconds")))


@query("model_comparison", (), "SELECT model, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(value), 6) AS avg_seconds, CAST(sum(user_id) AS BIGINT) AS tokens, round(avg(value / 2), 6) AS avg_score, max(value > 10) AS structured, rank() OVER (ORDER BY avg(value / 2) DESC) AS rank FROM (SELECT event_type AS model, value, user_id FROM events) GROUP BY model")
def model_comparison(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_type").alias("model"), (F.col("value") > 10).alias("success"), F.col("value").alias("seconds"), F.col("user_id").alias("tokens_used"), (F.col("value") / 2).alias("score"), (F.col("value") > 10).alias("structured"))
    return _rounded(stats.model_comparison(e))


@query("usage_stats", (), "SELECT count(*) AS requests, CAST(sum(user_id) AS BIGINT) AS tokens, count(*) FILTER (NOT value > 10) AS failures, round(count(*) FILTER (value > 10) / greatest(count(*), 1), 6) AS success_rate FROM events")
def usage_stats(spark, d):
    return _rounded(stats.usage_stats(B.table(spark, d, "events").select((F.col("value") > 10).alias("success"), F.col("user_id").alias("tokens_used"))))


@query("failure_tally", (), "SELECT event_type AS failure_type, count(*) AS n, max(CAST(ts AS TIMESTAMP)) AS last_at FROM events WHERE value <= 10 GROUP BY event_type")
def failure_tally(spark, d):
    return stats.failure_tally(B.table(spark, d, "events").where("value <= 10").select(F.col("event_type").alias("failure_type"), F.col("ts").cast("timestamp_ntz").alias("ts")))


@query("rubric_parse", (), "SELECT doc_id AS response_id, quality * 8 + 1.5 AS research_quality_score, 'c' || doc_id AS contribution FROM labels")
def rubric_parse(spark, d):
    body = F.concat(F.lit('Sure.\n```json\n{"research_quality_score": '), (F.col("quality") * 8 + 1.5).cast("string"), F.lit(' (Paper 1), "novel_contributions": ["c'), F.col("doc_id").cast("string"), F.lit('"],}\n```\nDone.'))
    r = rubric.parse_responses(B.table(spark, d, "labels").select(F.col("doc_id").alias("response_id"), body.alias("raw_response")))
    return r.select("response_id", "research_quality_score", F.get("novel_contributions", F.lit(0)).alias("contribution"))


# Synthesis

_DOMAINS = {"first": ["tion", "heen"], "second": ["anea", "ciónde", "ation"], "third": ["einung", "lich"]}


@query("domain_classify", ("papers",), ", t AS (SELECT paper_id, lower(title || ' ' || abstract) AS x FROM papers), s AS (SELECT paper_id, contains(x, 'tion')::INT + contains(x, 'heen')::INT AS a, contains(x, 'anea')::INT + contains(x, 'ciónde')::INT + contains(x, 'ation')::INT AS b, contains(x, 'einung')::INT + contains(x, 'lich')::INT AS c FROM t) SELECT paper_id, CASE WHEN greatest(a, b, c) = 0 THEN 'general_ai' WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS domain FROM s")
def domain_classify(spark, d):
    return synthesis.classify(B.papers(spark, d), _DOMAINS).select("paper_id", "domain")


@query("collaboration", ("papers",), ", a AS (SELECT author, count(*) AS n FROM (SELECT author_a AS author FROM papers UNION ALL SELECT author_b FROM papers) GROUP BY author), p AS (SELECT author, row_number() OVER (ORDER BY author) AS k FROM a WHERE n > 1) SELECT count(*) FILTER (n > 1) AS prolific, (SELECT string_agg(author, '|' ORDER BY author) FROM p WHERE k <= 5) AS researchers, round(count(*) / sum(n), 6) AS diversity FROM a")
def collaboration(spark, d):
    return _rounded(synthesis.collaboration(B.papers(spark, d)).withColumn("researchers", F.array_join("researchers", "|")))


def _synthesis_papers(spark, d):
    r = B.reports(spark, d).select(F.col("document_id").alias("paper_id"), F.col("technical_innovations").alias("innovations"), F.col("business_implications").alias("implications"))
    return B.papers(spark, d).join(r, "paper_id", "left")


@query("convergence", ("reports",), r", m AS (SELECT provider AS domain, unnest(innovs) AS x FROM reports), b AS (SELECT domain FROM m GROUP BY domain HAVING count(*) > 2), w AS (SELECT domain, word, count(*) AS n FROM (SELECT m.domain, unnest(regexp_split_to_array(lower(x), '\s+')) AS word FROM m JOIN b ON b.domain = m.domain) WHERE word <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY word) AS k FROM w WHERE n > 1 AND length(word) > 3) SELECT w.domain, (SELECT string_agg(word, '|' ORDER BY word) FROM r WHERE r.domain = w.domain AND k <= 5) AS common_elements, round(count(*) FILTER (n > 1 AND length(word) > 3) / count(*), 6) AS strength FROM w GROUP BY w.domain HAVING count(*) FILTER (n > 1 AND length(word) > 3) > 0")
def convergence(spark, d):
    p = _synthesis_papers(spark, d).withColumn("domain", F.col("source_type"))
    return _rounded(synthesis.convergence(p).withColumn("common_elements", F.array_join("common_elements", "|")))


@query("synthesis", ())
def synthesize(spark, d):
    return _rounded(synthesis.synthesize(_synthesis_papers(spark, d)))


@query("content_rows", ("papers",), "SELECT source_type || '_' || paper_id || '_' || CAST(epoch(created_at) AS BIGINT) AS id, title, abstract AS content FROM papers WHERE length(trim(abstract)) >= 10")
def content_rows(spark, d):
    p = B.papers(spark, d)
    landed = p.select("source_type", F.col("paper_id").cast("string").alias("source_id"), F.col("created_at").alias("collected_at"), F.create_map(F.lit("title"), "title", F.lit("abstract"), "abstract").alias("data"))
    return normalize.content_rows(landed).select("id", "title", "content")


@query("summaries_by_length", ("papers",), "SELECT paper_id, CASE WHEN length(abstract) <= 200 THEN abstract WHEN strpos(reverse(substr(abstract, 1, 200)), '.') > 0 AND 200 - strpos(reverse(substr(abstract, 1, 200)), '.') > 100 THEN substr(abstract, 1, 201 - strpos(reverse(substr(abstract, 1, 200)), '.')) ELSE substr(abstract, 1, 200) || '...' END AS summary FROM papers")
def summaries_by_length(spark, d):
    return B.papers(spark, d).select("paper_id", S.summary("abstract").alias("summary"))


@query("analysis_report")
def analysis_report(spark, d):
    k = stored(B.keywords(spark, d), "keywords")
    paper = F.col("document_id").alias("paper_id")
    elements = k.select(paper, F.lit("keyword").alias("kind"), F.col("keyword").alias("element"))
    return _rounded(pages.analysis_report(B.mentions(spark, d), elements, k.select(paper, F.col("keyword").alias("topic"), "rank"), k, "2024-01-30"))


@query("statistics_page")
def statistics_page(spark, d):
    docs = B.documents(spark, d)
    a = analysis.counts(docs).join(analysis.readability(docs), "document_id").join(analysis.sentiment(docs), "document_id").withColumnRenamed("document_id", "paper_id").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    return _rounded(pages.statistics_page(a, B.keywords(spark, d), entities(spark, d)))


@query(
    "batch_rollup", (),
    "WITH w AS (SELECT DISTINCT event_type AS t, 'u' || (user_id % 20) AS k FROM events), r AS (SELECT t, k, row_number() OVER (PARTITION BY t ORDER BY k) AS i FROM w), l AS (SELECT t, string_agg(k, '|' ORDER BY k) AS s FROM r WHERE i <= 10 GROUP BY t) SELECT event_type AS task_type, count(*) AS tasks, CAST(sum(user_id) AS BIGINT) AS results, round(sum(value), 4) AS seconds, any_value(l.s) AS top_keywords FROM events JOIN l ON l.t = event_type GROUP BY event_type",
)
def batch_rollup(spark, d):
    e = B.table(spark, d, "events").select(F.col("event_type").alias("task_type"), F.col("user_id").alias("results_count"), F.col("value").alias("duration_seconds"), F.array(F.concat(F.lit("u"), F.pmod("user_id", F.lit(20)).cast("string"))).alias("keywords"))
    return _rounded(stats.batch_rollup(e).withColumn("top_keywords", F.array_join("top_keywords", "|")), 4)


@query("category_counts", (), "SELECT unnest([lang, source]) AS category, count(*) AS n FROM documents GROUP BY category")
def category_counts(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("collected_date"), F.array("lang", "source").alias("categories"))
    return stats.category_counts(docs, None)


@query("dashboard", (), "WITH n AS (SELECT lang, source FROM documents ORDER BY doc_id DESC LIMIT 20) SELECT 'source' AS section, source AS name, count(*) AS n FROM n GROUP BY source UNION ALL SELECT 'category', lang, count(*) FROM n GROUP BY lang")
def dashboard(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_type"), F.col("doc_id").alias("collected_date"), F.array("lang").alias("categories"))
    return stats.dashboard(docs)
