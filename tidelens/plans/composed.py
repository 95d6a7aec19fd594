"""SQL of the registered queries that compose others: their SQL composes the others' SQL."""

from __future__ import annotations

from .. import terms as K
from .queries import ORACLE, _SERIES, _with


def _of(name: str) -> str:
    return f"({ORACLE[name]})"


def _emerging(key: str, first: str, days: int) -> str:
    """(name, score) of the topics whose dense series of so many days emerges."""
    half = days // 2
    return f"""(WITH e AS (SELECT {key} AS k, CAST(ts AS DATE) AS day, count(*) AS n FROM ev WHERE CAST(ts AS DATE) BETWEEN DATE '{first}' AND DATE '{first}' + {days - 1} GROUP BY ALL), z AS (SELECT k, i, CAST(DATE '{first}' + CAST(i AS INTEGER) AS DATE) AS day FROM (SELECT DISTINCT k FROM e), range({days}) r(i)),
    d AS (SELECT z.k, z.i, coalesce(e.n, 0) AS n FROM z LEFT JOIN e ON e.k = z.k AND e.day = z.day), g AS (SELECT k, avg(n) FILTER (i < {half}) AS b, avg(n) FILTER (i >= {half}) AS r FROM d GROUP BY k)
    SELECT k AS name, CASE WHEN b = 0 THEN CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1 / (1 + exp(-2 * (r / b - 1))) END AS score FROM g)"""


_RECENT = _SERIES.replace("FROM ev GROUP BY keyword, CAST(ts AS DATE)", "FROM ev WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 30 DAYS GROUP BY keyword, CAST(ts AS DATE)")
_STRONG = "(SELECT keyword AS name, strength AS score FROM f WHERE days >= 3 AND strength > 0.3)"

ORACLE["trend_report"] = (
    _with("ev") + _RECENT + f""", a AS (SELECT 'keyword_trend' AS section, name, score FROM {_STRONG} UNION ALL SELECT 'emerging_topic', name, score FROM {_emerging("keyword", "2023-11-01", 91)} WHERE score > 0.5),
    r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, name) AS rank FROM a) SELECT section, name, round(score, 6) AS score, rank FROM r WHERE rank <= 5"""
)

ORACLE["statistics_page"] = f"""SELECT * FROM (SELECT 'summary' AS section, unnest(['total', 'papers', 'avg_words']) AS name, round(unnest([count(*)::DOUBLE, count(DISTINCT document_id)::DOUBLE, avg(word_count)::DOUBLE]), 6) AS value FROM {_of("word_sentence_counts")})
UNION ALL SELECT * FROM (SELECT 'keyword', keyword, document_count::DOUBLE FROM {_of("top_keywords")} ORDER BY document_count DESC, avg_score DESC, keyword LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'entity', entity_text, document_count::DOUBLE FROM {_of("top_entities")} ORDER BY document_count DESC, entity_text, entity_type LIMIT 10)
UNION ALL SELECT 'sentiment_share', unnest(['positive', 'negative', 'neutral']), round(unnest([positive_count * 100.0::DOUBLE / total, negative_count * 100.0::DOUBLE / total, neutral_count * 100.0::DOUBLE / total]), 6) FROM {_of("sentiment_distribution")}"""

ORACLE["analysis_report"] = (
    _with("ev") + _RECENT + f""" SELECT * FROM (SELECT 'keyword_trend' AS section, name, round(score, 6) AS value FROM {_STRONG} ORDER BY score DESC, name LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'emerging_topic', name, round(score, 6) FROM {_emerging("topic", "2023-11-01", 91)} WHERE score > 0.5 ORDER BY score DESC, name LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'pair', paper_a || '-' || paper_b AS name, score FROM {_of("paper_correlations")} ORDER BY score DESC, name LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'cluster', cluster, coherence FROM {_of("topic_clusters")} ORDER BY coherence DESC, cluster LIMIT 3)
    UNION ALL SELECT * FROM (SELECT 'keyword', keyword, document_count::DOUBLE FROM {_of("top_keywords")} ORDER BY document_count DESC, avg_score DESC, keyword LIMIT 15)"""
)

_ENTITIES = " UNION ALL ".join(f"SELECT doc_id AS document_id, '{kind}' AS kind, list_sort(list_distinct(regexp_extract_all(text, '(?i){p}', 1)))[1:5] AS own FROM documents" for kind, p in K.ENTITY_PATTERNS.items())

ORACLE["full_analysis"] = f"""WITH e AS ({_ENTITIES}) SELECT c.document_id, c.word_count, c.sentence_count, f.readability, s.summary, coalesce(k.keywords, '') AS keywords, coalesce(t.topics, '') AS topics, coalesce(n.entities, '') AS entities, m.polarity, m.subjectivity, m.sentiment_label, x.positive_sentences, x.negative_sentences
FROM {_of("word_sentence_counts")} c JOIN {_of("flesch")} f ON f.document_id = c.document_id LEFT JOIN {_of("summary_sentences")} s ON s.document_id = c.document_id
LEFT JOIN (SELECT document_id, string_agg(term, '|' ORDER BY rank) AS keywords FROM {_of("hybrid_keywords")} GROUP BY document_id) k ON k.document_id = c.document_id
LEFT JOIN (SELECT document_id, string_agg(topic, '|' ORDER BY rank) AS topics FROM {_of("topics")} GROUP BY document_id) t ON t.document_id = c.document_id
LEFT JOIN (SELECT document_id, string_agg(kind || ':' || array_to_string(own, ','), '|' ORDER BY kind) AS entities FROM e WHERE len(own) > 0 GROUP BY document_id) n ON n.document_id = c.document_id
LEFT JOIN {_of("sentiment")} m ON m.document_id = c.document_id LEFT JOIN {_of("sentence_sentiment")} x ON x.document_id = c.document_id"""

ORACLE["correlation_report"] = f"""SELECT * FROM (SELECT 'pair' AS section, paper_a || '-' || paper_b AS name, score FROM {_of("paper_correlations")} ORDER BY score DESC, name LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'cluster', cluster, coherence FROM {_of("topic_clusters")} ORDER BY coherence DESC, cluster LIMIT 3)"""


def _held(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _families(families: dict[str, list[str]], kind: str, extra: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, '{kind}' AS kind, count(*) FILTER ({_held(f'x || {extra}', own)}) AS mentions FROM sp" for name, own in families.items())


_TERMS = "list_concat(list_filter(list_concat(list_concat(regexp_extract_all(t, '{0}', 1), regexp_extract_all(t, '{0}', 2)), list_concat(regexp_extract_all(t, '{2}', 1), regexp_extract_all(t, '{2}', 2))), lambda w: length(w) > 2), regexp_extract_all(t, '{1}', 1))".format(*K.TECHNICAL_PATTERNS)
_SCORES = "[" + ", ".join(" + ".join(f"contains(x, '{w}')::INT" for w in own) for own in K.PAPER_DOMAINS.values()) + "]"
_NAMES = "[" + ", ".join(f"'{n}'" for n in K.PAPER_DOMAINS) + "]"

ORACLE["synthesis"] = (
    _with("papers", "reports") + f""", sp AS (SELECT paper_id, lower(title || ' ' || abstract) AS x, innovs, ' ' || coalesce(array_to_string(innovs, ' '), '') AS more_i, ' ' || coalesce(array_to_string(impls, ' '), '') AS more_b FROM papers LEFT JOIN reports ON document_id = paper_id),
    sc AS (SELECT paper_id, innovs, {_SCORES} AS s FROM sp), dm AS (SELECT paper_id, innovs, CASE WHEN list_max(s) = 0 THEN 'general_ai' ELSE ({_NAMES})[list_position(s, list_max(s))] END AS domain FROM sc),
    tt AS (SELECT unnest(list_distinct({_TERMS})) AS name FROM (SELECT lower(unnest(innovs)) AS t FROM sp)), f AS (SELECT name, 'technical' AS kind, count(*) AS mentions FROM tt GROUP BY name UNION ALL {_families(K.METHOD_FAMILIES, "methodological", "more_i")} UNION ALL {_families(K.APPLICATION_FAMILIES, "application", "more_b")}),
    tr AS (SELECT kind, name, least(mentions / (SELECT count(*) FROM sp), 1.0::DOUBLE) AS c FROM f WHERE mentions >= 3 AND mentions / (SELECT count(*) FROM sp) >= 0.6), t AS (SELECT count(*) AS trends, avg(c) AS mean, coalesce(stddev_samp(c), 0) AS std, arg_max(name, c) AS top_trend, coalesce(bool_or(kind = 'methodological'), false) AS any_method FROM tr),
    p AS (SELECT count(*) AS papers, count(DISTINCT domain) AS domains, avg(CASE WHEN innovs IS NULL THEN 0.0 ELSE 1.0 END) AS analyzed FROM dm), d AS (SELECT domain AS dominant_domain FROM dm GROUP BY domain ORDER BY count(*) DESC, domain DESC LIMIT 1)
    SELECT papers, trends, domains, round((least(papers / 20, 1.0) + least(trends / 10, 1.0) + least(domains / 5, 1.0) + analyzed) / 4, 6) AS quality, round(greatest(0.0::DOUBLE, mean - 1.96 * std), 6) AS confidence_low, round(least(1.0::DOUBLE, mean + 1.96 * std), 6) AS confidence_high,
    papers < 10 AS small_sample, analyzed < 0.8 AS incomplete, domains <= 1 AS single_domain, papers < 20 AS expand_sample, top_trend, dominant_domain, any_method FROM p, t, d WHERE papers >= 5"""
)
