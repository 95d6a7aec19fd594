"""DuckDB SQL of the training-data operators that SQL can express."""

from __future__ import annotations

from .quality_rules import POLICIES, RULES, mask
from .secret_scan import BASE
from .secret_scan import RULES as SECRETS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secret_scan() -> str:
    """Starts are the lengths of the parts between matches and of the matches before."""
    size = "coalesce(list_sum(list_transform({0}, lambda s: length(s))), 0)"
    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(SECRETS):
        p = _quoted(pattern)
        start = f"{size.format('p[1:j]')} + {size.format('m[1:j - 1]')}"
        kinds.append(f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(m) AS x, unnest(list_transform(range(1, len(m) + 1), lambda j: {start})) AS place, {p} AS pattern, {group} AS g, {least} AS least FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {p}) AS m, string_split_regex(coalesce(text, ''), {p}) AS p FROM documents)")
    value = "CASE " + " ".join(f"WHEN kind = '{k}' THEN regexp_extract(x, {_quoted(p)}, {g})" for k, p, g, _ in SECRETS) + " END"
    joined = "coalesce(string_agg(kind || ':' || CAST(place AS BIGINT) || ':' || CAST(place + length(x) AS BIGINT), ',' ORDER BY place, rank){0}, '')"
    base = " FILTER (kind IN (" + ", ".join(f"'{k}'" for k in BASE) + "))"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    return f"WITH s AS ({' UNION ALL '.join(kinds)}), f AS (SELECT * FROM s WHERE length({value}) >= least) SELECT d.doc_id, {counts}, sha256({joined.format(base)}) AS base_sha256, {joined.format('')} AS spans FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"


def quality_rules(policy: str = "v1") -> str:
    bits = " | ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES))
    own, base = mask(POLICIES[policy]), mask(POLICIES["base"])
    return rf"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS l FROM documents), p AS (SELECT doc_id, i, array_to_string(l[i:i + 7], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 6)) AS i FROM w)),
    again AS (SELECT doc_id, g FROM p GROUP BY doc_id, g HAVING count(*) > 1), r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT p.doc_id, unnest(range(i, i + 8)) AS k FROM p JOIN again ON again.doc_id = p.doc_id AND again.g = p.g) GROUP BY doc_id),
    ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    s AS (SELECT w.doc_id, len(l) AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(ln.n, 0) AS n_lines, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(l, lambda x: len(regexp_extract_all(x, '[A-Z]')) >= 2 AND NOT regexp_matches(x, '[a-z]'))) AS n_upper_words, len(list_filter(l, lambda x: ends_with(x, '!'))) AS n_exclaimed, len(list_distinct(list_transform(l, lambda x: translate(x, '{_UPPER}', '{_LOWER}')))) AS n_distinct_words
    FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN ln ON ln.doc_id = w.doc_id), b AS (SELECT *, {bits} AS failed FROM s)
    SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {base} <> 0 AS base_failed, failed & {own | base} = 0 AS kept, CAST(failed AS BIGINT) AS failed_bits, CAST(CASE WHEN bit_count(failed & {own}) = 1 THEN failed & {own} ELSE 0 END AS BIGINT) AS ablation_bit FROM b"""


def quality_ablations(policy: str = "v1") -> str:
    own = mask(POLICIES[policy])
    parts = [f"SELECT '{rule}' AS rule, CAST(count(*) FILTER (failed_bits & {mask([rule])} <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failed_bits & {own} = {mask([rule])}) AS BIGINT) AS n_only, CAST(count(*) FILTER (failed_bits & {own} & ~{mask([rule])} = 0) AS BIGINT) AS n_kept_without FROM q" for rule in POLICIES[policy]]
    return f"WITH q AS ({quality_rules(policy)}) " + " UNION ALL ".join(parts)


def jaccard_join(shingle: int = 5, per_cent: int = 75) -> str:
    """Components by the closure of the links."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS l FROM documents),
    d AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < {shingle} THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - {shingle - 2}), lambda i: array_to_string(l[i:i + {shingle - 1}], ' ')) END) AS s FROM w), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM d a JOIN d b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id), l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {per_cent} * (x.n + y.n - i)),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
    SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM m LEFT JOIN n ON n.doc_id = m.doc_id"""


def repeated_bytes() -> str:
    """Strings of 100 bytes as 200 hexadecimal digits; removed runs are islands of their covered starts, and what lies between them stays."""
    return """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM t WHERE length(h) >= 200)),
    f AS (SELECT s, min({'d': doc_id, 'i': i}) AS first FROM p GROUP BY s HAVING count(*) > 1), c AS (SELECT p.doc_id, p.i FROM p JOIN f ON f.s = p.s WHERE f.first.d < p.doc_id OR (f.first.d = p.doc_id AND f.first.i < p.i)),
    g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS begins FROM c), r AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
    n AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id), k AS (SELECT doc_id, b AS lo, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS hi FROM (SELECT * FROM r UNION ALL SELECT doc_id, -1, 0 FROM t)),
    e AS (SELECT t.doc_id, string_agg(substr(h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * (coalesce(hi, length(h) // 2) - lo) AS BIGINT)), '' ORDER BY lo) AS kept FROM t JOIN k ON k.doc_id = t.doc_id GROUP BY t.doc_id)
    SELECT t.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN e ON e.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id"""


def source_audit(least: int = 30, ranks: int = 50) -> str:
    """Shares of every kept term in every group, in wide integers; absent terms count 0."""
    share = "CAST(1 + 1000000000::HUGEINT * ({0} + 5) // ({1} + 5 * {2}) AS BIGINT)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {least}), l AS (SELECT lang, count(*) AS v, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY lang),
    c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL), g AS (SELECT DISTINCT lang, source FROM d), t AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share.format("coalesce(c.n, 0)", "coalesce(t.total, 0)", "l.v")} AS p, {share.format("k.n", "l.total", "l.v")} AS q FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {ranks}"""


def vector_codes(entries: int = 256, rounds: int = 4, parts: int = 4) -> str:
    """Every part against every entry, round by round. Vectors have one length; vec_ids are unique."""
    nearest = "(SELECT vec_id, part, min({{'d': d, 'entry': entry}}) AS m FROM (SELECT x.vec_id, x.part, c.entry, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d FROM x JOIN c{0} c ON c.part = x.part AND c.j = x.j GROUP BY ALL) GROUP BY ALL)"
    steps = [
        f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.j, coalesce(s.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT n.part, n.m.entry AS entry, x.j, CAST(floor(CAST(sum(x.x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM {nearest.format(k)} n JOIN x ON x.vec_id = n.vec_id AND x.part = n.part GROUP BY ALL) s ON s.part = c.part AND s.entry = c.entry AND s.j = c.j)"
        for k in range(rounds)
    ]
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    x AS MATERIALIZED (SELECT vec_id, i // (len(v) // {parts}) AS part, i % (len(v) // {parts}) AS j, v[i + 1] AS x FROM (SELECT vec_id, v, unnest(range(0, len(v))) AS i FROM v)), f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT {entries}),
    c0 AS MATERIALIZED (SELECT x.part, f.entry, x.j, x.x FROM x JOIN f ON f.vec_id = x.vec_id), {", ".join(steps)},
    n AS MATERIALIZED {nearest.format(rounds)}, e AS (SELECT vec_id, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM n GROUP BY vec_id), h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, j)) AS h FROM c{rounds})
    SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, h.h AS codebooks_sha256 FROM v JOIN e ON e.vec_id = v.vec_id CROSS JOIN h"""


def near_duplicates() -> str:
    return f"SELECT *, doc_id = component_id AS kept FROM ({jaccard_join(4, 80)})"
