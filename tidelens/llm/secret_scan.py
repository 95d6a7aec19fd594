"""Operator 3: secret scan behind a trigram inverted index, in DataFrame functions only.

For each rule a Boolean trigram query is derived from its regular expression: literals and small
character classes expand to strings, alternatives become OR, sequences AND, and a part that fixes no
trigram asks for nothing. The index holds, for every trigram that some query names, the list of the rows with it
(``postings``, written to the shared folder). Intersecting gathers a row's places on the lists as bits, one aggregate for all queries,
and tests each query on them (``candidates``). Candidates are verified with the rule's expression over the whole text. A rule
without a mandatory trigram scans every text.

Spans are code points, end exclusive. They come from marking matches and measuring the parts between
marks; the two mark characters are first replaced in the text by another control character, which no
rule can match either, so places stay right. Starts are running sums over the parts, taken in chunks, so the work grows with
the matches of a text, not with their square.

A row is known to the index by a hash of its doc_id and text; rows that share one are candidates together, which
verification settles. Defined cases: a null or empty text has no spans; repeated rows and rows without doc_id are
scanned each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re._constants as _op
import re._parser as _parser
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ._shared import written

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
MOST_STRINGS = 64
#: Kinds in order, with the expression of each, and the group and length that a match must reach.
ASSIGN = "((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES: list[tuple[str, str, int, int]] = [
    ("assign", ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("private_key", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 0, 27),
    ("live_key", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
]
BASE = ("assign", "access", "hex")

# A query is None (no condition), or ("and" | "or", parts), or a trigram.


def _both(kind: str, parts: list):
    """AND drops parts without condition; an OR with such a part has no condition itself."""
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _strings(node) -> list[str] | None:
    """All strings (lower-cased) that a node matches, if they are few."""
    op, value = node
    if op is _op.LITERAL:
        return [chr(value).lower()]
    if op is _op.IN:
        out: set[str] = set()
        for kind, v in value:
            if kind is _op.LITERAL:
                out.add(chr(v).lower())
            elif kind is _op.RANGE and v[1] - v[0] < MOST_STRINGS:
                out.update(chr(c).lower() for c in range(v[0], v[1] + 1))
            else:
                return None
        return sorted(out) if len(out) <= 8 else None
    if op is _op.SUBPATTERN:
        return _sequence_strings(value[-1])
    if op is _op.BRANCH:
        out = set()
        for branch in value[1]:
            own = _sequence_strings(branch)
            if own is None:
                return None
            out.update(own)
        return sorted(out) if len(out) <= MOST_STRINGS else None
    if op in (_op.MAX_REPEAT, _op.MIN_REPEAT) and value[1] <= 2:
        own = _sequence_strings(value[2])
        if own is None:
            return None
        out = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(own, repeat=n)}
        return sorted(out) if len(out) <= MOST_STRINGS else None
    return None


def _sequence_strings(nodes) -> list[str] | None:
    out = [""]
    for node in nodes:
        own = _strings(node)
        if own is None or len(out) * len(own) > MOST_STRINGS:
            return None
        out = [a + b for a in out for b in own]
    return out


def _of_strings(strings: list[str]):
    return _both("or", [_both("and", [s[k : k + 3] for k in range(len(s) - 2)]) for s in strings])


def _query(nodes):
    parts, run = [], [""]
    for node in nodes:
        own = _strings(node)
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = [a + b for a in run for b in own]
            continue
        parts.append(_of_strings(run))
        run = [""] if own is None else own
        if own is None:
            op, value = node
            if op is _op.SUBPATTERN:
                parts.append(_query(value[-1]))
            elif op is _op.BRANCH:
                parts.append(_both("or", [_query(b) for b in value[1]]))
            elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT) and value[0] >= 1:
                parts.append(_query(value[2]))
    return _both("and", [*parts, _of_strings(run)])


def trigram_query(pattern: str):
    """The Boolean trigram query of a pattern over lower-cased text; None if it has no mandatory trigram."""
    return _query(_parser.parse(pattern))


def trigrams(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams(p) for p in query[1]))


def dictionary(rules=RULES) -> list[str]:
    """All trigrams that the rules' queries name; a trigram's place is its bit."""
    return sorted(set().union(*(trigrams(trigram_query(p)) for _, p, _, _ in rules)))


def candidate(query, entry: Column, words: list[str]) -> Column:
    """Whether a document's entry satisfies a query."""
    if query is None:
        return F.lit(True)
    places = {w: k for k, w in enumerate(words)}

    def bits(own: list[str]) -> Column:
        masks: dict[int, int] = {}
        for w in own:
            masks[places[w] // 63] = masks.get(places[w] // 63, 0) | 1 << places[w] % 63
        return reduce(lambda a, b: a & b, (entry[g].bitwiseAND(F.lit(m).cast("long")) == m for g, m in masks.items()))

    def test(q) -> Column:
        if isinstance(q, str):
            return bits([q])
        kind, parts = q
        if kind == "or":
            return reduce(lambda a, b: a | b, map(test, parts))
        plain = [p for p in parts if isinstance(p, str)]
        tests = ([bits(plain)] if plain else []) + [test(p) for p in parts if not isinstance(p, str)]
        return reduce(lambda a, b: a & b, tests)

    return test(query)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text without the marks, and the key by which the index knows a row."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), OPEN + CLOSE, OTHER * 2)
    return docs.select("doc_id", text.alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def postings(rows: DataFrame, rules=RULES) -> DataFrame:
    """The inverted index of rows (key, text): (trigram, key) for the trigrams that the rules name."""
    held = F.filter(F.array(*map(F.lit, dictionary(rules))), lambda w: F.contains(F.col("low"), w))
    return rows.select("key", F.lower("text").alias("low")).select(F.explode(held).alias("trigram"), "key")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, rules): the rows whose posting lists satisfy some query; bit k says that rule k's query is satisfied."""
    words = dictionary(rules)
    place = F.array_position(F.array(*map(F.lit, words)), F.col("trigram")) - 1
    groups = range(0, len(words), 63)
    lists = [F.bit_or(F.when(F.col("place").between(g, g + 62), F.expr(f"shiftleft(1L, cast(place - {g} as int))")).otherwise(F.lit(0).cast("long"))) for g in groups]
    entries = index.withColumn("place", place).groupBy("key").agg(F.array(*lists).alias("entry"))
    queries = [(rank, trigram_query(pattern)) for rank, (_, pattern, _, _) in enumerate(rules)]
    masks = [F.when(candidate(q, F.col("entry"), words), F.lit(1 << rank)).otherwise(F.lit(0)).cast("long") for rank, q in queries if q is not None]
    return entries.select("key", reduce(lambda a, b: a + b, masks, F.lit(0).cast("long")).alias("rules")).where("rules != 0")


def running(sizes: Column, chunk: int = 128) -> Column:
    """For an array of numbers the sum of those before each, chunk by chunk."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    within = lambda c, before: F.transform(c, lambda _, k: before + total(F.slice(c, 1, k)))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / chunk).cast("int")), lambda i: F.slice(s, i * chunk + 1, chunk))
    joined = lambda chunks, sums: F.flatten(F.transform(chunks, lambda c, i: let(total(F.slice(sums, 1, i)), lambda before: within(c, before))))
    return let(sizes, lambda s: let(cut(s), lambda chunks: let(F.transform(chunks, total), lambda sums: joined(chunks, sums))))


SPANS = "array<struct<start:long,rank:int,end:long,kind:string>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank, end, kind) of a rule's matches that are long enough: every second part lies between marks."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    enough = lambda part: F.char_length(F.regexp_extract(part, pattern, group) if group else part) >= least

    def span(part: Column, start: Column, k: Column) -> Column:
        own = F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.char_length(part)).alias("end"), F.lit(kind).alias("kind"))
        return F.when((k % 2 == 1) & enough(part), own)

    sizes = lambda p: F.transform(p, lambda x: F.char_length(x).cast("long"))
    found = lambda p: let(running(sizes(p)), lambda at: F.filter(F.transform(p, lambda x, k: span(x, F.get(at, k), k)), lambda x: x.isNotNull()))
    none = F.array().cast(SPANS)
    return let(parts, lambda p: F.when(F.size(p) > 1, found(p)).otherwise(none))


def _equal(kind: str):
    return lambda k: k == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row."""
    rows = keyed(docs)
    index = written(postings(rows, rules).sortWithinPartitions("trigram"), "postings")
    asked = rows.join(candidates(index, rules), "key", "left")
    none = F.array().cast(SPANS)
    found = []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        spans = _spans(F.col("text"), rank, kind, pattern, group, least)
        found.append(spans if trigram_query(pattern) is None else F.when(F.col("rules").bitwiseAND(1 << rank) != 0, spans).otherwise(none))
    out = asked.select("doc_id", F.array_sort(F.concat(*found)).alias("all")).withColumn("base", F.filter("all", lambda s: s["kind"].isin(*BASE)))
    counts = [F.size(F.filter(F.col("base")["kind"], _equal(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))
