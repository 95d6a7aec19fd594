"""Column expressions over text: words, sentences, phrases, syllables. Everything stays in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import STOP_WORDS

WORD = r"[\p{L}\p{N}]+(?:[’-][\p{L}\p{N}]+)*"
TOKEN = WORD + r"|[^\s\p{L}\p{N}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def sentences(text) -> Column:
    """Parts that end in ``.``, ``!`` or ``?`` before white space."""
    marked = F.regexp_replace(F.trim(F.coalesce(_col(text), F.lit(""))), r"([.!?])\s+", "$1\u0001")
    return F.split(marked, "\u0001", -1)


def letter_words(text) -> Column:
    """Lower-cased words made of letters only."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: w.rlike(r"^\p{L}+$"))


def content(words, stop_words: list[str] = STOP_WORDS, longer_than: int = 0) -> Column:
    """The words that are not stop words and have more letters than that."""
    return F.filter(_col(words), lambda w: ~w.isin(stop_words) & (F.char_length(w) > longer_than))


def content_words(text, stop_words: list[str] = STOP_WORDS, longer_than: int = 0) -> Column:
    """Letter words that are not stop words and have more letters than that."""
    return content(letter_words(text), stop_words, longer_than)


def phrases(words: Column, least: int = 1, most: int = 3, keep: int = 20) -> Column:
    """Runs of ``least`` to ``most`` words, by place and then size, of more than 3 characters; the first ``keep``.

    Every place but the last gives a run of more than 3 characters, so no more words than these matter.
    """

    def of(own: Column) -> Column:
        n = F.size(own)
        places = F.when(n >= least, F.sequence(F.lit(0), n - least)).otherwise(F.array().cast("array<int>"))
        runs = F.flatten(F.transform(places, lambda i: F.transform(F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: i + k <= n), lambda k: F.array_join(F.slice(own, i + 1, k), " "))))
        return F.slice(F.filter(runs, lambda p: F.char_length(p) > 3), 1, keep)

    return let(F.slice(_col(words), 1, 2 * keep + most), of)


def grams(words: Column, least: int = 1, most: int = 3) -> Column:
    """All runs of ``least`` to ``most`` words, which hold no spaces."""

    def of(own: Column) -> Column:
        # A run begins at every word and is looked at ahead, so that runs overlap; one pass of the pattern for each length.
        sized = lambda k: F.regexp_extract_all(own, F.lit("(?<![^ ])(?=(" + " ".join(["[^ ]++"] * k) + "))"), F.lit(1))
        return F.concat(*(sized(k) for k in range(least, most + 1)))

    return let(F.array_join(_col(words), " "), of)


#: A term's run in sorted lines, and such a run of two lines or more. Possessive, so a term may be repeated as often as memory allows.
RUN, REPEATED = r"(?md)^(.++)(?:\n\1$)*+", r"(?md)^(.++)(?:\n\1$)++"


def runs(terms, pattern: str = RUN) -> Column:
    """The terms (none is empty or holds a line feed) sorted, equal ones joined by line feeds: counted by ``run_term`` and ``run_count`` without a shuffle."""
    return F.regexp_extract_all(F.array_join(F.sort_array(_col(terms)), "\n"), F.lit(pattern), F.lit(0))


def run_term(run) -> Column:
    return F.substring_index(_col(run), "\n", 1)


def run_count(run) -> Column:
    run = _col(run)
    return ((F.char_length(run) + 1) / (F.char_length(run_term(run)) + 1)).cast("long")


def commonest(terms, top: int) -> Column:
    """(n, term) structs of the ``top`` most frequent terms, ties by term. ``n`` is negative, as it is sorted by it.

    Terms that come once follow in their own order, so only ``top`` of them are looked at.
    """

    def of(own: Column) -> Column:
        many = F.transform(runs(own, REPEATED), lambda r: F.struct((-run_count(r)).alias("n"), run_term(r).alias("term")))

        def ranked(many: Column) -> Column:
            once = F.slice(F.array_except(own, many["term"]), 1, top)
            return F.concat(F.slice(F.sort_array(many), 1, top), F.transform(once, lambda w: F.struct(F.lit(-1).cast("long").alias("n"), w.alias("term"))))

        return F.slice(let(many, ranked), 1, top)

    return let(F.sort_array(_col(terms)), of)


def grouped(rows, key: str) -> Column:
    """Structs sorted by ``key``, in lists of equal keys."""

    def of(own: Column) -> Column:
        begins = F.filter(F.transform(own, lambda x, i: F.when((i == 0) | (x[key] != F.get(own, i - 1)[key]), i)), lambda i: i.isNotNull())
        return let(begins, lambda at: F.transform(at, lambda i, k: F.slice(own, i + 1, F.coalesce(F.get(at, k + 1), F.size(own)) - i)))

    return let(_col(rows), of)


def syllables(word) -> Column:
    """Groups of vowels, one less for a final ``e``, one at least."""
    low = F.lower(_col(word))
    return F.greatest(F.size(F.regexp_extract_all(low, F.lit("[aeiouy]+"), F.lit(0))) - low.endswith("e").cast("int"), F.lit(1))


def contains_any(text, terms: list[str], word_boundary: bool = False) -> Column:
    """Whether any term is a substring of the text (or, on request, a word of it)."""
    text = _col(text)
    if word_boundary:
        import re

        return text.rlike(r"\b(?:" + "|".join(re.escape(t) for t in terms) + r")\b")
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(text, F.lit(term))
    return F.coalesce(out, F.lit(False))


def terms_in(text, terms: list[str]) -> Column:
    """The terms that are substrings of the text, sorted."""
    text = F.coalesce(_col(text), F.lit(""))
    return F.array_sort(F.filter(F.array(*map(F.lit, sorted(set(terms)))), lambda t: F.contains(text, t)))
