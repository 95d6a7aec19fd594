"""Text statistics of documents, counted once per document and shared by the quality operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import ASCII_LOWER, code_points, mix, slices, span_hashes, text_buffer, windows, word_spans

WINDOW = 8
STATS = ["n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_exclaimed", "n_stops", "n_digits", "n_distinct_words"]
STATS_TYPE = T.StructType([T.StructField(s, T.LongType()) for s in STATS])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def line_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the lines of every text (an empty text has one empty line)."""
    breaks = np.flatnonzero(buf == 10)
    row = np.searchsorted(off, breaks, "right") - 1
    n = len(off) - 1
    starts = np.concatenate([off[:-1], breaks + 1])
    rows = np.concatenate([np.arange(n), row])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.concatenate([starts[1:] - 1, off[-1:]])
    last = np.concatenate([rows[1:] != rows[:-1], [True]]) if len(rows) else np.zeros(0, bool)
    ends[last] = off[1:]
    return starts, ends, rows


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """Each statistic for every text of a column; nulls count as empty."""
    buf, off = text_buffer(column)
    n = len(off) - 1
    starts, ends, first = word_spans(buf, off)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    begin = code_points(buf)
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    hashes = span_hashes(buf, starts, ends)
    by_doc = np.bincount
    out = {"n_chars": _per_text(begin, off), "n_words": n_words, "word_chars": _per_text(begin & inside, off), "n_symbols": _per_text(_SYMBOL[buf], off)}
    # Lines with a word, and those equal to an earlier one of the same text.
    ls, le, row = line_spans(buf, off)
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, row = ls[full], le[full], row[full]
    codes, distinct = pd.factorize(mix(span_hashes(buf, ls, le) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    firsts = np.zeros(len(distinct), np.int64)
    firsts[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    again = firsts[codes] != np.arange(len(codes))
    out["n_lines"] = by_doc(row, minlength=n)
    out["n_dup_lines"] = by_doc(row[again], minlength=n)
    # Words in windows that their text holds twice or more.
    keys = windows(hashes, WINDOW)
    at = np.flatnonzero(np.arange(len(keys)) + WINDOW <= first[doc[: len(keys)] + 1])
    codes, distinct = pd.factorize(mix(keys[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    at = at[np.bincount(codes, minlength=len(distinct))[codes] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    out["n_repeat_words"] = by_doc(doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    # Words in capitals, words that end in an exclamation, distinct words.
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    lower = np.concatenate([[0], np.cumsum((buf >= 97) & (buf <= 122))])
    capital = (upper[ends] - upper[starts] >= 2) & (lower[ends] == lower[starts])
    out["n_upper_words"] = by_doc(doc[capital], minlength=n)
    tail = buf[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out["n_exclaimed"] = by_doc(doc[tail == ord("!")], minlength=n)
    out["n_stops"] = by_doc(doc[np.isin(tail, list(b".?!"))], minlength=n)
    out["n_digits"] = _per_text((buf >= 48) & (buf <= 57), off)
    low = span_hashes(ASCII_LOWER[buf], starts, ends)
    codes, distinct = pd.factorize(mix(low + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    firsts = np.zeros(len(distinct), np.int64)
    firsts[codes] = doc
    out["n_distinct_words"] = by_doc(firsts, minlength=n)
    return out


def with_stats(docs: DataFrame, column: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column of its texts' statistics; the other columns pass through."""
    fields = [*docs.schema.fields, T.StructField(column, STATS_TYPE)]

    def run(batches):
        for batch in slices(batches, text, 3_000_000):
            stats = text_stats(batch.column(text))
            struct = pa.StructArray.from_arrays([pa.array(stats[s].astype(np.int64)) for s in STATS], names=STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, column])

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, T.StructType(fields))
