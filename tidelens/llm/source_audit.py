"""Operator 11: what sets the sources of a language apart, by ranks of count cells.

A term is a run of letters A-Z (lower-cased), a-z and of all code points from U+0080 on. A language keeps the terms of at
least ``LEAST_DOCS`` of its documents. Each (lang, source) group, and each language, gives every kept term a smoothed share
in integers, ``share``. Two reports come of them:

``term``  the terms that a group uses more than its language. Terms are grouped into cells by (count in the group, count in
          the language): a share depends on nothing else, so it is evaluated once a cell. Cells of equal excess are merged,
          their multiplicities are added up from the largest excess down, and only the cells whose first rank is within
          ``RANKS`` are expanded into terms, in UTF-8 order. At most ``RANKS`` values of a group are ever ranked.
``pair``  how far the shares of two sources of a language lie apart, summed over the kept terms. Terms that neither source
          has are one cell, whose multiplicity is what is left of the language's terms; the others are summed in blocks of
          ``TERMS`` terms and two tiles of ``TILE`` sources, in which terms of equal counts are one cell.

Texts are counted within tasks before anything is shuffled, so a hot source, language or term moves a row a task.

Defined cases: null text, lang and source are empty ones; repeated rows count each; a group without terms has the share of
count 0 for every kept term; a language without kept terms has pairs of value 0 and no terms; ties are ordered by the UTF-8
bytes of the item; extra columns are ignored; an empty table gives no rows. Counts may come to 9 * 10^15 a language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import release, written
from ._text import slices, span_hashes, text_buffer, word_spans

LEAST_DOCS, RANKS = 30, 50
SMOOTH, SCALE = 5, 1_000_000_000
#: Terms and sources of a block of pairs.
TERMS, TILE = 2048, 64
#: Bytes of text that are counted at once.
COUNTED_BYTES = 12_000_000
#: Letters as they are counted; all other bytes are blanks.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings between places of a buffer."""
    n = ends - starts
    to = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(to[-1]) + np.repeat(starts - to[:-1], n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(buf[at])).cast(pa.string())


def _counted(batches):
    """Occurrences and documents of each term in each group of a slice; a row without term for the group itself."""
    for batch in slices(batches, most=COUNTED_BYTES):
        own = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
        lang, source = (x.indices.to_numpy() for x in own)
        row = np.lexsort((source, lang))
        lang, source = lang[row], source[row]
        group = np.cumsum(np.concatenate([[0], (lang[1:] != lang[:-1]) | (source[1:] != source[:-1])]))
        buf, off = text_buffer(batch.column("text").take(pa.array(row)))
        buf = _LETTER[buf]
        starts, ends, first = word_spans(buf, off)
        hashes = span_hashes(buf, starts, ends)
        order = np.argsort(hashes, kind="stable")
        doc = np.repeat(np.arange(len(row)), np.diff(first))[order]
        other = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])[: len(order)]
        in_doc = other | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(order)]
        in_group = other | np.concatenate([[True], group[doc][1:] != group[doc][:-1]])[: len(order)]
        at = np.flatnonzero(in_group)
        n = np.diff(np.append(at, len(order)))
        docs = np.add.reduceat(in_doc.astype(np.int64), at) if len(at) else n
        head = np.unique(group, return_index=True)[1]
        rows = np.concatenate([head, doc[at]])
        none = np.zeros(len(head), np.int64)
        terms = pa.concat_arrays([pa.nulls(len(head), pa.string()), _spans(buf, starts[order[at]], ends[order[at]])])
        names = [x.dictionary.take(pa.array(codes[rows])) for x, codes in zip(own, (lang, source))]
        yield pa.RecordBatch.from_arrays([*names, terms, pa.array(np.concatenate([none, n])), pa.array(np.concatenate([none, docs]))], names=["lang", "source", "term", "n", "docs"])


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), three digits at a time so that no product overflows; null without terms."""
    by, left, out = F.nullif(total + SMOOTH * terms, F.lit(0)), count + SMOOTH, F.lit(1).cast("long")
    for k in (1_000_000, 1000, 1):
        out = out + k * F.call_function("div", 1000 * left, by)
        left = (1000 * left) % by
    return out


def group_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The kept terms of each group with their counts (lang, source, term, n, in_lang), and the groups (lang, source, total, terms, lang_total), both written."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counted = texts.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counted = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    terms = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    kept = written(counted.select("lang", "source", "term", "n").join(terms.select("lang", "term", "in_lang"), ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"), "kept-terms")
    of_term = kept.groupBy("lang", "term").agg(F.max("in_lang").alias("in_lang"))
    langs = of_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = counted.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    return kept, written(groups.select("lang", "source", none("total"), none("terms"), none("lang_total")), "groups", counted)


def distinctive_terms(kept: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item, value, rank of the first ``ranks`` terms of each group by the excess of their share over the language's."""
    cells = kept.groupBy("lang", "source", "n", "in_lang").agg(F.count("*").alias("size")).join(groups, ["lang", "source"])
    excess = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    cells = written(cells.withColumn("value", excess).where("value > 0").select("lang", "source", "n", "in_lang", "value", "size"), "cells")
    down = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("size").alias("size"))
    values = values.withColumn("k", F.row_number().over(down)).where(F.col("k") <= ranks)
    before = F.sum("size").over(down) - F.col("size")
    first = values.withColumn("before", before).where(F.col("before") < ranks).select("lang", "source", "value", "before")
    wanted = cells.join(first, ["lang", "source", "value"]).select("lang", "source", "n", "in_lang", "value", "before")
    terms = kept.join(wanted, ["lang", "source", "n", "in_lang"])
    place = F.row_number().over(Window.partitionBy("lang", "source", "value").orderBy("term"))
    terms = terms.withColumn("place", place).where(F.col("place") <= ranks)
    return terms.select("lang", "source", F.col("term").alias("item"), "value", (F.col("before") + F.col("place")).cast("int").alias("rank")).where(F.col("rank") <= ranks)


def _apart(key, heads: pa.Table, terms: pa.Table) -> pa.Table:
    """Sums of a block of terms for every source of one tile and every source of another."""
    lang, _, a, b = (k.as_py() for k in key)
    of = dict(zip(heads.column("side").to_pylist(), heads.column("sources").to_pylist()))
    left, right = (sorted(of[s], key=lambda x: x["slot"]) for s in (0, 1 if a != b else 0))
    zero = [np.array([x["share"] for x in side], np.int64) for side in (left, right)]
    names = terms.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if terms.num_rows else np.zeros(0, np.int64)
    seen = int(names.max()) + 1 if len(names) else 0
    matrix = [np.repeat(z[None], seen, 0) for z in zero]
    if seen:
        side, entries = terms.column("side").to_numpy(), terms.column("shares").combine_chunks()
        row = np.repeat(np.arange(len(names)), np.diff(entries.offsets.to_numpy()))
        slot, value = (entries.flatten().field(c).to_numpy() for c in ("slot", "share"))
        for s in (0, 1):
            own = side[row] == s if a != b else np.ones(len(row), bool)
            matrix[s][names[row[own]], slot[own]] = value[own]
    cells, size = np.unique(np.concatenate(matrix, 1), axis=0, return_counts=True) if seen else (np.zeros((0, len(left) + len(right)), np.int64), np.zeros(0, np.int64))
    p, q = cells[:, : len(left)], cells[:, len(left) :]
    sums = np.array([size @ np.abs(p[:, k : k + 1] - q) for k in range(len(left))]).reshape(-1)
    i, j = np.divmod(np.arange(len(sums)), len(right))
    rest = np.abs(zero[0][i] - zero[1][j])
    names = [pa.array([x["source"] for x in side], pa.string()).take(pa.array(k)) for side, k in ((left, i), (right, j))]
    return pa.table([pa.array([lang] * len(sums), pa.string()), *names, pa.array(sums), pa.array(np.full(len(sums), seen)), pa.array(rest)], names=["lang", "source", "item", "value", "seen", "rest"])


def source_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the shares of two different sources of a language apart, summed over its kept terms."""
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    blocks = F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)).cast("int")
    zero = F.coalesce(share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))
    placed = groups.withColumn("at", at).select("*", F.expr(f"int(at div {TILE})").alias("tile"), (F.col("at") % TILE).alias("slot"), blocks.alias("blocks"), zero.alias("zero"))
    placed = written(placed, "placed-groups")
    tiles = placed.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"), F.max("blocks").alias("blocks"))
    heads = placed.groupBy("lang", "tile").agg(F.collect_list(F.struct("source", "slot", F.col("zero").alias("share"))).alias("sources")).join(tiles, "lang")

    def paired(rows: DataFrame, *columns: str) -> DataFrame:
        """Rows of each tile with every other one of the language, the smaller first; a tile with itself once."""
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        rows = rows.select("*", other)
        return rows.select("lang", "block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"), *columns)

    heads = paired(heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "sources")
    shares = kept.join(placed, ["lang", "source"]).select("lang", "term", "tile", "slot", share(F.col("n"), F.col("total"), F.col("terms")).alias("share"))
    rows = shares.groupBy("lang", "term", "tile").agg(F.collect_list(F.struct("slot", "share")).alias("shares")).join(tiles, "lang")
    rows = paired(rows.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")), "term", "shares")
    key = ["lang", "block", "a", "b"]
    parts = heads.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_apart, "lang string, source string, item string, value long, seen long, rest long")
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("rest").alias("rest"))
    summed = summed.where("source <> item").join(groups.select("lang", "source", "terms"), ["lang", "source"])
    one = summed.select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("rest")).alias("value"))
    # Tiles of different numbers met once; their sources are each other's.
    return one.unionByName(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).distinct()


def source_audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of every group of ``docs`` (text, lang, source)."""
    kept, groups = group_counts(docs)
    pairs = source_distances(kept, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = distinctive_terms(kept, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    out = written(pairs.unionByName(terms), "source-audit")
    release(kept, groups)
    return out
