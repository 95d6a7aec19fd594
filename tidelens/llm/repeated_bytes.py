"""Operator 6: exact removal of repeated byte strings by column-wise collection suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or
earlier in the document). Inserting every document whole, one symbol a round, would take as many rounds
as the longest document has bytes, each of them a job. Any two equal strings of LENGTH bytes hold the same
anchor - the least hash among their ``GRAM``-byte grams, leftmost - at the same place. So the collection is
split by anchors first, and the column-wise construction runs on the contexts of anchors, which all have
the same bounded length:

1. Each slice of documents finds its anchors and sends, by bucket of the gram, its name, a hash of its whole
   context (every byte of every string of LENGTH bytes that holds it), and its place. All but the first of
   equal contexts are covered whole.
2. Grams with several contexts send these, read from the texts again, to their buckets. There the
   contexts' suffixes are built column by column from the right: each round inserts one symbol before every
   suffix (its column of the collection's Burrows-Wheeler transform), which moves suffixes by a stable
   sort of the symbols, and updates the common prefixes by range minima. When a column stands, neighbours
   with LENGTH common bytes are equal strings, and all but the first of them are covered.

A gram that stands in very many contexts (shared passages are cut differently in every document) is hot:
its strings of LENGTH bytes are named by hashes instead and go through step 1 as contexts of their own. A slice that
finds a hot gram sends one mark to the gram's bucket, so what meets there grows with the slices only.

Between rounds of jobs everything lies in shuffle files and tables of the shared folder.

Defined cases: null and empty texts, and texts under LENGTH bytes, lose nothing. Rows that share a doc_id
(a missing one counts as the least) and start a string at the same place start it at once: neither is earlier, so
a repeated row loses what its first row loses. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._text import mix, slices, text_buffer, trim
from .line_dedup import powers

LENGTH, GRAM = 100, 32
SIDE = LENGTH - GRAM  # bytes of a context on each side of its gram
WIDTH = 2 * SIDE + GRAM
BUCKET_BYTES = 400_000_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
NO_ID = np.iinfo(np.int64).min
#: Contexts of a gram that a slice sends, and that a bucket takes, before the gram is hot.
LOCAL, HOT = 64, 20_000
#: A place in a text and the low bits of the text's hash, which tells rows of one doc_id apart.
ROW_BITS = np.int64(32)
FOUND = "kind int, key long, doc_id long, row long, start long, end long"
COVERED, CONTEXTS, STRINGS = range(3)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least one, leftmost among equals."""
    place, size = np.arange(len(values), dtype=np.int32), 1
    while size * 2 <= width:
        a, b = values[:-size], values[size:]
        take = b < a
        values, place, size = np.where(take, b, a), np.where(take, place[size:], place[:-size]), size * 2
    rest = width - size
    if rest:
        place = np.where(values[rest:] < values[:-rest], place[rest:], place[:-rest])
    return place


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text index, place in the text, gram name and context hash of every anchor."""
    none = np.zeros(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    up, down = powers(_BASE, len(buf)), powers(_INVERSE, len(buf))
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(buf) - GRAM + 1])
    sizes = np.diff(off)
    starts = np.ones(len(buf) - LENGTH + 1, bool)  # starts of strings that end within their text
    tails = np.zeros(len(buf) + 1, np.int32)
    big = sizes > 0
    np.add.at(tails, np.maximum(off[:-1], off[1:] - (LENGTH - 1))[big], 1)
    np.add.at(tails, off[1:][big], -1)
    starts &= np.cumsum(tails[:-1])[: len(starts)] == 0
    at = np.unique(least_places(grams, SIDE + 1)[starts]).astype(np.int64)
    doc = np.searchsorted(off, at, "right") - 1
    begin, end = np.maximum(off[doc], at - SIDE), np.minimum(off[doc + 1], at + GRAM + SIDE)
    context = mix((prefix[end] - prefix[begin]) * down[begin]) + (at - begin).astype(np.uint64) * np.uint64(1 << 20) + (end - at).astype(np.uint64)
    return doc, at - off[doc], grams[at], mix(context)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def _rows(*groups: tuple[np.ndarray, dict[str, np.ndarray]]) -> pa.RecordBatch:
    """One packed row for each bucket: the bytes of every column. A group is its rows' buckets and its columns by name."""
    every = np.unique(np.concatenate([bucket for bucket, _ in groups]))
    columns, names = [pa.array(every.astype(np.int32))], ["bucket"]
    for bucket, group in groups:
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        spans = list(zip(np.searchsorted(bucket, every).tolist(), np.searchsorted(bucket, every, "right").tolist()))
        for name, column in group.items():
            own = column[order]
            columns.append(pa.array([own[a:b].tobytes() for a, b in spans], pa.binary()))
            names.append(name)
    return pa.RecordBatch.from_arrays(columns, names=names)


def _gathered(batches, kinds: dict[str, type]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {k: [] for k in kinds}
    for batch in batches:
        for k in kinds:
            parts[k].extend(np.frombuffer(x, kinds[k]) for x in batch.column(k).to_pylist())
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in parts.items()}


ENTRY = {"gram": np.uint64, "context": np.uint64, "doc": np.int64, "at": np.int64}
PASSED = {"passed_key": np.uint64, "passed_doc": np.int64, "passed_at": np.int64}


def _place(at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places that sort by their place in the text first."""
    return (at.astype(np.int64) << ROW_BITS) | row


def _new(*columns: np.ndarray) -> np.ndarray:
    """For sorted rows, whether each differs from the one before."""
    n = len(columns[0])
    out = np.ones(n, bool)
    if n:
        out[1:] = False
        for c in columns:
            out[1:] |= c[1:] != c[:-1]
    return out


def _later(gram, context, doc, at) -> tuple[np.ndarray, np.ndarray]:
    """For entries sorted by all four: which are kept, and which start later than the first of their gram and context."""
    first = np.flatnonzero(_new(gram, context))
    size = np.diff(np.append(first, len(gram)))
    same = (doc == np.repeat(doc[first], size)) & (at >> ROW_BITS == np.repeat(at[first] >> ROW_BITS, size))
    return _new(gram, context, doc, at) & same, ~same


def _entries(gram, context, ids, at, buckets: int, local: int = LOCAL) -> pa.RecordBatch:
    """A slice's entries by bucket of the gram; those that are settled already, and all of its hot grams, go to any."""
    order = np.lexsort((at, ids, context, gram))
    gram, context, ids, at = gram[order], context[order], ids[order], at[order]
    keep, later = _later(gram, context, ids, at)
    settled = [(np.zeros(int(later.sum()), np.uint64), ids[later], at[later])]
    gram, context, ids, at = (x[keep] for x in (gram, context, ids, at))
    first = np.flatnonzero(_new(gram))
    size = np.diff(np.append(first, len(gram)))
    hot = np.repeat(size > local, size)
    settled.append((gram[hot] | np.uint64(1), ids[hot], at[hot]))
    mark = gram[first[size > local]] & ~np.uint64(1)
    none = np.zeros(len(mark), np.int64)
    entries = [np.concatenate(x) for x in ((gram[~hot] | np.uint64(1), mark), (context[~hot], none.astype(np.uint64)), (ids[~hot], none), (at[~hot], none))]
    passed = [np.concatenate(x) for x in zip(*settled)]
    spread = mix(passed[1].astype(np.uint64) + passed[2].astype(np.uint64))
    to = [((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32) for x in (entries[0], spread)]
    return _rows((to[0], dict(zip(ENTRY, entries))), (to[1], dict(zip(PASSED, passed))))


def _anchor_entries(buckets: int):
    def run(batches):
        for batch in slices(batches, most=2_000_000):
            doc, at, gram, context = anchors(*text_buffer(batch.column("text")))
            if len(doc):
                yield _entries(gram, context, _ids(batch.column("doc_id"))[doc], _place(at, batch.column("row").to_numpy()[doc]), buckets)

    return run


def _found(kind: int, key, doc, at, start, end) -> pa.RecordBatch:
    """Spans that start and end so many bytes from the places ``at``."""
    place = at >> ROW_BITS
    columns = [np.full(len(doc), kind, np.int32), key.astype(np.int64), doc, at & np.int64(0xFFFFFFFF), place + start, place + end]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "key", "doc_id", "row", "start", "end"])


def _judged(e: dict[str, np.ndarray], before: int, after: int):
    """What a bucket of entries tells: spans from ``before`` to ``after`` around later ones, and the places of grams with several contexts."""
    key, doc, at = (e[k] for k in PASSED)
    done = key == 0
    yield _found(COVERED, key[done], doc[done], at[done], before, after)
    yield _found(STRINGS, key[~done], doc[~done], at[~done], 0, 0)
    gram, context, doc, at = (e[k] for k in ENTRY)
    order = np.lexsort((at, doc, context, gram | np.uint64(1)))
    gram, context, doc, at = gram[order], context[order], doc[order], at[order]
    first = np.flatnonzero(_new(gram | np.uint64(1)))
    size = np.diff(np.append(first, len(gram)))
    marked = np.repeat(np.bitwise_and.reduceat(gram & np.uint64(1), first) == 0, size) if len(gram) else np.zeros(0, bool)
    real = (gram & np.uint64(1)) > 0
    gram, context, doc, at, marked = gram[real], context[real], doc[real], at[real], marked[real]
    keep, later = _later(gram, context, doc, at)
    yield _found(COVERED, gram[later], doc[later], at[later], before, after)
    gram, context, doc, at, marked = gram[keep], context[keep], doc[keep], at[keep], marked[keep]
    first = np.flatnonzero(_new(gram))
    size = np.diff(np.append(first, len(gram)))
    contexts = np.add.reduceat(_new(gram, context).astype(np.int64), first) if len(gram) else size
    hot = np.repeat(size > HOT, size) | marked
    several = np.repeat(contexts > 1, size) & ~hot
    yield _found(CONTEXTS, gram[several], doc[several], at[several], 0, 0)
    yield _found(STRINGS, gram[hot], doc[hot], at[hot], 0, 0)


def _anchor_buckets(batches):
    yield from _judged(_gathered(batches, ENTRY | PASSED), -SIDE, GRAM + SIDE)
    trim()


CONTEXT = {"doc": np.int64, "at": np.int64, "left": np.int8, "right": np.int8, "bytes": np.uint8}


def _asked_entries(buckets: int):
    """The asked contexts of each slice by bucket of the gram, their bytes compressed; of hot grams the names of all their strings."""

    def run(batches):
        codec = pa.Codec("zstd", 1)
        for batch in slices(batches, most=2_000_000):
            buf, off = text_buffer(batch.column("text"))
            ids, rows, ats, keys = _ids(batch.column("doc_id")), batch.column("row").to_numpy(), batch.column("ats"), batch.column("keys")
            doc = np.repeat(np.arange(len(ids)), [len(a) for a in ats])
            at, key, kind = ats.flatten().to_numpy(), keys.flatten().to_numpy().astype(np.uint64), batch.column("kinds").flatten().to_numpy()
            size = off[doc + 1] - off[doc]
            strings = np.flatnonzero(kind == STRINGS)
            for a in range(0, len(strings), 10_000):
                own = np.repeat(strings[a : a + 10_000], SIDE + 1)
                start = at[own] - np.tile(np.arange(SIDE + 1), min(10_000, len(strings) - a))
                ok = (start >= 0) & (start + LENGTH <= size[own])
                own, start = own[ok], start[ok]
                begin, once = np.unique(off[doc[own]] + start, return_index=True)  # places that several hot grams share, once
                own, start = own[once], start[once]
                if len(own):
                    name = _string_names(buf, begin)
                    yield _with_all(_entries(name, name, ids[doc[own]], _place(start, rows[doc[own]]), buckets, len(own)))
            own = np.flatnonzero(kind == CONTEXTS)
            left, right = np.minimum(SIDE, at[own]), np.minimum(SIDE, size[own] - at[own] - GRAM)
            begin = off[doc[own]] + at[own] - SIDE
            padded = np.concatenate([np.zeros(SIDE, np.uint8), buf, np.zeros(WIDTH, np.uint8)])
            to = ((key[own] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
            for a in range(0, len(own), 100_000):
                s = slice(a, a + 100_000)
                context = padded[(begin[s] + SIDE)[:, None] + np.arange(WIDTH)]
                packed = _rows((to[s], dict(zip(CONTEXT, (ids[doc[own[s]]], _place(at[own[s]], rows[doc[own[s]]]), left[s].astype(np.int8), right[s].astype(np.int8), context)))))
                raw = packed.column("bytes").to_pylist()
                small = pa.array([len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in raw], pa.binary())
                yield _with_all(packed.set_column(packed.schema.get_field_index("bytes"), "bytes", small))

    return run


def _string_names(buf: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings of LENGTH bytes that begin at these places."""
    up, down = powers(_BASE, len(buf)), powers(_INVERSE, len(buf))
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    return mix((prefix[begin + LENGTH] - prefix[begin]) * down[begin])


def _with_all(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A packed batch with every column that a bucket of the second step may have."""
    names = [f"{n}_of_string" if n in ENTRY and "gram" in batch.schema.names else n for n in batch.schema.names]
    have = dict(zip(names, batch.columns))
    empty = pa.array([b""] * batch.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([have.get(n, empty) for n in ASKED_NAMES], names=ASKED_NAMES)


ASKED_NAMES = ["bucket", *CONTEXT, *(f"{n}_of_string" for n in ENTRY), *PASSED]


def equal_strings(text: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For contexts in order of place (n x WIDTH bytes): whether the string of LENGTH bytes at each of the first columns occurs in a context of an earlier place.

    ``order`` are the contexts by the suffix that starts at the current column; ``common`` is the common
    prefix of each with the one before, counted up to LENGTH.
    """
    n = len(text)
    repeated = np.zeros((n, SIDE + 1), bool)
    if n < 2:
        return repeated
    columns = np.ascontiguousarray(text.T)
    order, common = np.arange(n), np.zeros(n, np.uint8)
    common[1:] = LENGTH  # beyond the last column all suffixes are equal and empty; what is compared never reaches there
    levels = int(np.log2(n)) + 1
    for column in range(WIDTH - 1, -1, -1):
        symbols = columns[column][order]  # the transform's part of this column: symbols before the suffixes, in their order
        moved = np.argsort(symbols, kind="stable")
        # Least common prefix over (p, q] for neighbours of equal symbol that stood at p < q.
        table = [common]
        for k in range(levels - 1):
            step = 1 << k
            if len(table[-1]) <= step:
                break
            table.append(np.minimum(table[-1][:-step], table[-1][step:]))
        p, q = moved[:-1], moved[1:]
        equal = symbols[p] == symbols[q]
        low, high = p[equal] + 1, q[equal]
        k = np.frexp((high - low + 1).astype(float))[1] - 1
        least = np.empty(len(low), np.uint8)
        for level in np.unique(k).tolist():
            own = k == level
            least[own] = np.minimum(table[level][low[own]], table[level][high[own] - (1 << level) + 1])
        common = np.zeros(n, np.uint8)
        common[1:][equal] = np.minimum(least.astype(np.int16) + 1, LENGTH)
        order = order[moved]
        if column <= SIDE:
            valid = (left >= SIDE - column)[order] & (right >= column)[order]
            group = np.cumsum(common < LENGTH)[valid]
            own = order[valid]
            if len(own) > 1:
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                first = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(own))))
                repeated[own[place[own] != place[first]], column] = True
    return repeated


def _asked_buckets(batches):
    parts: dict[str, list] = {k: [] for k in ASKED_NAMES[1:]}
    kinds = CONTEXT | {f"{k}_of_string": v for k, v in ENTRY.items()} | PASSED
    codec = pa.Codec("zstd", 1)
    for batch in batches:
        for k, kind in kinds.items():
            for x in batch.column(k).to_pylist():
                raw = codec.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) if k == "bytes" and x else x
                parts[k].append(np.frombuffer(raw, kind))
    e = {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in parts.items()}
    parts.clear()
    # Names of strings are judged as contexts are; a hot string has one context, so nothing is asked of it again.
    strings = {k: e.pop(f"{k}_of_string") for k in ENTRY} | {k: e.pop(k) for k in PASSED}
    if len(strings["gram"]) or len(strings["passed_key"]):
        yield from _judged(strings, 0, LENGTH)
    if len(e["doc"]):
        order = np.lexsort((e["at"], e["doc"]))
        doc, at, left, right = (e[k][order] for k in ("doc", "at", "left", "right"))
        place = np.cumsum(_new(doc, at >> ROW_BITS))
        repeated = equal_strings(e["bytes"].reshape(-1, WIDTH)[order], left.astype(np.int64), right.astype(np.int64), place)
        edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, start = np.nonzero(edge > 0)
        _, end = np.nonzero(edge < 0)
        yield _found(COVERED, np.zeros(len(row), np.int64), doc[row], at[row], start - SIDE, end - SIDE - 1 + LENGTH)
    trim()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def covered_mask(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, np.clip(starts, 0, size), 1)
    np.add.at(step, np.clip(ends, 0, size), -1)
    return np.cumsum(step[:-1]) > 0


def _digests(batches):
    for batch in slices(batches, most=4_000_000):
        buf, off = text_buffer(batch.column("text"))
        out = []
        for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
            own, starts, ends = buf[a:b], batch.column("starts")[k], batch.column("ends")[k]
            gone = covered_mask(b - a, np.array(starts.values), np.array(ends.values)) if starts.is_valid else np.zeros(b - a, bool)
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
            out.append((b - a, int(gone.sum()), spans, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
        columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the hash that tells rows of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).bitwiseAND(0xFFFFFFFF).alias("row"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, start, end): byte spans (they may overlap) of each document that repeated strings cover; ``NO_ID`` for a null doc_id."""
    spark = docs.sparkSession
    texts = _texts(docs)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    binary = lambda names: ", ".join(f"{k} binary" for k in names)
    found = written(texts.mapInArrow(_anchor_entries(buckets), f"bucket int, {binary((*ENTRY, *PASSED))}").repartition(buckets, "bucket").mapInArrow(_anchor_buckets, FOUND), "anchors")
    lists = [F.collect_list(c).alias(a) for c, a in (("start", "ats"), ("key", "keys"), ("kind", "kinds"))]
    asked = written(found.where(F.col("kind") != COVERED).groupBy(F.col("doc_id").alias("owner"), F.col("row").alias("owner_row")).agg(*lists), "asked-contexts")
    wanted = texts.join(asked.hint("merge"), (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("owner")) & (F.col("row") == F.col("owner_row"))).select("doc_id", "row", "text", "ats", "keys", "kinds")
    entries = wanted.mapInArrow(_asked_entries(buckets), f"bucket int, {binary(ASKED_NAMES[1:])}")
    more = written(entries.repartition(buckets, "bucket").mapInArrow(_asked_buckets, FOUND), "contexts", asked)
    return found.unionByName(more).where(F.col("kind") == COVERED).select("doc_id", "row", "start", "end")


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    spans = repeated_spans(docs).groupBy(F.col("doc_id").alias("owner"), F.col("row").alias("owner_row")).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    on = (F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("owner")) & (F.col("row") == F.col("owner_row"))
    return _texts(docs).join(spans.hint("merge"), on, "left").select("doc_id", "text", "starts", "ends").mapInArrow(_digests, RESULT)
