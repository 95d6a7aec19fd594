"""Operator 2: near-duplicate lines by a segment-partition edit join.

Two lines are duplicates when they are equal, or within a number of edits that grows with the shorter of
them: one word (put in, taken out or replaced) for every ``WORDS_AN_EDIT`` words, at most ``MOST_WORDS``; or, for lines of at most
``SHORT_LINE`` code points, one code point for every ``POINTS_AN_EDIT``, at most ``MOST_POINTS``. So a line of
a few letters has no near duplicate. Duplicates of duplicates count too. Of each class the first line, by
(doc_id, line number), stays everywhere it comes first; every other occurrence goes.

A line is a string of symbols: of its words, or of its code points. A line with t edits allowed is split
into t + 1 even segments. A line within t edits must hold one of them unchanged, near its place; so each
line sends its segments (as an index for its length) and, for each length at most t shorter, the few
substrings that a segment can equal. Lines that meet under a key (``_runs``) are verified with a banded
bit-parallel edit distance, many pairs at a time. Long runs of lines give a star first and then only
pairs between components, which are verified where they are found.

Lines are named by 64-bit hashes. Defined cases: lines without words are never touched; null and empty
texts stay; a line's words are compared as they are, white space between them is not; rows that share a
doc_id share its line numbers, so equal lines at one place stay in each; repeated rows likewise; a
missing doc_id counts as the least one; other columns pass through, whatever their names; an empty table
stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runs
from ._graph import components
from ._shared import free_name, release, written
from ._stats import line_spans
from ._text import code_points, mix, slices, span_hashes, text_buffer, trim, word_spans

WORDS_AN_EDIT, MOST_WORDS = 10, 3
POINTS_AN_EDIT, MOST_POINTS, SHORT_LINE = 16, 2, 80
#: Text bytes whose entries make a bucket, about.
BUCKET_BYTES = 16_000_000
NO_ID = np.iinfo(np.int64).min
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PLACE = np.dtype([("name", "<i8"), ("doc", "<i8"), ("line", "<i4")])


def word_edits(words: np.ndarray) -> np.ndarray:
    """The word edits allowed to a line and one that is not shorter."""
    return np.minimum(words // WORDS_AN_EDIT, MOST_WORDS)


def point_edits(points: np.ndarray) -> np.ndarray:
    """The code point edits allowed to a line and one that is not shorter."""
    return np.where(points <= SHORT_LINE, np.minimum(points // POINTS_AN_EDIT, MOST_POINTS), 0)


def powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n of an odd number, modulo 2 ** 64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def segments(length: int | np.ndarray, edits: int) -> list[tuple]:
    """Start and size of each of the edits + 1 segments of a line of that length."""
    parts = edits + 1
    size, longer = length // parts, length % parts
    out, at = [], length * 0
    for k in range(parts):
        own = size + (k >= parts - longer)
        out.append((at, own))
        at = at + own
    return out


def probes(length: np.ndarray, allowed, most: int):
    """For lines of these lengths: (lines, indexed length, segment, substring start, size, whether it is the line's own segment)."""
    for delta in range(most + 1):
        edits = np.where(length > delta, allowed(np.maximum(length - delta, 0)), 0)
        for t in range(max(1, delta), most + 1):
            own = np.flatnonzero(edits == t)
            if not len(own):
                continue
            indexed = length[own] - delta
            for k, (start, size) in enumerate(segments(indexed, t)):
                for shift in range(max(-k, delta - (t - k)), min(k, delta + (t - k)) + 1):
                    begin = start + shift
                    ok = (begin >= 0) & (begin + size <= length[own])
                    yield own[ok], indexed[ok], k, begin[ok], size[ok], delta == 0 and shift == 0


def _lines_of(column: pa.Array):
    """Bytes, spans, text and line number of every line with a word, its 64-bit name, and the words' spans."""
    buf, off = text_buffer(column)
    starts, ends, _ = word_spans(buf, off)
    ls, le, row = line_spans(buf, off)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, row, number = ls[full], le[full], row[full], number[full]
    return buf, ls, le, row, number, span_hashes(buf, ls, le).astype(np.int64), starts, ends


def _packed(place: np.ndarray, rows: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(place, kind="stable")
    place, rows, again = place[order], rows[order], again[order]
    cut = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)] if len(place) else [0]
    spans = list(zip(cut[:-1], cut[1:]))
    columns = [pa.array([x.tobytes() for x in (a[i:j] for i, j in spans)], pa.binary()) for a in (rows, again)]
    return pa.RecordBatch.from_arrays([pa.array(place[cut[:-1]].astype(np.int32) if spans else [], pa.int32()), *columns], names=["bucket", "rows", "again"])


def _places(buckets: int):
    """The lines of each slice by bucket of the name. Lines after the slice's first of their name are settled, and go anywhere."""

    def run(batches):
        for batch in slices(batches):
            _, _, _, row, number, name, _, _ = _lines_of(batch.column("text"))
            e = np.empty(len(name), PLACE)
            e["name"], e["line"] = name, number
            e["doc"] = batch.column("doc_id").fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)[row]
            e = e[np.lexsort((e["line"], e["doc"], e["name"]))]
            again = np.concatenate([[False], e["name"][1:] == e["name"][:-1]]) if len(e) else np.zeros(0, bool)
            spread = mix(np.where(again, e["doc"] * 31 + e["line"], e["name"]).astype(np.uint64))
            yield _packed((spread % np.uint64(buckets)).astype(np.int64), e, again)

    return run


def _named(batches):
    """name, doc_id, line of every distinct place of a line, and whether it is the name's first."""
    rows, again = [np.zeros(0, PLACE)], [np.zeros(0, bool)]
    for batch in batches:
        rows.extend(np.frombuffer(x, PLACE) for x in batch.column("rows").to_pylist())
        again.extend(np.frombuffer(x, bool) for x in batch.column("again").to_pylist())
    e, settled = np.concatenate(rows), np.concatenate(again)
    rows.clear()
    again.clear()
    order = np.lexsort((e["line"], e["doc"], e["name"], settled))
    e, settled = e[order], settled[order]
    same = np.concatenate([[False], e["name"][1:] == e["name"][:-1]]) if len(e) else np.zeros(0, bool)
    first = ~settled & ~same
    once = ~same | np.concatenate([[True], (e["doc"][1:] != e["doc"][:-1]) | (e["line"][1:] != e["line"][:-1])]) if len(e) else same
    e, first = e[once], first[once]
    for at in range(0, len(e), 100_000):
        part = e[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part["name"].copy()), pa.array(part["doc"].copy()), pa.array(part["line"].copy()), pa.array(first[at : at + 100_000])], names=["name", "doc_id", "line", "first"])
    trim()


def _keys(kind: int, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, name: np.ndarray, allowed, most: int):
    up, down = powers(_BASE, len(symbols)), powers(_INVERSE, len(symbols))
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols + np.uint64(1)) * up[:-1], out=prefix[1:])
    for lines, indexed, k, at, size, own in probes(length, allowed, most):
        a = start[lines] + at
        content = (prefix[a + size] - prefix[a]) * down[a]
        key = mix(mix(content) + indexed.astype(np.uint64) * np.uint64(64) + np.uint64(8 * kind + k))
        key &= ~_runs.LOW
        yield key | _runs.ROLE if own else key, name[lines]


def _entries(buckets: int):
    def run(batches):
        for batch in slices(batches, most=3_000_000):
            buf, ls, le, _, _, name, ws, we = _lines_of(batch.column("text"))
            _, keep = np.unique(name, return_index=True)
            ls, le, name = ls[keep], le[keep], name[keep]
            s = _Symbols(buf, ls, le, ws, we)
            found = [*_keys(0, s.words, s.first, s.n_words, name, word_edits, MOST_WORDS), *_keys(1, s.points.astype(np.uint64), s.at, s.n_points, name, point_edits, MOST_POINTS)]
            if found:
                yield _runs.packed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), buckets)

    return run


def may_pair(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """One of the two is indexed under the key."""
    return ((keys[i] | keys[j]) & _runs.ROLE) > 0


class _Symbols:
    """Lines as strings of symbols: hashes of all words, and the code points of lines that are short enough for edits of them."""

    def __init__(self, buf: np.ndarray, ls: np.ndarray, le: np.ndarray, ws: np.ndarray, we: np.ndarray):
        self.words = span_hashes(buf, ws, we)
        self.first = np.searchsorted(ws, ls)
        self.n_words = np.searchsorted(ws, le) - self.first
        begins = np.concatenate([[0], np.cumsum(code_points(buf))])
        self.n_points = begins[le] - begins[ls]
        short = np.flatnonzero(self.n_points <= SHORT_LINE + MOST_POINTS)
        step = np.zeros(len(buf) + 1, np.int32)
        np.add.at(step, ls[short], 1)
        np.add.at(step, le[short], -1)
        inside = np.cumsum(step[:-1]) > 0
        self.points = np.frombuffer(buf[inside].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        in_order = short[np.argsort(ls[short], kind="stable")]
        self.at = np.zeros(len(ls), np.int64)
        self.at[in_order] = np.cumsum(self.n_points[in_order]) - self.n_points[in_order]

    @classmethod
    def of(cls, column: pa.Array) -> _Symbols:
        buf, off = text_buffer(column)
        ws, we, _ = word_spans(buf, off)
        return cls(buf, off[:-1], off[1:], ws, we)

    def sketches(self) -> np.ndarray:
        """256 parity bits of each line's words. A word edit flips two bits at most, an edit of a code point three."""
        out = np.zeros((len(self.first), 4), np.uint64)
        bit, place = np.uint64(1) << (self.words & np.uint64(63)), (self.words >> np.uint64(6)) & np.uint64(3)
        for k in range(4):
            total = np.zeros(len(bit) + 1, np.uint64)
            np.bitwise_xor.accumulate(np.where(place == k, bit, np.uint64(0)), out=total[1:])
            out[:, k] = total[self.first + self.n_words] ^ total[self.first]
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the lines i and j are near duplicates, pair by pair."""
        out = np.zeros(len(i), bool)
        for symbols, start, length, allowed, most in ((self.words, self.first, self.n_words, word_edits, MOST_WORDS), (self.points, self.at, self.n_points, point_edits, MOST_POINTS)):
            m, n = np.minimum(length[i], length[j]), np.maximum(length[i], length[j])
            edits = allowed(m)
            for t in range(1, most + 1):
                own = np.flatnonzero(~out & (edits == t) & (n - m <= t))
                if len(own):
                    out[own] = within(symbols, start, length, i[own], j[own], t)
        return out


#: Most sketch bits that the edits allowed can flip.
MOST_FLIPS = max(2 * MOST_WORDS, 3 * MOST_POINTS)


def within(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray, edits: int) -> np.ndarray:
    """Whether strings i and j (of ``length`` symbols from ``start`` on) are within so many edits, pair by pair.

    Columns of the edit table are kept as bit vectors of vertical differences, 2 * edits + 1 rows around
    the diagonal (Hyyrö, 2003); every step advances one column of all pairs.
    """
    out = np.zeros(len(i), bool)
    swap = length[i] > length[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    order = np.argsort(-length[j], kind="stable")
    at = 0
    while at < len(order):
        group = order[at : at + max(1, 2_000_000 // max(1, int(length[j[order[at]]])))]
        at += len(group)
        out[group] = _within(symbols, start, length, i[group], j[group], edits)
    return out


def _within(symbols, start, length, i, j, edits: int) -> np.ndarray:
    m, n = length[i], length[j]
    most, band = int(n.max()), 2 * edits + 1
    last = len(symbols) - 1
    column = lambda own, k: symbols[np.clip(start[own] + k, 0, last)]
    one, full = np.uint64(1), np.uint64((1 << band) - 1)
    bits = np.arange(band, dtype=np.uint64)
    vp = np.full(len(m), sum(1 << k for k in range(edits, band)), np.uint64)
    vn = np.zeros(len(m), np.uint64)
    score = np.full(len(m), edits, np.int64)
    live = len(m)
    # The shorter string's symbols in the band, and whether each row is inside the string.
    rows = [(column(i, k - edits), (k >= edits) & (k - edits < m)) for k in range(band - 1)]
    for at in range(1, most + 1):
        while live and n[live - 1] < at:  # longest first
            live -= 1
        s = slice(0, live)
        k = at - 1 + band - 1 - edits
        rows.append((column(i, k), k < m))
        symbol = column(j[s], at - 1)
        x = np.zeros(live, np.uint64)
        for b, (own, inside) in enumerate(rows):  # row at - edits + b of the shorter string
            x |= ((own[s] == symbol) & inside[s]).astype(np.uint64) << bits[b]
        rows.pop(0)
        v, w = vp[s], vn[s]
        d = ((((x & v) + v) ^ v) | x | w) & full
        hp = (w | ~(d | v)) & full
        hn = d & v
        below = at <= m[s] - edits
        row = np.maximum(m[s] - at + edits, 0).astype(np.uint64)
        edge = ((hp >> row) & one).astype(np.int64) - ((hn >> row) & one).astype(np.int64)
        score[s] += np.where(below, 1 - ((d >> np.uint64(band - 1)) & one).astype(np.int64), edge)
        vp[s] = (hn | ~((d >> one) | hp)) & full
        vn[s] = (d >> one) & hp
    return (score <= edits) & (n - m <= edits)


def _verified(batches):
    for batch in slices(batches, "text_a", 1_000_000):
        n = batch.num_rows
        s = _Symbols.of(pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]))
        bits = s.sketches()
        i = np.flatnonzero(np.bitwise_count(bits[:n] ^ bits[n:]).sum(1) <= MOST_FLIPS)
        i = i[s.near(i, i + n)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).take(pa.array(i))


class _Block:
    """Links of lines in blocks of long runs."""

    def __init__(self, table: pa.Table):
        self.lines = _Symbols.of(table.column("line_text").combine_chunks())
        self.bits = self.lines.sketches()
        self.roots, self.asks, self.member = (table.column(c).to_numpy() for c in ("root", "asks", "member"))

    def linked(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        near = np.flatnonzero(np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(1) <= MOST_FLIPS)
        out[near] = self.lines.near(i[near], j[near])
        return out

    def large(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links between components in the rows a to b."""
        bits, member = self.bits[a:b], self.member[a:b]

        def candidates(q: np.ndarray):
            flips = np.zeros((len(q), b - a), np.uint16)
            for k in range(4):
                flips += np.bitwise_count(bits[q, k][:, None] ^ bits[None, :, k])
            i, j = np.nonzero((flips <= MOST_FLIPS) & member)
            return q[i], j

        forest = _runs.spanning(self.roots[a:b], self.asks[a:b], candidates, lambda i, j: self.lines.near(a + i, a + j))
        return a + forest[:, 0], a + forest[:, 1]


def _fetched(batches):
    for batch in slices(batches):
        buf, ls, le, row, _, name, _, _ = _lines_of(batch.column("text"))
        asked = batch.column("names")
        own = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
        paired = lambda n, r: mix(n.astype(np.uint64) + mix(r.astype(np.uint64)))
        keep = np.flatnonzero(np.isin(paired(name, row), paired(asked.flatten().to_numpy(), own)))
        keep = keep[np.unique(name[keep], return_index=True)[1]]
        raw = buf.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(ls[keep].tolist(), le[keep].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(name[keep]), pa.array((le - ls)[keep]), pa.array(texts, pa.string())], names=["id", "weight", "line_text"])


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, lines): the numbers (from 0) of each document's lines that an earlier line makes a duplicate; ``NO_ID`` for a null doc_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES)
    places = texts.mapInArrow(_places(buckets), "bucket int, rows binary, again binary").repartition(buckets, "bucket")
    lines = written(places.mapInArrow(_named, "name long, doc_id long, line int, first boolean"), "lines")
    found = written(_runs.runs(texts.select("text").mapInArrow(_entries(buckets), _runs.PACKED), buckets, may_pair), "line-runs")
    pairs = written(found.where("not long").select("a", "b").distinct(), "line-pairs")
    # The texts of lines that met another, each from its first document.
    asked = pairs.select(F.explode(F.array("a", "b")).alias("name")).unionByName(found.where("long").select(F.col("a").alias("name"))).distinct()
    owners = lines.where("first").join(asked, "name").groupBy(F.col("doc_id").alias("owner")).agg(F.collect_list("name").alias("names"))
    wanted = texts.join(owners.hint("merge"), F.coalesce("doc_id", F.lit(int(NO_ID))) == F.col("owner")).select("text", "names")
    known = written(wanted.mapInArrow(_fetched, "id long, weight long, line_text string").dropDuplicates(["id"]), "met-lines")
    side = lambda c: known.select(F.col("id").alias(c), F.col("line_text").alias(f"text_{c}"))
    links = written(pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long"), "line-links", pairs)
    labels = components(links)
    rows = _runs.open_runs(found.where("long"), labels)
    more = written(_runs.by_group(_runs.crossing(rows, known), _Block).select("a", "b"), "more-line-links", found, known, rows)
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more))
    release(links, more)
    # Of a class all but its first line go; of lines without a near duplicate, all but the first of a name.
    near = lines.join(labels.withColumnRenamed("id", "name"), "name")
    keep = near.where("first").groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("keep"))
    kept = labels.withColumnRenamed("id", "name").join(keep, "root").select("name", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line"))
    here = (F.col("doc_id") == F.col("keep_doc")) & (F.col("line") == F.col("keep_line"))
    dropped = lines.join(kept, "name", "left").where(F.when(F.col("keep_doc").isNull(), ~F.col("first")).otherwise(~here))
    return dropped.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def _masks(batches):
    for batch in batches:
        rows = [np.array(x, np.int64) for x in batch.column("lines").to_pylist()]
        masks = [np.isin(np.arange(x.max() + 1), x) for x in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(masks, pa.list_(pa.bool_()))], names=["owner", "lost"])


def dedup_lines(docs: DataFrame, emptied: str = "keep") -> DataFrame:
    """``docs`` without duplicate lines; ``n_chars`` (if there is such a column) follows the text.

    ``emptied="drop"`` leaves out documents that lost their last line with a word.
    """
    drop = written(duplicate_lines(docs).mapInArrow(_masks, "owner long, lost array<boolean>"), "lost-lines")
    owner, lost = free_name(docs, "owner"), free_name(docs, "lost")
    joined = docs.join(drop.select(F.col("owner").alias(owner), F.col("lost").alias(lost)).hint("merge"), F.coalesce(docs["doc_id"].cast("long"), F.lit(int(NO_ID))) == F.col(owner), "left")
    left = F.array_join(F.filter(F.split(F.col("text"), "\n", -1), lambda x, k: ~F.coalesce(F.get(F.col(lost), k), F.lit(False))), "\n")
    changed = F.col(lost).isNotNull()
    text = F.when(changed, left).otherwise(F.col("text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias("text"))
        elif c == "n_chars":
            columns.append(F.when(changed, F.char_length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(docs[c])
    if emptied == "drop":
        joined = joined.where(~changed | left.rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*columns)
