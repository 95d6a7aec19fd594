"""Ids that share a key: packed entries are shuffled by bucket of the key, and each bucket yields pairs.

Entries travel as packed arrays, one row for a slice of documents and a bucket, so the shuffle moves
bytes, not rows. An entry is a key, whose lowest bits note the entry's role and size, and an id. A run is the entries
of one key. Short runs give all their pairs at once. A long run first gives stars (every id with the run's
``leaders``); after those links are known, ``crossing`` gives blocks of the long runs whose ids are not in
one component yet, so a large group of copies costs a star. Long runs of the same ids (a shared passage
has one for each of its words) count once.

A run that is long within one slice already is cut there: its star and its entries go to any bucket, and
only its leader goes to the key's. So the entries of one key that meet in a task grow with the number of
slices, however many ids hold the key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._text import mix, trim

#: A run up to this size gives all its pairs at once.
SHORT = 4
#: Entries of one key that a slice sends to the key's bucket; beyond that it cuts the run.
LOCAL = 32
#: Side of the blocks in which the pairs of a long run are formed: ids, and bytes of what comes with them.
BLOCK, BLOCK_BYTES = 8192, 8_000_000
#: Groups of so many rows have all their pairs judged, many groups at a time.
SMALL = 32
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8")])
_OF_SETS = 0x3C6EF372FE94F82B
CUT = np.dtype([("key", "<u8"), ("id", "<i8"), ("leader", "<i8")])
PACKED = "bucket int, entries binary, cut binary"
FOUND = "long boolean, key long, a long, b long"
#: The low bits of a key: the entry's role, that a slice cut its run, and eight bits that the caller may use.
ROLE, IS_CUT, NOTE, LOW = np.uint64(1), np.uint64(2), np.uint64(2), np.uint64(1023)


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _place(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row for each bucket that has entries."""
    order = np.argsort(keys, kind="stable")
    e = np.empty(len(keys), ENTRY)
    e["key"], e["id"] = keys[order], ids[order]
    start = _starts(e["key"] | LOW)
    count = np.diff(np.append(start, len(e)))
    cuts = [np.zeros(0, CUT)]
    if len(count) and count.max() > LOCAL:
        keep = np.ones(len(e), bool)
        for r in np.flatnonzero(count > LOCAL).tolist():
            run = slice(start[r], start[r] + count[r])
            own = np.empty(count[r], CUT)
            own["key"], own["id"] = e["key"][run] | LOW, e["id"][run]
            lead = int(mix(own["id"].astype(np.uint64)).argmin())
            own["leader"] = own["id"][lead]
            keep[run] = False
            keep[start[r] + lead] = True
            e["key"][start[r] + lead] |= IS_CUT
            cuts.append(own)
        e = e[keep]
    cut = np.concatenate(cuts)
    to = (mix(cut["id"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    by_place = np.argsort(to, kind="stable")
    cut, to = cut[by_place], to[by_place]
    place = _place(e["key"], buckets)
    every = np.unique(np.concatenate([place, to]))
    a, b = np.searchsorted(place, every), np.searchsorted(place, every, "right")
    c, d = np.searchsorted(to, every), np.searchsorted(to, every, "right")
    return pa.RecordBatch.from_arrays(
        [pa.array(every.astype(np.int32)), pa.array([e[i:j].tobytes() for i, j in zip(a, b)], pa.binary()), pa.array([cut[i:j].tobytes() for i, j in zip(c, d)], pa.binary())],
        names=["bucket", "entries", "cut"],
    )


def _batch(long: bool, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), long)), pa.array(key.astype(np.int64)), pa.array(a), pa.array(b)], names=["long", "key", "a", "b"])


def _bucket(may_pair: Callable, leaders: int):
    def run(batches):
        parts, cuts = [np.zeros(0, ENTRY)], [np.zeros(0, CUT)]
        for batch in batches:
            parts.extend(np.frombuffer(x, ENTRY) for x in batch.column("entries").to_pylist())
            cuts.extend(np.frombuffer(x, CUT) for x in batch.column("cut").to_pylist())
        e, cut = np.concatenate(parts), np.concatenate(cuts)
        parts.clear()
        cuts.clear()
        if len(cut):
            none = np.zeros(len(cut), np.int64)
            yield _batch(True, cut["key"], cut["id"].copy(), none)
            ok = cut["id"] != cut["leader"]
            yield _batch(False, none[ok], np.minimum(cut["id"], cut["leader"])[ok], np.maximum(cut["id"], cut["leader"])[ok])
        # A key's entries together, each id once with all its roles, and only keys with two ids or more, of which one has the role.
        order = np.lexsort((e["id"], e["key"] | LOW))
        e = e[order]
        del order
        key = e["key"] | LOW
        if len(e):
            once = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (e["id"][1:] != e["id"][:-1])]))
            flags = np.bitwise_or.reduceat(e["key"] & (ROLE | IS_CUT), once)
            e, key = e[once], key[once]
            e["key"] |= flags
            start = _starts(key)
            size = np.diff(np.append(start, len(e)))
            flags = np.bitwise_or.reduceat(e["key"], start)
            good = np.repeat((size > 1) & ((flags & (ROLE | IS_CUT)) > 0), size)
            e, key = e[good], key[good]
        start = _starts(key)
        count = np.diff(np.append(start, len(e)))
        is_cut = np.bitwise_or.reduceat(e["key"] & IS_CUT, start) > 0 if len(e) else np.zeros(0, bool)
        seen: list[np.ndarray] = []

        def pairs(i: np.ndarray, j: np.ndarray) -> None:
            ok = (e["id"][i] != e["id"][j]) & may_pair(e["key"], i, j)
            i, j = i[ok], j[ok]
            if len(i):
                seen.append(np.unique(np.stack([np.minimum(e["id"][i], e["id"][j]), np.maximum(e["id"][i], e["id"][j])], 1), axis=0))

        short = (count > 1) & (count <= SHORT) & ~is_cut
        for k in np.unique(count[short]).tolist():
            first = start[short & (count == k)]
            x, y = np.triu_indices(k, 1)
            step = max(1, 500_000 // len(x))
            for at in range(0, len(first), step):
                own = first[at : at + step, None]
                pairs((own + x).ravel(), (own + y).ravel())
        # Long runs, those of the same ids once. A run's ids are sorted.
        long = np.flatnonzero((count > SHORT) | is_cut)
        if len(long):
            mixed = mix(e["id"].astype(np.uint64))
            name = mix(np.add.reduceat(mix(mixed + np.uint64(_OF_SETS)), start)[long] + count[long].astype(np.uint64)) & ~LOW
            name = np.where(is_cut[long], key[start[long]], name)
            name, first = np.unique(name, return_index=True)
            long = long[first]
            step = np.cumsum(count[long]) // 200_000
            for part in range(int(step[-1]) + 1):
                own = long[step == part]
                if not len(own):
                    continue
                n = count[own]
                begin = np.cumsum(n) - n
                rows = np.arange(int(n.sum())) + np.repeat(start[own] - begin, n)
                # Leaders by orders that all runs share, so that a group's runs agree on them.
                least = np.repeat(np.minimum.reduceat(mixed[rows], begin), n)
                for lead in (rows[mixed[rows] == least], start[own], start[own] + n - 1)[:leaders]:
                    pairs(np.repeat(lead, n), rows)
                yield _batch(True, np.repeat(name[step == part], n), e["id"][rows], e["id"][rows])
        if seen:
            every = np.unique(np.concatenate(seen), axis=0)
            for at in range(0, len(every), 100_000):
                part = every[at : at + 100_000]
                yield _batch(False, np.zeros(len(part), np.int64), part[:, 0].copy(), part[:, 1].copy())
        del e, key, seen
        trim()

    return run


def runs(entries: DataFrame, buckets: int, may_pair: Callable, leaders: int = 1) -> DataFrame:
    """Pairs (long = false: a, b) and the ids of long runs (long = true: key, or a name of the run's ids, and a) of packed entries.

    ``may_pair(keys, i, j)`` says for arrays of places which pairs can link at all.
    """
    return entries.repartition(buckets, "bucket").mapInArrow(_bucket(may_pair, leaders), FOUND)


#: Parts of a run in joins by key, so that no task gets all ids of one run.
SALTS = 8


def _with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of runs joined to what is known of each key."""
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def open_runs(long: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, root, main of the long runs whose ids are in two components or more; ``main`` is the commonest of a run.

    ``labels`` has (id, root) of ids with links.
    """
    rows = long.select("key", F.col("a").alias("id")).distinct().join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = written(rows, "long-runs")
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    spread = counts.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", "n").alias("main")).where("roots > 1")
    return written(_with_keys(rows, spread.select("key", "main")), "open-runs", rows)


def crossing(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Blocks of open runs, with the columns of ``extra`` (by id, with their ``weight`` in bytes).

    Ids outside a run's commonest component ask for partners among all ids of the run. Both are dealt into blocks
    of at most about ``BLOCK`` ids and ``BLOCK_BYTES``, and each pair of blocks is a group of its own (key, asking,
    asked), so no group grows with its run, and a run of copies costs its outliers.
    """
    rows = rows.join(extra.select("id", "weight"), "id").withColumn("ask", F.col("root") != F.col("main"))
    count = lambda of: (F.sum(F.when(of, 1).otherwise(0)), F.sum(F.when(of, F.col("weight")).otherwise(0)))
    dealt = rows.groupBy("key").agg(blocks(*count(F.col("ask"))).alias("askings"), blocks(*count(F.lit(True))).alias("askeds"))
    return copies(_with_keys(rows.drop("weight", "main"), dealt).join(extra.drop("weight"), "id"))


def blocks(n: Column, weight: Column) -> Column:
    """Into how many blocks so many ids and bytes are dealt."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(weight / BLOCK_BYTES), F.lit(1)).cast("int")


def copies(rows: DataFrame) -> DataFrame:
    """Blocks of rows (key, id, root, ask, askings, askeds, ...) whose runs are dealt: each row once for each block that it is in."""
    own = F.pmod(F.xxhash64("id"), F.col("askings")).cast("int")
    at = F.pmod(F.xxhash64("id", F.lit(1)), F.col("askeds")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    member = F.transform(every("askings"), lambda i: F.struct(i.alias("asking"), at.alias("asked"), (F.col("ask") & (i == own)).alias("asks"), F.lit(True).alias("member")))
    asker = F.transform(F.filter(every("askeds"), lambda j: j != at), lambda j: F.struct(own.alias("asking"), j.alias("asked"), F.lit(True).alias("asks"), F.lit(False).alias("member")))
    extra = [c for c in rows.columns if c not in ("key", "id", "root", "ask", "askings", "askeds")]
    rows = rows.withColumn("copy", F.explode(F.concat(member, F.when(F.col("ask"), asker).otherwise(F.array().cast(_COPIES)))))
    return rows.select("key", "copy.asking", "copy.asked", "copy.asks", "copy.member", "root", "id", *extra)


_COPIES = "array<struct<asking:int,asked:int,asks:boolean,member:boolean>>"
GROUP = ("key", "asking", "asked")


def by_group(blocks: DataFrame, judge: Callable) -> DataFrame:
    """(a, b, key, asking, asked): pairs of ids that ``judge`` links in each group of blocks, group after group within sorted partitions.

    ``judge`` is made of a table of whole groups. Its ``linked(i, j)`` tells for arrays of rows which pairs link; all pairs of
    small groups are put to it together. Its ``large(a, b)`` gives the pairs of the one group in rows a to b, or None to leave the group
    to the caller: it then comes as a row without ids. So do the groups of the rows that it notes in ``unfinished``, if it has that.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, size, last = 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in GROUP], 1)
            cut = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                now = tuple(keys[a])
                if now != last and (rows > 2000 or size > BLOCK_BYTES):
                    yield from _pairs(pa.Table.from_batches(held).combine_chunks(), judge)
                    held, rows, size = [], 0, 0
                last = now
                held.append(batch.slice(a, b - a))
                rows, size = rows + b - a, size + held[-1].nbytes
        if held:
            yield from _pairs(pa.Table.from_batches(held).combine_chunks(), judge)
        trim()

    return blocks.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "a long, b long, key long, asking int, asked int").distinct()


def _pairs(table: pa.Table, judge: Callable):
    own = judge(table)
    keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in GROUP], 1)
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    size = np.diff(np.append(start, len(keys)))
    roots, asks, member, ids = (table.column(c).to_numpy() for c in ("root", "asks", "member", "id"))
    found, left = [], []
    for a, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        pairs = own.large(a, a + n)
        if pairs is None:
            left.append(keys[a])
        else:
            found.append(pairs)
    first, n = np.repeat(start, size), np.repeat(size, size)
    asking = np.flatnonzero(asks & (n <= SMALL))
    for at in range(0, len(asking), 10_000):
        q = asking[at : at + 10_000]
        i = np.repeat(q, n[q])
        j = np.repeat(first[q], n[q]) + np.arange(len(i)) - np.repeat(np.cumsum(n[q]) - n[q], n[q])
        ok = member[j] & (roots[i] != roots[j]) & ~(asks[j] & member[i] & (j < i))
        i, j = i[ok], j[ok]
        ok = own.linked(i, j)
        found.append((i[ok], j[ok]))
    left.extend(keys[a] for a in getattr(own, "unfinished", ()))
    a, b = (ids[np.concatenate([f[side] for f in found])] if found else np.zeros(0, np.int64) for side in (0, 1))
    names, none = ["a", "b", *GROUP], pa.nulls(len(a), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none.cast(pa.int32()), none.cast(pa.int32())], names=names)
    if left:
        own, none = np.array(left), pa.nulls(len(left), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(own[:, 0]), *(pa.array(own[:, k].astype(np.int32)) for k in (1, 2))], names=names)


class Forest:
    """Components of the places 0 to n - 1, of which some are joined from the start; ``edges`` are the links that joined more."""

    def __init__(self, roots: np.ndarray):
        _, self.label = np.unique(roots, return_inverse=True)
        self.edges: list[tuple[int, int]] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        both = np.stack([self.label[i], self.label[j]], 1)
        both, first = np.unique(both, axis=0, return_index=True)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        for (x, y), at in zip(both.tolist(), first.tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                self.edges.append((int(i[at]), int(j[at])))
        if parent:
            to = np.arange(self.label.max() + 1)
            for x in parent:
                to[x] = find(x)
            self.label = to[self.label]


def spanning(roots: np.ndarray, asks: np.ndarray, candidates: Callable, linked: Callable) -> np.ndarray:
    """A spanning forest of the links in a block, as pairs of places: at most one less than there are places.

    ``candidates(q)`` gives arrays (i in q, j) that may link, ``linked(i, j)`` decides. Places that ask are
    taken a few at first, then more at a time, and only pairs of different components are decided, so a
    block of copies costs little more than one row of pairs.
    """
    forest, places = Forest(roots), np.flatnonzero(asks)
    at, step = 0, 1
    while at < len(places):
        i, j = candidates(places[at : at + step])
        for begin in range(0, len(i), 200_000):
            p, q = i[begin : begin + 200_000], j[begin : begin + 200_000]
            ok = forest.label[p] != forest.label[q]
            p, q = p[ok], q[ok]
            if len(p):
                good = linked(p, q)
                forest.join(p[good], q[good])
        at, step = at + step, min(64, step * 2)
    return np.array(forest.edges, np.int64).reshape(-1, 2)
