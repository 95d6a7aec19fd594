"""Operator 5: n-gram Jaccard self-join with count-vector R-trees.

A document's set is its distinct five-word shingles, as 64-bit hashes. Equal sets form a class (named by
a 64-bit hash of the set), and only classes are joined. Shingles are hashed into ``GROUPS`` groups and a
set's group counts are a point; the sum of the smaller coordinates of two points, or of a point and the
upper corner of a box, bounds the overlap of the sets from above.

1. Every class sends the first shingles of its set, in one global order in which the shingles that many
   documents share come last: two sets that reach the threshold share one of them. Classes that share
   one meet (``_runs``).
2. Pairs from short runs, and stars of long runs, whose points allow the overlap are verified on the sets.
3. Long runs that still span components are dealt into blocks; in each an R-tree over the points is
   searched for pairs of different components that the bound allows. These are verified too: first
   the nearest partner of each class, then, on new blocks of what is still open, all. Where the bound allows
   so many pairs that sending them would cost the square of a group, the block's sets are sent and counted there.

So no link between different texts is lost, and a large group of near copies costs a star.

To be verified, a class sends its set to its partner: partners gather under the one of them that hashes lowest,
and those with many are dealt over several tasks.

Defined cases: null and empty texts, and texts without words, have the empty set and link with nothing;
texts under five words have their whole sequence as one shingle; rows are told apart by doc_id and text, so
rows that share a doc_id, or have none, keep their own sets and links, and equal texts share a component; the component of
rows without doc_id is the least doc_id that they reach, or null; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _runs
from ._graph import components
from ._shared import free_name, release, written
from ._text import ASCII_LOWER, mix, slices, span_hashes, text_buffer, trim, windows, word_spans

SHINGLE, PER_CENT = 5, 75
GROUPS = 256
#: A shingle that so many documents of a slice hold is reported; so many of the most reported are put last in the order.
HEAVY_DOCS, HEAVY = 4, 50_000
#: Entries in a bucket, about.
BUCKET_ENTRIES = 2_000_000
#: Sets that one task compares with a partner of theirs.
PARTNERS = 5_000
#: Pairs for each class of a block from which on the block's sets are sent, and not its pairs.
DENSE = 8
NODE = 16


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    buf, off = text_buffer(column)
    starts, ends, first = word_spans(buf, off)
    hashes = span_hashes(ASCII_LOWER[buf], starts, ends)
    every = windows(hashes, SHINGLE)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(every[a : b - SHINGLE + 1]))
        else:
            out.append(windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def class_ids(sets: list[np.ndarray]) -> list[int | None]:
    """A 64-bit name for each set: a hash of its size, its sum and the sum of its mixed members. The empty set has none."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    out: list[int | None] = [None] * len(sets)
    if len(full):
        flat = np.concatenate([sets[k] for k in full.tolist()])
        first = np.cumsum(size[full]) - size[full]
        plain = np.add.reduceat(flat, first) + size[full].astype(np.uint64)
        mixed = np.add.reduceat(mix(flat + np.uint64(0x51ED27)), first)
        for k, name in zip(full.tolist(), mix(mix(plain) + mixed).astype(np.int64).tolist()):
            out[k] = name
    return out


def point(shingles: np.ndarray) -> bytes:
    """Group counts of a set, a byte each. There are ``GROUPS`` groups, for large sets as many times more as keep every count within a byte and the mean within four."""
    bits = 8
    while True:
        counts = np.bincount((shingles >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if len(shingles) <= 4 << bits and counts.max() < 256:
            return counts.astype(np.uint8).tobytes()
        bits += 1


def points_of(column) -> np.ndarray:
    """Packed points as rows of a matrix of ``GROUPS`` counts: finer groups are summed."""
    rows = column.to_pylist()
    size = np.array([len(r) for r in rows], np.int64)
    out = np.zeros((len(rows), GROUPS), np.uint32 if (size > GROUPS).any() else np.uint8)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        counts = np.frombuffer(b"".join(rows[k] for k in own.tolist()), np.uint8).reshape(len(own), GROUPS, n // GROUPS)
        out[own] = counts[:, :, 0] if n == GROUPS else counts.sum(2, dtype=np.int64)
    return out.astype(np.uint16) if out.dtype == np.uint32 and out.max() < 1 << 16 else out


def finer_bound(a: bytes, b: bytes) -> int:
    """The bound of two points in the finest groups that both have."""
    p, q = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(p), len(q))
    p, q = (x if len(x) == n else x.reshape(n, -1).sum(1, dtype=np.int64) for x in (p, q))
    return int(np.minimum(p, q).sum(dtype=np.int64))


def needed(m, n):
    """The least overlap with which sets of m and n members reach the threshold."""
    return -(-PER_CENT * (m + n) // (100 + PER_CENT))


def _describe(batches):
    """A row for each document, and the shingles that many of a slice's documents hold."""
    names = ["doc_id", "row", "n_shingles", "class", "point", "heavy", "n"]
    for batch in slices(batches):
        sets = shingle_sets(batch.column("text"))
        kinds = class_ids(sets)
        none = pa.nulls(len(sets), pa.int64())
        points = pa.array([point(s) if len(s) else None for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array(kinds, pa.int64()), points, none, none], names=names)
        distinct = {k: s for k, s in zip(kinds, sets) if k is not None}
        if distinct:
            values, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            values, counts = values[counts >= HEAVY_DOCS], counts[counts >= HEAVY_DOCS]
            none = pa.nulls(len(values), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(values), pa.binary()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=names)


def first_members(shingles: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The members of a set that a partner must share one of, in the global order, and how many of them suffice towards larger partners.

    ``heavy`` is sorted; ``rank`` is the place of each of its values in the order, after all others.
    """
    n = len(shingles)
    most = n + 1 - -(-PER_CENT * n // 100)
    if len(heavy):
        i = np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)
        late = heavy[i] == shingles
        if late.any():
            last = shingles[late]
            shingles = np.concatenate([shingles[~late], last[np.argsort(rank[i[late]])]])
    return shingles[:most], n + 1 - needed(n, n)


#: Sizes are noted in a key by eight bits: steps of a twentieth.
_STEP = np.log(1.05)
_APART = int(np.log(100 / PER_CENT) / _STEP) + 1


def _entries(heavy: np.ndarray, rank: np.ndarray, buckets: int):
    def run(batches):
        for batch in slices(batches, most=3_000_000):
            sets = shingle_sets(batch.column("text"))
            distinct = {k: s for k, s in zip(class_ids(sets), sets) if k is not None}
            keys, ids = [], []
            for k, s in distinct.items():
                own, few = first_members(s, heavy, rank)
                size = min(255, int(np.log(len(s)) / _STEP))
                own = mix(own) & ~_runs.LOW | np.uint64(size << int(_runs.NOTE))  # mixed, as the first of a sorted set lie close together
                own[:few] |= _runs.ROLE
                keys.append(own)
                ids.append(np.full(len(own), k, np.int64))
            if keys:
                yield _runs.packed(np.concatenate(keys), np.concatenate(ids), buckets)

    return run


def may_pair(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes within the threshold, and the shared shingle among the few of the smaller set (of either where the noted sizes are equal)."""
    size = ((keys & _runs.LOW) >> _runs.NOTE).astype(np.int64)
    role = (keys & _runs.ROLE) > 0
    m, n = size[i], size[j]
    few = np.where(m < n, role[i], np.where(n < m, role[j], role[i] | role[j]))
    return (np.abs(m - n) <= _APART) & few


def tree_pairs(points: np.ndarray, sizes: np.ndarray, allowed, asked: np.ndarray | None = None) -> np.ndarray:
    """Pairs (i < j) of points that a count-vector R-tree cannot rule out; with ``asked`` (a mask) those with an asked point.

    The tree is packed by sort-tile: by size, then by the coordinates of largest spread. A point searches
    it from the root: a box whose upper corner bounds the overlap below what its smallest size needs, or
    whose sizes are out of range, is left out; ``allowed(i, j)`` filters the points that remain.
    """
    n = len(points)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    spread = np.argsort(-points.std(0))[:3]
    order = np.lexsort((points[:, spread[-1]], points[:, spread[0]], sizes // np.maximum(1, sizes.max() // 16 or 1)))
    levels = [(points[order], sizes[order], sizes[order])]
    while len(levels[-1][0]) > NODE:
        up, low, high = levels[-1]
        at = np.arange(0, len(up), NODE)
        levels.append((np.maximum.reduceat(up, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))
    out = [np.zeros((0, 2), np.int64)]
    asking = np.ones(n, bool) if asked is None else asked[order]
    places = np.flatnonzero(asking)
    for begin in range(0, len(places), 256):
        q = places[begin : begin + 256]
        top = len(levels) - 1
        qi, node = (x.ravel() for x in np.meshgrid(q, np.arange(len(levels[top][0])), indexing="ij"))
        for level in range(top, -1, -1):
            up, low, high = levels[level]
            size = sizes[order[qi]]
            ok = (100 * np.minimum(size, high[node]) >= PER_CENT * np.maximum(size, low[node]))
            qi, node = qi[ok], node[ok]
            bound = np.empty(len(qi), np.int64)
            for k in range(0, len(qi), 50_000):
                bound[k : k + 50_000] = np.minimum(levels[0][0][qi[k : k + 50_000]], up[node[k : k + 50_000]]).sum(1, dtype=np.int64)
            ok = bound >= needed(sizes[order[qi]], low[node])
            qi, node = qi[ok], node[ok]
            if level:
                below = len(levels[level - 1][0])
                child = (node[:, None] * NODE + np.arange(NODE)).ravel()
                qi = np.repeat(qi, NODE)
                qi, node = qi[child < below], child[child < below]
        ok = (node > qi) | ~asking[node]  # a pair of two asked points once
        i, j = order[qi[ok]], order[node[ok]]
        good = allowed(i, j)
        out.append(np.stack([np.minimum(i, j)[good], np.maximum(i, j)[good]], 1))
    return np.concatenate(out)


class _Bound:
    """Which pairs of points allow the overlap that their sizes need: in ``GROUPS`` groups, and then in finer ones where both have them."""

    def __init__(self, points: pa.Array, sizes: np.ndarray):
        self.points, self.sizes = points_of(points), sizes
        self.finer = {k: p.as_buffer() for k, p in enumerate(points) if len(p.as_buffer()) > GROUPS}

    def spare(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The bound of each pair as a part of what it needs; 0 if the sizes forbid a link."""
        m, n = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        out = np.zeros(len(i))
        own = np.flatnonzero(100 * m >= PER_CENT * n)
        for at in range(0, len(own), 20_000):
            part = own[at : at + 20_000]
            out[part] = np.minimum(self.points[i[part]], self.points[j[part]]).sum(1, dtype=np.int64) / needed(m[part], n[part])
        for k in np.flatnonzero(out >= 1).tolist() if self.finer else []:
            a, b = self.finer.get(int(i[k])), self.finer.get(int(j[k]))
            if a is not None and b is not None:
                out[k] = finer_bound(a, b) / needed(m[k], n[k])
        return out


class _Tree(_Bound):
    """Pairs of classes in blocks of long runs that the bound of their points allows; or of each class that asks the nearest partner."""

    def __init__(self, table: pa.Table, nearest: bool):
        super().__init__(table.column("point").combine_chunks(), table.column("size").to_numpy())
        self.nearest = nearest
        self.roots, self.asks, self.member = (table.column(c).to_numpy() for c in ("root", "asks", "member"))

    def linked(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        spare = self.spare(i, j)
        out = spare >= 1
        if self.nearest and out.any():
            # Rows of different groups are different places, so the best of each place is the best in its group.
            order = np.flatnonzero(out)
            order = order[np.argsort(-spare[order], kind="stable")]
            best = np.zeros(len(i), bool)
            for side in (i, j):
                best[order[np.unique(side[order], return_index=True)[1]]] = True
            out &= best
        return out

    def large(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        roots, asks, member = self.roots[a:b], self.asks[a:b], self.member[a:b]

        def allowed(i, j):
            return (roots[i] != roots[j]) & (asks[i] & member[j] | asks[j] & member[i])

        found = a + tree_pairs(self.points[a:b], self.sizes[a:b], allowed, asks)
        found = found[self.linked(found[:, 0], found[:, 1])]
        return (found[:, 0], found[:, 1]) if len(found) <= DENSE * (b - a) else None


class _Dense:
    """Links of classes in blocks where the bound allows very many pairs: overlaps are counted on the sets themselves."""

    def __init__(self, table: pa.Table):
        self.sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members").combine_chunks()]
        self.roots, self.asks, self.member = (table.column(c).to_numpy() for c in ("root", "asks", "member"))

    def linked(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.array([similar(self.sets[x], self.sets[y]) for x, y in zip(i.tolist(), j.tolist())], bool)

    def large(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the links between components in the rows a to b, by the lists of rows that hold each shingle."""
        size = np.array([len(s) for s in self.sets[a:b]])
        _, shingle = np.unique(np.concatenate(self.sets[a:b]), return_inverse=True)
        first = np.cumsum(size) - size
        holders = np.repeat(np.arange(b - a), size)[np.argsort(shingle, kind="stable")]
        count = np.bincount(shingle)
        at = np.cumsum(count) - count
        member = self.member[a:b]

        def candidates(q: np.ndarray):
            i, j = [], []
            for x in q.tolist():
                own = shingle[first[x] : first[x] + size[x]]
                n = count[own]
                rows = holders[np.arange(int(n.sum())) + np.repeat(at[own] - (np.cumsum(n) - n), n)]
                both = np.bincount(rows, minlength=b - a)
                near = np.flatnonzero(member & (100 * both >= PER_CENT * (size[x] + size - both)))
                i.append(np.full(len(near), x))
                j.append(near)
            return np.concatenate(i), np.concatenate(j)

        forest = _runs.spanning(self.roots[a:b], self.asks[a:b], candidates, lambda i, j: np.ones(len(i), bool))
        return a + forest[:, 0], a + forest[:, 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= PER_CENT * (len(a) + len(b) - both)


def _allowed(batches):
    """The pairs whose points allow a link."""
    for batch in batches:
        n = batch.num_rows
        both = _Bound(pa.concat_arrays([batch.column("point_a"), batch.column("point_b")]), np.concatenate([batch.column(c).to_numpy() for c in ("size_a", "size_b")]))
        ok = both.spare(np.arange(n), np.arange(n) + n) >= 1
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))
    trim()


def _fetch(batches):
    """The sets of the asked classes of each document."""
    for batch in slices(batches, most=3_000_000):
        sets, asked = shingle_sets(batch.column("text")), batch.column("asked")
        own = np.repeat(np.arange(len(sets)), np.diff(asked.offsets.to_numpy()))
        items = asked.flatten()
        kinds = np.array([k or 0 for k in class_ids(sets)], np.int64)
        keep = np.flatnonzero(items.field("class").to_numpy() == kinds[own])
        yield own[keep], items.take(pa.array(keep)), sets


def _fetch_members(batches):
    for own, items, sets in _fetch(batches):
        for at in range(0, len(own), 500):
            part = items.slice(at, 500)
            members = pa.array([sets[k].tobytes() for k in own[at : at + 500]], pa.binary())
            yield pa.RecordBatch.from_arrays([part.field("leader"), part.field("salt"), part.field("class"), members], names=["leader", "salt", "class", "members"])


def _overlapping(batches):
    """Links of each leader with its partners; rows come by leader and salt, the leader's own set first."""
    now = lead = None
    for batch in batches:
        a, b = [], []
        leaders, salts, classes = (batch.column(c).to_pylist() for c in ("leader", "salt", "class"))
        for k, x in enumerate(batch.column("members")):
            group, own = (leaders[k], salts[k]), np.frombuffer(x.as_buffer(), np.uint64)
            if group != now and classes[k] == leaders[k]:
                now, lead = group, own.copy()
            if group != now or classes[k] == leaders[k]:
                continue
            if similar(lead, own):
                a.append(leaders[k])
                b.append(classes[k])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    trim()


def _asking(texts: DataFrame, asked: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents of the asked classes, with what is asked (the columns of ``asked``: class, ...) as a list."""
    lists = asked.join(classes.select("class", "rep"), "class").groupBy("rep").agg(F.collect_list(F.struct(*asked.columns)).alias("asked"))
    return texts.join(lists.hint("merge"), F.col("row") == F.col("rep")).select("text", "asked")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold. Each pair's class of higher hash sends its set to the other."""
    swap = F.xxhash64("a") > F.xxhash64("b")
    pairs = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("leader"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("class"))
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    own = salts.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("class"))
    partners = pairs.join(salts, "leader").select("leader", F.pmod(F.xxhash64("class"), F.col("salts")).cast("int").alias("salt"), "class")
    sets = _asking(texts, partners.unionByName(own), classes).mapInArrow(_fetch_members, "leader long, salt int, class long, members binary")
    first = F.col("class") != F.col("leader")
    grouped = sets.repartition("leader", "salt").sortWithinPartitions("leader", "salt", first, "class")
    return written(grouped.mapInArrow(_overlapping, "a long, b long"), "links")


def _open(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that lie between two components."""
    side = lambda c: labels.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    rooted = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return rooted.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _joined(pairs: DataFrame, labels: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``labels`` with the components that verified pairs join."""
    now = written(_open(pairs, labels), "open-pairs")
    links = _verified(now, texts, classes)
    return components(labels.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links), links, now)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    described = written(texts.mapInArrow(_describe, "doc_id long, row long, n_shingles long, class long, point binary, heavy long, n long"), "described")
    known = described.where("n_shingles is not null").select("doc_id", "row", "n_shingles", "class")
    # The order: shingles reported by many slices last. Any order is exact; this one keeps runs short.
    heavy = described.where("heavy is not null").groupBy("heavy").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "heavy").limit(HEAVY).collect()
    values = np.array([r["heavy"] for r in heavy], np.int64).astype(np.uint64)
    by_value = np.argsort(values)
    values, rank = values[by_value], np.argsort(np.argsort([r["n"] for r in heavy], kind="stable"))[by_value] if len(heavy) else np.zeros(0, np.int64)
    classes = known.where("class is not null").groupBy("class").agg(F.min("row").alias("rep"), F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    classes = written(classes, "classes")
    total = classes.agg(F.coalesce(F.sum(F.col("size") / 4 + 1), F.lit(0)).cast("long")).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ENTRIES)

    found = written(_runs.runs(texts.mapInArrow(_entries(values, rank, buckets), _runs.PACKED), buckets, may_pair, leaders=3), "runs")
    pairs = found.where("not long").select("a", "b").distinct()
    met = pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(found.where("long").select(F.col("a").alias("class"))).distinct()
    rep = classes.join(met, "class").select("class", "rep", "size")
    of_rep = described.where("class is not null").select(F.col("class").alias("id"), "row", "point").join(rep, (F.col("id") == F.col("class")) & (F.col("row") == F.col("rep")))
    points = written(of_rep.select("id", "size", (8 * F.col("size")).alias("weight"), "point").dropDuplicates(["id"]), "points")
    side = lambda c: points.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("point").alias(f"point_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "size_a", "size_b", "point_a", "point_b").mapInArrow(_allowed, "a long, b long")
    labels = _joined(near, spark.range(0).select("id", F.col("id").alias("root")), texts, classes)
    long = found.where("long").select("key", "a")
    for nearest in (True, False):
        rows = _runs.open_runs(long, labels)
        more = written(_runs.by_group(_runs.crossing(rows, points), lambda table, nearest=nearest: _Tree(table, nearest)), "more-pairs")
        pairs = more.where("a is not null").select("a", "b")
        if not pairs.isEmpty():
            labels = _joined(pairs, labels, texts, classes)
        dense = more.where("a is null").select(*_runs.GROUP)
        if not dense.isEmpty():
            blocks = written(_runs.crossing(rows, points.select("id", "weight")).join(dense, list(_runs.GROUP)), "dense-blocks")
            sent = blocks.select(F.col("id").alias("class")).distinct().select(F.lit(0).cast("long").alias("leader"), F.lit(0).alias("salt"), "class")
            sets = _asking(texts, sent, classes).mapInArrow(_fetch_members, "leader long, salt int, class long, members binary").select(F.col("class").alias("id"), "members")
            links = written(_runs.by_group(blocks.join(sets.dropDuplicates(["id"]), "id"), _Dense).select("a", "b"), "links", blocks)
            labels = components(labels.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links), links)
        release(rows, more)
    named = classes.join(labels.withColumnRenamed("id", "class"), "class", "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(smallest, "root").select("class", "component_id")
    linked = known.where("class is not null").join(of_class, "class").select("doc_id", "n_shingles", "component_id")
    out = linked.unionByName(known.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    release(found, points)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest doc_id; all columns stay, whatever their names.

    Rows without a doc_id stay. Among rows that share a kept doc_id all stay.
    """
    name = free_name(docs, "other")
    found = written(jaccard_components(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "others")
    return docs.join(found, docs["doc_id"].cast("long") == found[name], "left_anti")
