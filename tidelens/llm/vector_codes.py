"""Operator 12: product codes of vectors by Lloyd rounds over cover trees.

Vectors become integers, ``floor(SCALE * x)``, and are cut into ``PARTS`` equal parts; each part position has a codebook of
``ENTRIES`` entries, begun with the vectors of smallest vec_id.

Trees are built once, in the partitions that hold the vectors: a chunk of vectors gets a cover tree for each part, whose
points are put in the tree's order, so that a subtree is a range of them, and cumulative sums give the sum of a range. They
are written to the shared folder. A round walks every tree from its root with the whole codebook. At a node with centre c
and radius r, an entry whose distance from c exceeds the nearest entry's by more than 2 r cannot be nearest to any point
below (triangle inequality) and is left out; where one entry is left, the range goes to it as a whole, and only the others
descend, at the leaves to exact comparisons of their points. A task sends sums and counts of its entries, so a round
gathers ``ENTRIES`` numbers a component, however many vectors there are.

Distances are exact: integers in float64 where they fit, in int64 otherwise. The triangle inequality is applied with a margin above
the error of square roots, so it never decides a tie.

Defined cases: vectors that are null or hold null or non-finite components are dropped, and so are those whose length is
not the first vector's (the smallest vec_id of a length that ``PARTS`` divides); rows without vec_id are coded, and come
last in the order that begins the codebooks; rows of one vec_id are coded each and ordered by their vectors; with fewer vectors
than ``ENTRIES`` there are as many entries as vectors; null labels are one label; extra columns are ignored; an empty
table gives no rows. Components whose squared distances pass 62 bits (from 2 ** 17 on at 64 components) raise an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import release, written
from ._text import trim

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors and bytes of integers in a chunk.
CHUNK, CHUNK_BYTES = 4096, 4_000_000
#: Points from which on a node is split; the ratio of the radii of a node and its children.
LEAF, BASE = 8, 1.3
TREES = "ids array<bigint>, labels array<string>, parts array<struct<place: binary, points: binary, nodes: binary, radii: binary>>"
CODES = "vec_id bigint, code string, error bigint, label string"


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every point from every entry, exact."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    if most * most * points.shape[1] * 4 < 1 << 53:
        p, b = points.astype(np.float64), book.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (p @ b.T)).astype(np.int64)
    out = np.empty((len(points), len(book)), np.int64)
    for k in range(len(book)):
        out[:, k] = ((points - book[k]) ** 2).sum(1)
    return out


class Tree:
    """A cover tree over points in its own order: node k holds the points ``start[k]`` to ``end[k]``, its centre first."""

    def __init__(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, child: np.ndarray, children: np.ndarray, radius: np.ndarray):
        self.points, self.start, self.end, self.child, self.children, self.radius = points, start, end, child, children, radius

    @classmethod
    def built(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the place of each of its points in ``points``. Level by level: a node's points are covered by balls of its radius over ``BASE``."""
        order = np.arange(len(points))
        spans, inner, radius = [(0, len(points), ((points - points[0]) ** 2).sum(1))], [], []
        k = 0
        while k < len(spans):
            s, e, far = spans[k]
            most = int(far.max())
            radius.append(np.sqrt(float(most)))
            inner.append((len(spans), 0))
            if most and e - s > LEAF:
                cover, own = most / BASE**2, order[s:e].copy()
                near = far <= cover
                balls, rest = [(np.flatnonzero(near), far[near])], np.flatnonzero(~near)
                while len(rest):
                    d = ((points[own[rest]] - points[own[rest[0]]]) ** 2).sum(1)
                    near = d <= cover
                    balls.append((rest[near], d[near]))
                    rest = rest[~near]
                inner[k] = (len(spans), len(balls))
                for at, d in balls:
                    order[s : s + len(at)] = own[at]
                    spans.append((s, s + len(at), d))
                    s += len(at)
            spans[k] = spans[k][:2]
            k += 1
        start, end = np.array(spans).T
        child, children = np.array(inner).T
        return cls(points[order], start, end, child, children, np.array(radius)), order

    def packed(self, order: np.ndarray) -> dict:
        nodes = np.stack([self.start, self.end, self.child, self.children])
        return {"place": order.astype(np.int32).tobytes(), "points": self.points.astype(np.int32).tobytes(), "nodes": nodes.astype(np.int32).tobytes(), "radii": self.radius.tobytes()}

    @classmethod
    def unpacked(cls, part: dict) -> tuple[Tree, np.ndarray]:
        order = np.frombuffer(part["place"], np.int32)
        radius = np.frombuffer(part["radii"])
        nodes = np.frombuffer(part["nodes"], np.int32).reshape(4, -1).astype(np.int64)
        return cls(np.frombuffer(part["points"], np.int32).reshape(len(order), -1).astype(np.int64), *nodes, radius), order

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ranges (start, end) of points with the entry that is nearest to all of them, the lowest in ties; how many points took an exact comparison."""
        out, compared = [], 0
        todo = [(np.zeros(1, np.int64), np.ones((1, len(book)), bool))]
        while todo:
            nodes, may = todo.pop()
            for at in range(0, len(nodes), 256):
                own, mine = nodes[at : at + 256], may[at : at + 256]
                best, d = self._least(self.start[own], mine, book)
                d, r = np.sqrt(d), self.radius[own]
                reach = d[np.arange(len(own)), best] + 2 * r
                mine = mine & (d <= (reach + 1e-9 * (reach + 1))[:, None])
                whole = (mine.sum(1) == 1) | (r == 0)
                out.append((self.start[own[whole]], self.end[own[whole]], best[whole]))
                for leaf in (True, False):
                    split = np.flatnonzero(~whole & ((self.children[own] == 0) == leaf))
                    if not len(split):
                        continue
                    first, n = (self.start[own[split]], (self.end - self.start)[own[split]]) if leaf else (self.child[own[split]], self.children[own[split]])
                    below = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    left = np.repeat(mine[split], n, 0)
                    if not leaf:
                        todo.append((below, left))
                        continue
                    compared += len(below)
                    for k in range(0, len(below), 1024):
                        point = below[k : k + 1024]
                        out.append((point, point + 1, self._least(point, left[k : k + 1024], book)[0]))
        start, end, entry = (np.concatenate(x) for x in zip(*out))
        return start, end, entry, compared

    def _least(self, at: np.ndarray, may: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the entries that each point may have the nearest one, and the squared distances (infinite from others)."""
        some = np.flatnonzero(may.any(0))
        d = np.full(may.shape, np.inf)
        exact = np.where(may[:, some], distances(self.points[at], book[some]), np.iinfo(np.int64).max)
        d[:, some] = np.where(may[:, some], exact, np.inf)
        return some[exact.argmin(1)], d


def _planted(batches):
    """Chunks of vectors as trees, one for each part."""
    held: list[pa.RecordBatch] = []

    def chunk() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        width = vectors.shape[1] // PARTS
        if 4 * int(np.abs(vectors).max()) ** 2 * width >= 1 << 62:
            raise ValueError("components are too large for exact distances")
        parts = [Tree.packed(*Tree.built(np.ascontiguousarray(vectors[:, k * width : (k + 1) * width]))) for k in range(PARTS)]
        kind = pa.list_(pa.struct([(c, pa.binary()) for c in ("place", "points", "nodes", "radii")]))
        one = lambda c, t: pa.array([table.column(c).to_pylist()], pa.list_(t))
        return pa.RecordBatch.from_arrays([one("vec_id", pa.int64()), one("label", pa.string()), pa.array([parts], kind)], names=["ids", "labels", "parts"])

    rows = 0
    for batch in batches:
        while batch.num_rows:
            width = max(1, len(batch.column("vector")[0]))
            most = max(ENTRIES, min(CHUNK, CHUNK_BYTES // (4 * width)))
            part = batch.slice(0, most - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows >= most:
                yield chunk()
                rows = 0
    if rows:
        yield chunk()
    trim()


def _summed(books: list[np.ndarray]):
    """Sums of the components of each entry's points, and their number at place -1."""

    def run(batches):
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for trees in batch.column("parts"):
                for k, part in enumerate(trees.as_py()):
                    tree, _ = Tree.unpacked(part)
                    total = np.concatenate([np.zeros((1, tree.points.shape[1]), np.int64), np.cumsum(tree.points, 0)])
                    start, end, entry, _ = tree.nearest(books[k])
                    np.add.at(sums[k], entry, np.concatenate([total[end] - total[start], (end - start)[:, None]], 1))
        for k, s in enumerate(sums):
            used = np.flatnonzero(s[:, -1])
            width = s.shape[1]
            part, entry = np.full(len(used) * width, k, np.int32), np.repeat(used, width).astype(np.int32)
            place = np.tile(np.append(np.arange(width - 1), -1), len(used)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(place), pa.array(s[used].reshape(-1))], names=["part", "entry", "place", "value"])
        trim()

    return run


def _coded(books: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            for ids, labels, trees in zip(*(batch.column(c) for c in ("ids", "labels", "parts"))):
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for k, part in enumerate(trees.as_py()):
                    tree, order = Tree.unpacked(part)
                    start, end, entry, _ = tree.nearest(books[k])
                    by_start = np.argsort(start)
                    own = np.repeat(entry[by_start], (end - start)[by_start])
                    codes[order, k] = own
                    error[order] += ((tree.points - books[k][own]) ** 2).sum(1)
                text = codes.tobytes().hex()
                code = pa.array([text[at : at + 2 * PARTS] for at in range(0, len(text), 2 * PARTS)], pa.string())
                yield pa.RecordBatch.from_arrays([ids.values, code, pa.array(error), labels.values], names=["vec_id", "code", "error", "label"])
        trim()

    return run


def codebooks(trees: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many rounds: each entry becomes the floored mean of the points that it is nearest to."""
    for _ in range(rounds):
        sums = trees.mapInArrow(_summed(books), "part int, entry int, place int, value bigint").groupBy("part", "entry", "place").agg(F.sum("value").alias("value"))
        now = sums.toArrow()  # ENTRIES * (components + PARTS) rows at most
        part, entry, place, value = (now.column(c).to_numpy() for c in ("part", "entry", "place", "value"))
        after = []
        for k, book in enumerate(books):
            sums, own = np.zeros((len(book), book.shape[1] + 1), np.int64), part == k
            sums[entry[own], place[own]] = value[own]  # place -1 is the last column
            n = sums[:, -1:]
            after.append(np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), book))
        books = after
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    integers = F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("long"))
    kept = vectors.where(whole & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0)).select(F.col("vec_id").cast("long"), integers.alias("vector"), F.col("label").cast("string"))
    # As many as the codebooks have entries; the length of the first counts.
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").first()
    if first is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    size = len(first[0])
    kept = kept.where(F.size("vector") == size)
    begin = np.array([r["vector"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()], np.int64)
    trees = written(kept.mapInArrow(_planted, TREES), "cover-trees")
    books = codebooks(trees, np.split(begin, PARTS, 1))
    coded = written(trees.mapInArrow(_coded(books), CODES), "vector-codes", trees)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
