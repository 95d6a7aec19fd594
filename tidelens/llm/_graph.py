"""Connected components of a link table by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def components(links: DataFrame, *done: DataFrame) -> DataFrame:
    """(id, root) for every id of ``links`` (a, b: long): root is the smallest id that it reaches. ``done`` are deleted once ``links`` is read.

    Each round points every neighbour at the smallest id known nearby, first towards larger ids, then
    towards smaller ones; rounds grow with the logarithm of the number of ids. Hubs are reduced by
    partial aggregates and joins that can be split.
    """
    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", *done)
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now["n"], now["x"]) == mark or not now["n"]:
            break
        mark = (now["n"], now["x"])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.where("u != v").distinct(), "edges", edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


#: Links of a partition, about, that is reduced to a forest on its own.
LINKS = 1 << 17


def _forest(batches):
    """(id, root) of every id of a partition's links (a, b): root is the smallest id that it reaches by them."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    ids = list(parent)
    for at in range(0, len(ids), 50_000):
        part = ids[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["id", "root"])


def components_by_parts(links: DataFrame, *done: DataFrame) -> DataFrame:
    """As ``components``, for few links in many files: partitions of up to some ``LINKS`` links become forests, and only several forests need rounds.

    As ``components`` it names every id that has a link; ``links`` is read twice.
    """
    parts = -(-links.count() // LINKS) or 1
    forests = written(links.select("a", "b").coalesce(parts).mapInArrow(_forest, "id long, root long"), "forests", *done)
    return forests if parts == 1 else components(forests.toDF("a", "b"), forests)
