"""Operator 7: token ids in files of directly addressable codes.

An id is split into chunks of given bit widths, lowest first. Level k holds the k-th chunk of every id
that has one, a bitmap that says which of them continue on level k + 1, and a rank directory over the
bitmap (set bits before every block). The place of an id's next chunk is the rank of its continuation
bit, so any token, or any run of them, is read without decoding what comes before.

A file is Parquet whose rows are shards of at least ``SHARD_TOKENS`` ids (a document is never cut), in
ascending document order within and between files; Spark's writer and reader carry it, so it works on
any store that Spark reads.

Defined cases: a null or empty text has only the end id; rows with equal doc_id are ordered by text and
each kept; a null doc_id sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bpe import encoder
from ._shared import shared_dir
from ._text import slices

SHARD_TOKENS = 1 << 19
WIDTHS = (8, 8, 16)
RANK_BITS = 512
SHARD_SCHEMA = "part int, shard int, n_tokens long, doc_ids binary, doc_at binary, widths array<int>, chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
TOKEN_SCHEMA = "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long"
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _dtype(width: int):
    return np.uint8 if width <= 8 else np.uint16 if width <= 16 else np.uint32


def encode_levels(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of all levels of ``ids``."""
    chunks, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint64)
    for k, width in enumerate(widths):
        chunks.append((rest & np.uint64((1 << width) - 1)).astype(_dtype(width)).tobytes())
        rest = rest >> np.uint64(width)
        goes_on = rest != 0
        if k + 1 == len(widths) and goes_on.any():
            raise ValueError("an id has more bits than the levels")
        bits = np.packbits(goes_on, bitorder="little")
        counts = np.add.reduceat(_POPCOUNT[bits].astype(np.uint32), np.arange(0, len(bits), RANK_BITS // 8)) if len(bits) else np.zeros(0, np.uint32)
        bitmaps.append(bits.tobytes())
        ranks.append((np.cumsum(counts, dtype=np.uint32) - counts.astype(np.uint32)).tobytes())
        rest = rest[goes_on]
    return chunks, bitmaps, ranks


class Levels:
    """Random access to one shard's ids."""

    def __init__(self, widths, chunks, bitmaps, ranks):
        self.widths = widths
        self.chunks = [np.frombuffer(c, _dtype(w)) for c, w in zip(chunks, widths)]
        self.bitmaps = [np.frombuffer(b, np.uint8) for b in bitmaps]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    def rank(self, level: int, at: int) -> int:
        """Continuation bits set before place ``at`` of a level: the directory's entry and less than a block of bits."""
        block = at // RANK_BITS
        if block >= len(self.ranks[level]):
            block = len(self.ranks[level]) - 1
            if block < 0:
                return 0
        bits = np.unpackbits(self.bitmaps[level][block * RANK_BITS // 8 : (at + 7) // 8], bitorder="little")
        return int(self.ranks[level][block]) + int(bits[: at - block * RANK_BITS].sum())

    def read(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive): each level's part is one run of places."""
        out = self.chunks[level][start:end].astype(np.uint32)
        if start >= end or level + 1 == len(self.widths):
            return out
        bits = np.unpackbits(self.bitmaps[level][start // 8 : (end + 7) // 8], bitorder="little")
        goes_on = np.flatnonzero(bits[start % 8 : start % 8 + end - start])
        if len(goes_on):
            first = self.rank(level, start)
            out[goes_on] |= self.read(first, first + len(goes_on), level + 1) << np.uint32(self.widths[level])
        return out


def _shards(vocabulary: str, end_id: int, shard_tokens: int, widths: tuple[int, ...]):
    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0
        docs: list = []
        runs: list[np.ndarray] = []
        held = 0

        def row():
            ids = np.concatenate(runs) if runs else np.zeros(0, np.uint32)
            chunks, bitmaps, ranks = encode_levels(ids, widths)
            sizes = np.array([len(r) for r in runs], np.int64)
            values = [[part], [shard], [len(ids)], [np.array(docs, np.int64).tobytes()], [np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64).tobytes()], [list(widths)], [chunks], [bitmaps], [ranks]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), *[pa.list_(pa.binary())] * 3]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        end = np.array([end_id], np.uint32)
        for batch in slices(batches, most=3_000_000):
            ids, off = encoder(vocabulary).encode(batch.column("text"))
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                docs.append(np.iinfo(np.int64).min if doc is None else doc)
                runs.append(np.concatenate([ids[off[k] : off[k + 1]], end]))
                held += len(runs[-1])
                if held >= shard_tokens:
                    yield row()
                    docs, runs, held, shard = [], [], 0, shard + 1
        if docs:
            yield row()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, widths: tuple[int, ...] = WIDTHS) -> None:
    """Encode ``docs`` (doc_id, text) and write the files; one shuffle brings the documents into order."""
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_shards(vocabulary, end_id, shard_tokens, widths), SHARD_SCHEMA).write.parquet(path)


def _documents(batches):
    for batch in batches:
        for shard in batch.to_pylist():
            levels = Levels(shard["widths"], shard["chunks"], shard["bitmaps"], shard["ranks"])
            docs, at = np.frombuffer(shard["doc_ids"], np.int64), np.frombuffer(shard["doc_at"], np.int64)
            crc = [zlib.crc32(levels.read(a, b).astype("<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard["part"]] * n, pa.int32()), pa.array([shard["shard"]] * n, pa.int32()), pa.array(docs, mask=docs == np.iinfo(np.int64).min), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                names=[c.split()[0] for c in TOKEN_SCHEMA.split(", ")],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32.

    Starts come from the shards' counts: a sum for each file in one small window (a row per file), and
    a running sum within each file.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    counts = shards.select("part", "shard", "n_tokens")
    files = counts.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("file_at", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    within = counts.withColumn("shard_at", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
    bases = within.join(files.select("part", "file_at"), "part").select("part", "shard", (F.col("file_at") + F.col("shard_at")).alias("base"))
    return shards.mapInArrow(_documents, TOKEN_SCHEMA).join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """The id at each global place of ``places`` (place): (place, token_id). Only the shards that hold a place are opened."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    size = shards.select("part", "shard", "n_tokens")
    files = size.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("file_at", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    base = size.withColumn("at", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")).join(files, "part").select("part", "shard", (F.col("file_at") + F.col("at")).alias("base"), "n_tokens")
    # A shard stands in each stretch of ``SHARD_TOKENS`` places that it reaches, so places and shards meet by an equality.
    stretch = lambda place: F.floor(place / SHARD_TOKENS)
    base = base.where("n_tokens > 0").withColumn("stretch", F.explode(F.sequence(stretch(F.col("base")), stretch(F.col("base") + F.col("n_tokens") - 1))))
    wanted = places.select(F.col("place").cast("long"), stretch(F.col("place").cast("long")).alias("stretch")).join(base, "stretch")
    wanted = wanted.where((F.col("place") >= F.col("base")) & (F.col("place") < F.col("base") + F.col("n_tokens"))).select("part", "shard", "place", (F.col("place") - F.col("base")).alias("offset"))

    def run(batches):
        for batch in batches:
            found = [(r["place"], int(Levels(r["widths"], r["chunks"], r["bitmaps"], r["ranks"]).read(r["offset"], r["offset"] + 1)[0])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["place", "token_id"])

    return wanted.join(shards.drop("n_tokens"), ["part", "shard"]).select("place", "offset", "widths", "chunks", "bitmaps", "ranks").mapInArrow(run, "place long, token_id long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write the files to the shared folder and return what they hold, per document."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary, end_id)
    return read_documents(spark, path)
