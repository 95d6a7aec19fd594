"""Operator 1: best-fit packing by a configuration linear program.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of piece lengths (at most
``capacity`` numbers, whatever the corpus) reaches the driver. There the configuration program - cover
every length's count with as few sequences as possible, a configuration being a set of lengths that
fits - is solved by multiplicative weights: each round a knapsack dynamic program prices the best
configuration for the current weights, and lengths that it covers lose weight. The fractional uses are
rounded down, and what is left is packed best-fit, again over the histogram. The plan (runs of equal
sequences) is a bounded table; tasks give each piece its place from its rank among pieces of its length.

Defined cases: a null or empty text is one piece with the end id; repeated rows are packed each; equal
lengths are ranked by chunk, then doc_id and piece; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import encoder
from ._shared import written
from ._text import slices

CAPACITY = 1024
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Most rounds; configurations in a round; a configuration's share of a count; how fast weights fall; the share that the program covers.
ROUNDS, AT_ONCE, SHARE, RATE, COVER = 300, 24, 0.05, 0.3, 0.9
#: Pieces in a chunk, about: ranks are counted within chunks, and chunk counts are summed.
CHUNK_ROWS = 2_000


def _pieces(vocabulary: str, end_id: int, capacity: int):
    def run(batches):
        end = np.array([end_id], np.uint32)
        for batch in slices(batches, most=3_000_000):
            ids, off = encoder(vocabulary).encode(batch.column("text"))
            out = [[] for _ in range(5)]
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.concatenate([ids[off[k] : off[k + 1]], end]).astype("<u4")
                first = len(own) % capacity or capacity
                cuts = [0, *range(first, len(own) + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    for column, value in zip(out, (doc, n, a, b - a, zlib.crc32(own[a:b]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")])

    return run


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32. Only a first piece may be short."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pieces(vocabulary, end_id, capacity), PIECE_SCHEMA)


def price(weights: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the most weight for every room up to ``capacity``, and the length chosen last (-1: none)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    live = np.flatnonzero(weights > 0)
    own, value = lengths[live], weights[live]
    for c in range(1, capacity + 1):
        fit = np.searchsorted(own, c, "right")
        best[c] = best[c - 1]
        if fit:
            gain = best[c - own[:fit]] + value[:fit]
            k = gain.argmax()
            if gain[k] > best[c]:
                best[c], choice[c] = gain[k], live[k]
    return best, choice


def _configuration(first: int, choice: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each length in the best configuration that holds length ``first``."""
    config = np.zeros(len(lengths), np.int64)
    config[first] = 1
    room = capacity - lengths[first]
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            config[choice[room]] += 1
            room -= lengths[choice[room]]
    return config


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """Configurations and their uses in a nearly optimal fractional cover of a ``COVER`` share of the counts, by multiplicative weights.

    A round prices all rooms by one dynamic program and then uses, for each of the ``AT_ONCE`` lengths
    covered least, the best configuration that holds it, until that has covered a ``SHARE`` of some
    length. A length's weight falls exponentially with the share of it that is covered.
    """
    demand = counts.astype(float)
    covered = np.zeros(len(lengths))
    uses: dict[bytes, list] = {}
    for _ in range(rounds):
        weights = np.where(covered < COVER, lengths * np.exp(-RATE * covered), 0)
        if not weights.any():
            break
        _, choice = price(weights, lengths, capacity)
        for first in np.argsort(covered, kind="stable")[:AT_ONCE]:
            config = _configuration(first, choice, lengths, capacity)
            on = np.flatnonzero(config)
            share = config[on] / demand[on]
            step = min(SHARE / share.max(), float(((1 - covered[on]) / share).min()))
            if step > 0:
                uses.setdefault(config.tobytes(), [config, 0.0])[1] += step
                covered[on] += share * step
    return [(c, u) for c, u in uses.values()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of equal sequences: (number of sequences, lengths, copies of each), covering ``histogram`` exactly."""
    out = []
    if histogram.get(capacity):
        out.append((histogram[capacity], np.array([capacity]), np.array([1])))
    lengths = np.array(sorted(n for n in histogram if n < capacity and histogram[n] > 0), np.int64)
    if not len(lengths):
        return out
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    for config, use in sorted(fractional(lengths, left, capacity, rounds), key=lambda x: (-x[1], x[0].tobytes())):
        on = config > 0
        times = min(int(use), int((left[on] // config[on]).min()))
        if times > 0:
            left = left - times * config
            out.append((times, lengths[on], config[on]))
    while left.any():  # best fit: the longest that is left, then always the longest that fits
        config, room = np.zeros(len(lengths), np.int64), capacity
        while True:
            fit = np.flatnonzero((left - config > 0) & (lengths <= room))
            if not len(fit):
                break
            k = fit[-1]
            n = min(int(left[k] - config[k]), int(room // lengths[k])) if config.any() else 1
            config[k] += n
            room -= n * int(lengths[k])
        on = config > 0
        times = int((left[on] // config[on]).min())
        left = left - times * config
        out.append((times, lengths[on], config[on]))
    return out


def _slots(runs) -> dict[int, np.ndarray]:
    """For each length its intervals of ranks: first rank, copies in a sequence, first sequence, offset of the first copy."""
    slots: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, lengths, copies in runs:
        offset = 0
        for n, c in zip(lengths.tolist(), copies.tolist()):
            slots.setdefault(n, []).append((ranks.get(n, 0), c, sequence, offset))
            ranks[n] = ranks.get(n, 0) + times * c
            offset += n * c
        sequence += times
    return {n: np.array(v, np.int64) for n, v in slots.items()}


def _placed(slots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                table = slots[n]
                k = np.searchsorted(table[:, 0], rank[own], "right") - 1
                first, copies, seq, off = table[k].T
                sequence[own] = seq + (rank[own] - first) // copies
                offset[own] = off + (rank[own] - first) % copies * n
            names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Give each piece (doc_id, piece, start, length, ids_crc32) its sequence_id and offset."""
    cut = written(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    chunks = max(1, sum(histogram.values()) // CHUNK_ROWS)
    slots = _slots(plan(histogram, capacity, rounds))
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    firsts = cut.groupBy("chunk", "length").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("chunk")) - F.col("n"))
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("chunk", "length").orderBy("doc_id", "piece")) - 1)
    placed = ranked.join(firsts.select("chunk", "length", "first"), ["chunk", "length"]).withColumn("rank", F.col("rank").cast("long") + F.col("first"))
    return placed.drop("chunk", "first").mapInArrow(_placed(slots), PIECE_SCHEMA + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs`` (doc_id, text); one row per piece with its sequence and offset."""
    return pack(pieces(docs, vocabulary, end_id, capacity), capacity)
