"""The repeated collect-analyze cycle as Structured Streaming (V)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def landed(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """V1: landed JSON files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """V1: append what has landed, then stop; the checkpoint remembers what was read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, at: str = "collected_at", delay: str = "1 day") -> DataFrame:
    """V2: one row per source_id within the watermark; the state is bounded by it."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["source_id"])


def first_seen(stream: DataFrame, keys: list[str], order: list[str], at: str = "collected_at", delay: str = "1 day", expiry: str = "7 days") -> DataFrame:
    """V2: the first row of a key, in the order of the columns ``order``; later ones go until ``expiry`` after it, then one stays again.

    The state of a key is the time of its first row; a timer removes it once the watermark has passed that time and the
    expiry, so the state holds the keys of the last ``expiry`` and ``delay`` only. Rows behind the watermark are left out, and so are those without a time.
    """
    schema, keep = stream.schema, pd.Timedelta(expiry).value // 1000
    stamp = lambda t: pd.Timestamp(t).as_unit("ns").value // 1000

    def own(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        seen, first = (state.get[0] if state.exists else None), []
        for k, t in enumerate(rows[at]):
            if seen is None or stamp(t) >= seen + keep:
                seen = stamp(t)
                first.append(k)
        until = -(-(seen + keep) // 1000)
        if until > state.getCurrentWatermarkMs():
            state.update((seen,))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield rows.iloc[first][schema.names]

    marked = stream.where(F.col(at).isNotNull()).withWatermark(at, delay)
    return marked.groupBy(*keys).applyInPandasWithState(own, schema, "seen long", "append", "EventTimeTimeout")  # microseconds


def daily_counts(stream: DataFrame, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """V3: mentions per keyword and day; a day is emitted once the watermark has passed it."""
    g = stream.withWatermark(at, delay).groupBy(F.window(at, "1 day"), "keyword").agg(F.count("*").alias("n"))
    return g.select("keyword", F.to_date("window.start").alias("day"), "n")


def sliding_counts(stream: DataFrame, days: int = 7, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """V4: mentions per keyword over the last 7, 30 or 90 days, each day."""
    g = stream.withWatermark(at, delay).groupBy(F.window(at, f"{days} days", "1 day"), "keyword").agg(F.count("*").alias("n"))
    return g.select("keyword", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def panes(stream: DataFrame, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """The daily counts that all windows are made of, written once a day is closed: one row of state for a keyword and a day, whatever the windows."""
    return daily_counts(stream, at, delay)


def window_sums(panes: DataFrame, days: tuple[int, ...] = (7, 30, 90), until=None) -> DataFrame:
    """(keyword, days, start, end, n) of every window of so many days that holds a mention, from stored panes (keyword, day, n); up to the last ``end`` given.

    A pane adds to the windows that begin within its last ``days`` days: its count comes in at the first of them and goes after
    the last. The running sum of these changes is the windows' sum, and holds until the next change; so a pane is two rows a size, and not one a window.
    """
    sizes = F.explode(F.array(*(F.lit(d) for d in days))).alias("days")
    p = panes.groupBy("keyword", "day").agg(F.sum("n").alias("n")).select("keyword", "day", "n", sizes)
    change = F.explode(F.array(F.struct(F.date_sub("day", F.col("days") - 1).alias("start"), F.col("n").alias("by")), F.struct(F.date_add("day", 1).alias("start"), (-F.col("n")).alias("by")))).alias("x")
    changes = p.select("keyword", "days", change).select("keyword", "days", "x.*").groupBy("keyword", "days", "start").agg(F.sum("by").alias("by"))
    order = Window.partitionBy("keyword", "days").orderBy("start")
    held = changes.select("keyword", "days", "start", F.sum("by").over(order).alias("n"), F.lead("start").over(order).alias("next")).where("n > 0")
    out = held.select("keyword", "days", F.explode(F.sequence("start", F.date_sub("next", 1))).alias("start"), "n").select("keyword", "days", "start", F.date_add("start", F.col("days")).alias("end"), "n")
    return out if until is None else out.where(F.col("end") <= F.lit(until).cast("date"))


def upsert(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """V5: ``merge`` of every micro-batch; it gets the batch's number, so a repeated batch can be told (see ``sinks.Versions``)."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analyzed(stream: DataFrame) -> DataFrame:
    """V6: stateless text measures of new rows (id, content); rows already read are never read again."""
    return stream.select("id", "content", F.size(X.tokens("content")).alias("word_count"), F.size(X.sentences("content")).alias("sentence_count"), X.phrases(X.content_words("content"), 2).alias("phrases"))
