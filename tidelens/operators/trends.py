"""Trend analysis (R, W5, W6): daily series of keywords and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timeline(mentions: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """Mentions (keyword, ts) counted by keyword and day since the cut-off; days without mentions are absent."""
    if days is not None:
        mentions = mentions.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    return mentions.groupBy("keyword", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def series_metrics(series: DataFrame, key: str = "keyword") -> DataFrame:
    """R2-R4, W6 per key: velocity over observed days, strength, type, first and earliest peak day, total."""
    own = Window.partitionBy(key)
    at = series.withColumn("i", F.row_number().over(own.orderBy("day")) - 1)
    g = at.groupBy(key).agg(
        F.count("*").alias("days"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.coalesce(F.regr_slope("n", "i"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("std"), F.max("n").alias("top"), F.min("day").alias("first_day"),
        F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("peak_day"),
    )
    level = F.greatest(F.col("mean"), F.lit(1.0))
    g = g.withColumn("velocity", F.when(F.col("days") < 2, 0.0).otherwise(F.col("slope") / level))
    strength = F.lit(0.4) * F.abs("velocity") + F.lit(0.3) * (1 - F.col("std") / level) + F.lit(0.3) * F.least(F.lit(1.0), F.col("top") / 10)
    return g.select(key, "days", "total", "first_day", "peak_day", "velocity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength)).alias("strength"), trend_type().alias("trend_type"))


def trend_type() -> Column:
    """By velocity; volatile only at exactly 0.1 either way."""
    v = F.col("velocity")
    volatile = (F.col("days") > 3) & (F.col("std") * F.col("std") > 2 * F.col("mean"))
    return F.when(F.abs(v) < 0.1, "stable").when(v > 0.1, "emerging").when(v < -0.1, "declining").when(volatile, "volatile").otherwise("stable")


def keyword_trends(mentions: DataFrame, as_of=None, days: int | None = None, min_frequency: int = 3, floor: float = 0.3) -> DataFrame:
    """Signals of keywords seen on enough days and strong enough, with the number of their papers, and their domains.

    mentions: keyword, ts, paper_id, domain. The papers themselves, of which a keyword may have any number, are the rows of ``trend_papers``.
    """
    signals = series_metrics(timeline(mentions, as_of, days)).where((F.col("days") >= max(min_frequency, 3)) & (F.col("strength") > floor))
    named = _recent(mentions, as_of, days).select("keyword", "paper_id", "domain").distinct()
    named = named.groupBy("keyword").agg(F.count_distinct("paper_id").alias("n_papers"), F.collect_set("domain").alias("d"))
    domains = F.filter("d", lambda x: x != "general")
    named = named.select("keyword", "n_papers", F.when(F.size(domains) > 0, F.array_sort(domains)).otherwise(F.array(F.lit("general"))).alias("domains"))
    return signals.join(named, "keyword")


def _recent(mentions: DataFrame, as_of, days: int | None) -> DataFrame:
    """Mentions of the last ``days`` days, or all."""
    return mentions if days is None else mentions.where(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def trend_papers(signals: DataFrame, mentions: DataFrame, as_of=None, days: int | None = None) -> DataFrame:
    """Keyword and paper_id, a row for each paper that mentions a keyword of ``signals``."""
    return _recent(mentions, as_of, days).join(signals.select("keyword"), "keyword", "left_semi").select("keyword", "paper_id").distinct()


def dense_timeline(mentions: DataFrame, start, end, key: str = "topic") -> DataFrame:
    """A count for every key and every day from ``start`` to ``end``; ``i`` is the day's place."""
    found = mentions.where((F.to_date("ts") >= F.lit(start).cast("date")) & (F.to_date("ts") <= F.lit(end).cast("date"))).groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    spine = found.select(key).distinct().select(key, F.posexplode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("i", "day"))
    return spine.join(found, [key, "day"], "left").select(key, "day", "i", F.coalesce("n", F.lit(0)).alias("n"))


def emergence(dense: DataFrame, end, key: str = "topic") -> DataFrame:
    """Emergence score, emergence date and growth rate of each dense series."""
    own = Window.partitionBy(key)
    s = dense.withColumn("len", F.count("*").over(own)).withColumn("last", F.lag("n").over(own.orderBy("i")))
    third = F.floor(F.col("len") / 3)
    s = s.withColumn("third_mean", F.avg(F.when(F.col("i") < third, F.col("n"))).over(own))
    g = s.groupBy(key).agg(
        F.max("len").alias("len"), F.sum("n").alias("total"),
        F.avg(F.when(F.col("i") < F.floor(F.col("len") / 2), F.col("n"))).alias("base"), F.avg(F.when(F.col("i") >= F.floor(F.col("len") / 2), F.col("n"))).alias("recent"),
        F.min(F.when((F.col("i") >= third) & (F.col("n") > 1.5 * F.col("third_mean")), F.col("i"))).alias("rise"),
        F.coalesce(F.avg(F.when(F.col("last") > 0, (F.col("n") - F.col("last")) / F.col("last"))), F.lit(0.0)).alias("growth_rate"),
        F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("points"),
    )
    ratio = F.col("recent") / F.col("base")
    score = F.when(F.col("len") < 14, 0.0).when(F.col("base") == 0, F.when(F.col("recent") > 0, 1.0).otherwise(0.0)).otherwise(1 / (1 + F.exp(-2 * (ratio - 1))))
    date = F.when(F.col("len") >= 7, F.date_sub(F.lit(end).cast("date"), (F.col("len") - F.col("rise")).cast("int")))
    return g.select(key, score.alias("emergence_score"), date.alias("emergence_date"), "growth_rate", "total", F.slice("points", F.greatest(F.size("points") - 6, F.lit(1)), 7).alias("recent_points"))


def emerging_topics(mentions: DataFrame, start, end, threshold: float = 0.5, key: str = "topic") -> DataFrame:
    """Topics whose emergence score passes the threshold."""
    return emergence(dense_timeline(mentions, start, end, key), end, key).where(F.col("emergence_score") > threshold)


def cross_domain_trends(mentions: DataFrame, start, end, floor: float = 0.6) -> DataFrame:
    """R11, our definition: keywords whose dense daily series in two domains correlate above the floor. mentions: keyword, domain, ts."""
    pairs = mentions.select(F.struct("keyword", "domain").alias("topic"), "ts")
    dense = dense_timeline(pairs, start, end).select("topic.keyword", "topic.domain", "i", "n")
    a, b = dense.alias("a"), dense.alias("b")
    joined = a.join(b, (F.col("a.keyword") == F.col("b.keyword")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.domain") < F.col("b.domain")))
    score = joined.groupBy(F.col("a.keyword").alias("keyword"), F.col("a.domain").alias("domain_a"), F.col("b.domain").alias("domain_b")).agg(F.corr("a.n", "b.n").alias("score"), (F.sum("a.n") + F.sum("b.n")).alias("total"))
    return score.where(F.col("score") > floor)


def trend_report(mentions: DataFrame, as_of, days: int = 30, top: int = 5) -> DataFrame:
    """The strongest keyword trends, emerging topics over three windows and cross-domain trends over two, as rows (section, name, score)."""
    end = F.lit(as_of).cast("date")
    topics = mentions.withColumnRenamed("keyword", "topic")
    parts = [
        keyword_trends(mentions, as_of, days).select(F.lit("keyword_trend").alias("section"), F.col("keyword").alias("name"), F.col("strength").alias("score")),
        emerging_topics(topics, F.date_sub(end, 3 * days), end).select(F.lit("emerging_topic").alias("section"), F.col("topic").alias("name"), F.col("emergence_score").alias("score")),
        cross_domain_trends(mentions, F.date_sub(end, 2 * days), end).select(F.lit("cross_domain").alias("section"), F.concat_ws("|", "keyword", "domain_a", "domain_b").alias("name"), "score"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "name"))).where(F.col("rank") <= top)
