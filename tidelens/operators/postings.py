"""Stored postings for repeated searches (Q1, Q4, Q6, J9): sorted lists of ids by key, in a table that is partitioned by a hash of the key.

A search reads the partitions of its own keys, and of these the row groups that may hold them, however large the
collection is; nothing is tokenised or scanned again. A key's list is cut by ranges of ids, so a common key is many rows, and
lists of one range meet in one task.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import terms as K
from ..functions import text as X

#: Ids of a range: at most so many are in one row.
RANGE = 1 << 16
#: Writers of a partition: the ranges of a common key are dealt among them.
WRITERS = 8
GRAM = 3


@dataclass(frozen=True)
class Postings:
    """A stored index: ``path`` holds (shard, key, range, n, ids), keys sorted within files."""

    path: str
    shards: int

    def _shard(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.shards)).cast("int")

    def write(self, pairs: DataFrame) -> Postings:
        """Store the pairs (key: string, id: long); repeated ones count once, nulls are left out."""
        own = pairs.where("key is not null and id is not null").select("key", "id").distinct()
        at = F.floor(F.col("id") / RANGE).cast("long")
        rows = own.groupBy("key", at.alias("range")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids")).withColumn("shard", self._shard(F.col("key")))
        rows = rows.repartition("shard", F.pmod("range", F.lit(WRITERS))).sortWithinPartitions("shard", "key", "range")
        rows.write.partitionBy("shard").parquet(self.path)
        return self

    def lists(self, spark: SparkSession, keys: list[str]) -> DataFrame:
        """The rows of some keys: only their partitions are read."""
        own = spark.read.schema("key string, range long, n long, ids array<bigint>, shard int").parquet(self.path)
        keys = sorted(set(keys))
        return own.where(F.col("shard").isin([self._shard(F.lit(k)) for k in keys]) & F.col("key").isin(keys))

    def frequencies(self, spark: SparkSession, keys: list[str]) -> DataFrame:
        """(key, n): how many ids hold each key that any id holds; lists are not read."""
        return self.lists(spark, keys).groupBy("key").agg(F.sum("n").alias("n"))

    def holding_all(self, spark: SparkSession, keys: list[str]) -> DataFrame:
        """(id): the ids that hold all keys; none for no keys. In each range the shortest list is intersected first."""
        keys = sorted(set(keys))
        if not keys:
            return spark.createDataFrame([], "id long")
        lists = self.lists(spark, keys).groupBy("range").agg(F.array_sort(F.collect_list(F.struct("n", "key", "ids"))).alias("l")).where(F.size("l") == len(keys))
        return lists.select(F.explode(_intersected()).alias("id"))

    def holding_each(self, queries: DataFrame) -> DataFrame:
        """(query_id, id): the ids that hold all keys of each query. queries: query_id, key; a table of any size, of which the partitions are found by a join."""
        own = queries.where("key is not null").select("query_id", "key").distinct()
        size = own.groupBy("query_id").agg(F.count("*").alias("keys"))
        rows = queries.sparkSession.read.schema("key string, range long, n long, ids array<bigint>, shard int").parquet(self.path)
        met = rows.join(own.withColumn("shard", self._shard(F.col("key"))), ["shard", "key"])
        lists = met.groupBy("query_id", "range").agg(F.array_sort(F.collect_list(F.struct("n", "key", "ids"))).alias("l"))
        return lists.join(size, "query_id").where(F.size("l") == F.col("keys")).select("query_id", F.explode(_intersected()).alias("id"))


def _intersected() -> Column:
    """The ids in all lists of a range, from the shortest on."""
    return F.aggregate(F.slice("l", 2, F.size("l")), F.get("l", F.lit(0))["ids"], lambda ids, x: F.array_intersect(ids, x["ids"]))


def term_index(docs: DataFrame, path: str, shards: int = 64) -> Postings:
    """Q1: the words of title and content, stop words left out. docs: id, title, content."""
    return Postings(path, shards).write(docs.select(F.col("id").cast("long"), F.explode(F.array_distinct(X.content_words(F.concat_ws(" ", "title", "content")))).alias("key")))


def search_all(index: Postings, docs: DataFrame, query: str, source_types: list[str] | None = None, start=None, end=None, most: int = 100) -> DataFrame:
    """Q1 over a stored index (``search.search_all`` without one): documents that hold every term, newest first."""
    wanted = [w for w in query.lower().split() if w not in K.STOP_WORDS]
    d = docs.join(index.holding_all(docs.sparkSession, wanted), "id", "left_semi")
    if source_types:
        d = d.where(F.col("source_type").isin(source_types))
    if start is not None:
        d = d.where(F.col("published_date") >= F.lit(start))
    if end is not None:
        d = d.where(F.col("published_date") <= F.lit(end))
    return d.orderBy(F.desc_nulls_last("published_date"), "id").limit(most)


def _grams(text: Column) -> Column:
    """The distinct runs of ``GRAM`` characters of a text in lower case."""
    low = F.lower(text)
    starts = F.when(F.char_length(low) >= GRAM, F.sequence(F.lit(1), F.char_length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda k: F.substr(low, k, F.lit(GRAM))))


@dataclass(frozen=True)
class Substrings:
    """A stored index for searches of a part of a text: ``texts`` holds each text once (id, text), ``grams`` the postings of their grams."""

    texts: str
    grams: Postings

    @classmethod
    def of(cls, strings: DataFrame, path: str, shards: int = 64) -> Substrings:
        """Store the texts (column text)."""
        own = strings.where("text is not null").select("text").distinct().select(F.xxhash64("text").alias("id"), "text")
        own.write.parquet(f"{path}/texts")
        texts = strings.sparkSession.read.schema("id long, text string").parquet(f"{path}/texts")
        return cls(f"{path}/texts", Postings(f"{path}/grams", shards).write(texts.select("id", F.explode(_grams(F.col("text"))).alias("key"))))

    def like(self, spark: SparkSession, part: str) -> DataFrame:
        """(text): the texts for which ``text ILIKE '%part%'`` holds. Texts that have all grams of the part are verified; a part too short for any is looked for in all texts, which are stored once each."""
        texts = spark.read.schema("id long, text string").parquet(self.texts)
        pieces = [p.lower() for p in re.split(r"\\.|[%_]", part)]
        keys = [p[k : k + GRAM] for p in pieces for k in range(len(p) - GRAM + 1)]
        if keys:
            texts = texts.join(self.grams.holding_all(spark, keys), "id", "left_semi")
        return texts.where(F.col("text").ilike(f"%{part}%")).select("text")


def search_entities(index: Substrings, entities: DataFrame, entity_type: str, text: str, most: int = 10) -> DataFrame:
    """Q4 over a stored index of the entities' texts: matches of a type and part of a text."""
    found = index.like(entities.sparkSession, text).withColumnRenamed("text", "entity_text")
    return entities.where(F.col("entity_type") == entity_type).join(found, "entity_text", "left_semi").select("document_id", "entity_text").distinct().orderBy("document_id", "entity_text").limit(most)


def report_strings(reports: DataFrame) -> DataFrame:
    """(document_id, text): what Q6 looks for in a report: its id, contributions and concepts."""
    own = F.concat(F.array(F.col("document_id").cast("string")), F.coalesce("novel_contributions", F.array()), F.coalesce(F.col("concept_keywords.concept"), F.array()))
    return reports.select("document_id", F.explode(own).alias("text"))


def search_reports(index: Substrings, reports: DataFrame, query: str, provider: str | None = None, min_score: float | None = None, most: int = 50) -> DataFrame:
    """Q6 over a stored index of ``report_strings``: provider; least score (a null score never passes); newest first."""
    hits = report_strings(reports).join(index.like(reports.sparkSession, query), "text", "left_semi").select("document_id")
    r = reports.join(hits, "document_id", "left_semi")
    if provider is not None:
        r = r.where(F.col("provider") == provider)
    if min_score is not None:
        r = r.where(F.col("research_quality_score") >= min_score)
    return r.orderBy(F.desc("timestamp"), "document_id").limit(most)


def reports_with_keywords(index: Substrings, reports: DataFrame, keywords: DataFrame, query: str) -> DataFrame:
    """J9 over a stored index of keywords and ids: reports whose id or a keyword matches, with the matching keywords (all of them where the id matches)."""
    found = index.like(reports.sparkSession, query)
    own = reports.select("document_id").join(keywords, "document_id", "left")
    by_id = own.join(found, F.col("document_id").cast("string") == F.col("text"), "left_semi")
    by_word = own.join(found, F.col("keyword") == F.col("text"), "left_semi").join(by_id.select("document_id"), "document_id", "left_anti")
    return by_id.unionByName(by_word).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list("keyword")), ", ").alias("keywords"))
