"""Operator 8: benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units and names become typed placeholders, word for word, so that a re-parameterised question
has the template of its original. Windows of ``WINDOW`` template words of every document are hash-joined
with those of the benchmark; a window needs ``LITERALS`` words that are not placeholders. Windows of values
(the words as they are, without case and punctuation) are joined as well, for every window of an item, so
that verbatim copies need no template; signs such as + that stand alone do not tell copies apart. On the
documents that share a window, a second pass aligns each hit with its item and checks the slots: along
one alignment every value of the item must stand for one value of the document. Values are compared without
case and punctuation. Where a value stands for two, only the alignment's windows of equal words stay.

A document is contaminated by an item when consistent alignments cover ``COVERAGE`` of the item's windows,
or of its windows with enough literals, or ``RUN`` windows. The first pass probes every window, so that a document with one hit anywhere is seen.

Items shorter than a window are matched whole, those under ``SHORTEST`` words by their values only: an item
of one word is held by every document with that word. No side of a join is marked for broadcast; Spark sends
one whole only where its size is within ``spark.sql.autoBroadcastJoinThreshold``.

Defined cases: null and empty texts match nothing; rows with equal doc_id (or null) are judged together;
repeated rows give one result; items of equal text give a row each; other columns pass through, whatever
their names; an empty side gives no rows, and removes none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ._shared import free_name, written

WINDOW, LITERALS, SHORTEST = 8, 4, 4
COVERAGE, RUN = 0.4, 6
NUMBER, UNIT, NAME = "\ue001", "\ue002", "\ue003"
#: Longs of the bitmap of two first words.
BITMAP = 1024
#: Units of measure that follow a number.
UNITS = "kilograms?|kilometers?|kilometres?|centimeters?|millimeters?|meters?|metres?|miles?|inches|inch|feet|foot|yards?|grams?|pounds?|ounces?|tons?|liters?|litres?|gallons?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|percent|degrees?|kg|km|cm|mm|mg|lbs?|oz|ml|mph|min|sec|hrs?|m|g|s|h|l"


def _without_placeholders(text: Column) -> Column:
    """The text with spaces for characters that stand for placeholders here; few texts have any."""
    some = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in (NUMBER, UNIT, NAME)))
    return F.when(some, F.translate(text, NUMBER + UNIT + NAME, "   ")).otherwise(text)


def canonical(text: Column) -> Column:
    """The text with placeholders, lower-cased and without punctuation; white space, and so the words, stay in place."""
    return _canonical(_without_placeholders(text))


def _canonical(text: Column) -> Column:
    out = F.regexp_replace(text, r"\p{N}++(?:[.,:/]\p{N}++)*+", NUMBER)
    out = let(out, lambda t: F.when(F.contains(t, F.lit(NUMBER)), F.regexp_replace(t, rf"(?<={NUMBER})([ \t-]?)(?:(?i:{UNITS})\b|[%$€£°])", f"$1{UNIT}")).otherwise(t))
    out = F.regexp_replace(out, r"(?=\p{Lu})(?<=[^.!?:\s][ \t])\p{Lu}[\p{L}\p{M}'’-]*+", NAME)
    return F.regexp_replace(F.lower(out), rf"[^\p{{L}}\p{{M}}\s{NUMBER}{UNIT}{NAME}]++", "")


def _typed(word: Column) -> Column:
    """Whether a template word has a placeholder."""
    return F.contains(word, F.lit(NUMBER)) | F.contains(word, F.lit(UNIT)) | F.contains(word, F.lit(NAME))


def words(text: Column) -> Column:
    return F.split(text, r"[ \t\n\x0B\f\r]+")


def _value(word: Column) -> Column:
    """A word without case and punctuation; signs between digits stay."""
    out = F.regexp_replace(word, r"[^\p{L}\p{M}\p{N}.,:/]++", "")
    return F.lower(F.regexp_replace(out, r"(?<!\p{N})[.,:/]++|[.,:/]++(?!\p{N})", ""))


def _aligned(docs: DataFrame, key: str) -> DataFrame:
    """key, template words and values of each row, place by place; words of punctuation only are left out."""
    text = _without_placeholders(F.coalesce(F.col("text").cast("string"), F.lit("")))
    both = F.arrays_zip(words(F.col("canon")).alias("c"), words(F.col("raw")).alias("r"))
    out = docs.select(F.col(key), text.alias("raw")).withColumn("canon", _canonical(F.col("raw")))
    out = out.select(key, F.filter(both, lambda w: (w["c"] != "") & w["r"].isNotNull()).alias("words"))
    return out.select(key, F.col("words.c").alias("c"), F.transform("words", lambda w: F.when(_typed(w["c"]), _value(w["r"])).otherwise(w["c"])).alias("r"))


def _windows(codes: Column, size: Column | int, first=None) -> Column:
    """(place, hash) of the windows of word hashes ``codes``; none if the text is shorter. ``first(i)`` may rule out the place i."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.size(codes) - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    places = places if first is None else F.filter(places, first)
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice(codes, i + 1, size)).alias("code")))


def _pair(codes: Column, i: Column) -> Column:
    """A bit's place for the two first words of a window."""
    return F.pmod(F.xxhash64(F.get(codes, i), F.get(codes, i + 1)), F.lit(64 * BITMAP)).cast("int")


def _bitmap(index: DataFrame) -> Column:
    """The bits of the two first words of all index windows: a constant of ``BITMAP`` longs, whatever the benchmark's size."""
    bits = index.where("pair is not null").groupBy(F.floor(F.col("pair") / 64).cast("int").alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, pair % 64)")).alias("bits"))
    found = {r["k"]: r["bits"] for r in bits.collect()}  # at most ``BITMAP`` rows
    return F.array(*(F.lit(found.get(k, 0)).cast("long") for k in range(BITMAP)))


def _codes(template: Column) -> Column:
    return F.transform(template, lambda w: F.xxhash64(w))


def _literals(template: Column) -> Column:
    return F.size(F.filter(template, lambda w: ~_typed(w)))


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, size, item_place, code, whether there are enough literal words, and values, of each item's windows: of values, and of template words with enough literals."""
    items = _aligned(benchmark.where(F.col("text").isNotNull()), "item_id").where(F.size("c") > 0)
    size = F.least(F.size("c"), F.lit(WINDOW))
    items = items.select("item_id", "c", "r", size.alias("size"), (F.size("c") >= SHORTEST).alias("enough"))
    place, slot = F.col("w.place"), lambda x: F.slice(x, F.col("w.place") + 1, F.col("size"))
    out = []
    for words_of in ("c", "r"):
        rows = items.withColumn("codes", _codes(F.col(words_of)))
        rows = rows.withColumn("w", F.explode(_windows(F.col("codes"), F.col("size"))))
        rows = rows.withColumn("typed", F.col("enough") & (_literals(slot("c")) >= F.least(F.lit(LITERALS), F.col("size"))))
        rows = rows if words_of == "r" else rows.where("typed")
        pair = F.when(F.col("size") > 1, _pair(F.col("codes"), place)).alias("pair")
        out.append(rows.select("item_id", "size", place.alias("item_place"), "typed", F.col("w.code").alias("code"), slot("r").alias("item_words"), pair))
    return out[0].unionByName(out[1]).distinct()


def _probes(sizes: list[int], bitmap: Column) -> Column:
    """(size, place, code) of every window of a document's template words, and of its values where they differ, but for windows whose first words begin none of an item."""
    empty = F.array().cast("array<struct<size:int,place:int,code:long>>")

    def of(codes: Column, size: int) -> Column:
        begins = lambda i: let(_pair(codes, i), lambda p: F.getbit(F.get(bitmap, F.shiftright(p, 6)), p.bitwiseAND(63)) == 1)
        return F.transform(_windows(codes, size, begins if size > 1 else None), _with_size(size))

    every = lambda codes: F.concat(empty, *(of(F.col(codes), s) for s in sizes))
    return F.concat(every("codes"), F.when(F.col("codes") == F.col("values"), empty).otherwise(every("values")))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, reworded: one row for each document and item that contaminates it."""
    index = written(_item_windows(benchmark), "benchmark-windows")
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # at most WINDOW values
    bitmap = _bitmap(index)
    index = index.drop("pair")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"))
    codes = _aligned(texts, "doc_id").select("doc_id", _codes(F.col("c")).alias("codes"), _codes(F.col("r")).alias("values"))
    probed = codes.select("doc_id", F.explode_outer(_probes(sizes, bitmap)).alias("w")).select("doc_id", F.col("w.size").alias("size"), F.col("w.code").alias("code"))
    keys = index.select("size", "code").distinct()
    found = written(probed.join(keys, ["size", "code"], "left_semi").select("doc_id").distinct(), "suspects")

    suspects = texts.join(found.withColumnRenamed("doc_id", "suspect"), F.col("doc_id").eqNullSafe(F.col("suspect")), "left_semi")
    aligned = written(_aligned(suspects, "doc_id"), "suspect-words").withColumn("codes", _codes(F.col("c"))).withColumn("values", _codes(F.col("r")))
    hits = aligned.select("doc_id", F.col("c"), F.col("r"), F.explode_outer(_probes(sizes, bitmap)).alias("w"))
    hits = hits.select("doc_id", F.col("w.size").alias("size"), F.col("w.place").alias("place"), F.col("w.code").alias("code"), F.slice("c", F.col("w.place") + 1, F.col("w.size")).alias("template"), F.slice("r", F.col("w.place") + 1, F.col("w.size")).alias("doc_words"))
    hits = written(hits.join(index, ["size", "code"]).withColumn("shift", F.col("place") - F.col("item_place")), "benchmark-hits")

    # Slots along one alignment: pairs of an item's value and the document's.
    pairs = F.arrays_zip(F.col("template"), F.col("item_words"), F.col("doc_words"))
    slots = hits.select("doc_id", "item_id", "shift", F.explode(F.filter(pairs, lambda p: _typed(p["template"]))).alias("p"))
    slots = slots.select("doc_id", "item_id", "shift", F.col("p.item_words").alias("a"), F.col("p.doc_words").alias("b")).distinct()
    many = slots.groupBy("doc_id", "item_id", "shift", "a").agg(F.count("*").alias("n"), F.max(F.col("a") != F.col("b")).alias("other"))
    verdict = many.groupBy("doc_id", "item_id", "shift").agg((F.max("n") == 1).alias("consistent"), F.max("other").alias("reworded"))

    keys = ["doc_id", "item_id", "shift"]
    verbatim = (F.col("item_words") == F.col("doc_words")).alias("verbatim")
    kept = hits.select(*keys, "item_place", "typed", verbatim).distinct().alias("h").join(verdict.alias("v"), [F.col(f"h.{k}").eqNullSafe(F.col(f"v.{k}")) for k in keys], "left")
    kept = kept.where(F.col("h.verbatim") | F.coalesce(F.col("v.consistent"), F.lit(True))).select("h.doc_id", "h.item_id", "h.item_place", "h.typed", F.coalesce(F.col("v.reworded"), F.lit(False)).alias("reworded"))
    typed = F.countDistinct(F.when(F.col("typed"), F.col("item_place")))
    counted = kept.groupBy("doc_id", "item_id").agg(F.countDistinct("item_place").alias("n_windows"), typed.alias("n_typed"), F.min("reworded").alias("reworded"))
    total = index.groupBy("item_id").agg(F.countDistinct("item_place").alias("n_item"), F.nullif(typed, F.lit(0)).alias("n_item_typed"))
    out = counted.join(total, "item_id").withColumn("coverage", F.greatest(F.col("n_windows") / F.col("n_item"), F.col("n_typed") / F.col("n_item_typed")))
    return out.where((F.col("coverage") >= COVERAGE) | (F.col("n_windows") >= RUN)).select("doc_id", "item_id", "n_windows", "coverage", "reworded")


def _with_size(size: int):
    return lambda w: F.struct(F.lit(size).alias("size"), w["place"].alias("place"), w["code"].alias("code"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that an item of the benchmark contaminates; all columns stay."""
    name = free_name(docs, "contaminated")
    bad = written(contaminated_pairs(docs, benchmark).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")
