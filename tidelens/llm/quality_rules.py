"""Operator 4: a ledger of quality rules.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies are named sets of rules, so a new policy version, or the effect of leaving a rule out, is
a bitwise test or aggregate over the ledger and never another pass over texts.

Defined cases: a null or empty text has no words and fails ``too_few_words``; repeated rows are judged
each; the ledger keeps doc_id and its own columns only, whatever other columns the input has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._stats import STATS, with_stats

#: Name and failing condition (over the statistics) of each rule; a rule's place is its bit, so new rules go last.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "n_words > 0 and 100 * n_symbols > 15 * n_words"),
    ("capitals", "n_words > 0 and 100 * n_upper_words > 30 * n_words"),
    ("exclamations", "n_words > 0 and 100 * n_exclaimed > 30 * n_words"),
    ("repeated_lines", "n_lines > 3 and 100 * n_dup_lines > 50 * n_lines"),
    ("long_words", "n_words > 0 and word_chars > 15 * n_words"),
    ("few_distinct_words", "n_words between 20 and 400 and 100 * n_distinct_words < 30 * n_words"),
]
#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": ["too_few_words", "repeated_windows", "symbols", "capitals", "exclamations", "repeated_lines", "long_words", "few_distinct_words"],
}


def mask(rules: list[str]) -> int:
    """The bits of the named rules."""
    places = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << places[r] for r in set(rules))


def failure_bits() -> Column:
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, condition) in enumerate(RULES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, and ``failed``: a bit for each rule that the document fails."""
    return with_stats(docs.select("doc_id", "text"), "stats").select("doc_id", *(F.col(f"stats.{s}").alias(s) for s in STATS)).withColumn("failed", failure_bits())


def fails(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept``: whether the document fails no rule of the policy."""
    return book.withColumn("kept", ~fails(policy))


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy keeps without it.

    The ledger is first counted by its bits (at most 2 ** rules rows), so the rest does not grow.
    """
    bits = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask([r])).cast("long").alias("bit")) for r in POLICIES[policy]))).alias("r")
    fails_it, without = F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("failed").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return (
        bits.select("failed", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(fails_it, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(fails_it & without, F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(without, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )


def only_failure(policy: str) -> Column:
    """The bit of the rule without which the policy would keep the document: that of its only failure (0 if it fails none, or several)."""
    own = F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy])))
    return F.when(F.bit_count(own) == 1, own).otherwise(F.lit(0).cast("long"))


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger, written to the shared folder: policies and ablations read it, not the texts."""
    return written(ledger(docs), "quality-ledger")


def quality_rules(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger's contract columns with the base verdict and the policy's, the failure bits and the ablation bit."""
    book = apply_policy(stored_ledger(docs), policy).withColumn("base_failed", fails("base"))
    kept = (F.col("kept") & ~F.col("base_failed")).alias("kept")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept, F.col("failed").alias("failed_bits"), only_failure(policy).alias("ablation_bit"))


def quality_ablations(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ablations of a policy over the documents' stored ledger."""
    return ablations(stored_ledger(docs), policy)
