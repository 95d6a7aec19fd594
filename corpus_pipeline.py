"""A training-corpus pipeline: each stage applies one operator of ``tidelens.llm`` to all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs`` as they came, whatever other columns there are and whatever their names. Between stages the rows are written
as Parquet to the shared folder and read again. Every stage takes an empty table and returns none of its rows; ties and
equal rows are told by the operators, as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import decontamination, jaccard_join, line_dedup, packing, rule_ensemble
from tidelens.llm._shared import written
from tidelens.llm.queries import table, vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones, does not reject.

    A null text is scored as an empty one; a row without doc_id has no label but is scored; equal texts get equal scores,
    so repeated rows stay or go together. Without a labelled document nothing is rejected.
    """
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    score = next(n for n in (f"_score{k or ''}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    return rule_ensemble.scored(docs, model, score).where(F.col(score) >= rule_ensemble.THRESHOLD).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line makes a duplicate; those with no line left go.

    Null and empty texts lose nothing and stay. Of equal lines at one (doc_id, line number), as in repeated rows, each
    stays if that is the first place; a missing doc_id counts as the least one.
    """
    return line_dedup.dedup_lines(docs, emptied="drop")


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id.

    Documents without words, and rows without doc_id, stay; of rows that share the smallest doc_id all stay.
    """
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none; rows that share a doc_id (or have none) are judged together.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences.

    A null or empty text is one piece, its end id alone; repeated rows are packed each.
    """
    return packing.best_fit_packing(docs, vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", jaccard_join_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]
#: Fitting, edit distance, components and packing have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
