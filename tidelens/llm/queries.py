"""Registered queries of the training-data operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary())


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files

    return token_files(table(spark, sf_dir, "documents"), vocabulary())


@query("op4_quality_rules", oracles.quality_rules())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


@query("quality_ablations", oracles.quality_ablations())
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4's ablations: what each rule of the policy rejects, alone or with others."""
    from .quality_rules import quality_ablations as ablations

    return ablations(table(spark, sf_dir, "documents"))


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_ensemble import quality_classifier

    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_html_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import html_text

    return html_text(table(spark, sf_dir, "pages"))


@query("op3_secret_scan", oracles.secret_scan())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_scan

    return secret_scan(table(spark, sf_dir, "documents"))


@query("op8_decontamination")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated_pairs

    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_jaccard_join", oracles.jaccard_join())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


@query("op6_repeated_bytes", oracles.repeated_bytes())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeated_bytes import repeated_bytes

    return repeated_bytes(table(spark, sf_dir, "documents"))


@query("op11_source_audit", oracles.source_audit())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_audit import source_audit

    return source_audit(table(spark, sf_dir, "documents"))


@query("op12_vector_codes", oracles.vector_codes())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


@query("op13_near_duplicates", oracles.near_duplicates())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chosen_path import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))
