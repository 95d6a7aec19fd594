"""The pipeline's stages over a small table."""

import os

import pytest
from pyspark.sql import functions as F

from . import test_jaccard, test_lines

BASE = "/root/testdata/sf0.001"


def test_stages(spark):
    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("no test data")
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    names, columns = [n for n, _ in pipeline.STAGES], docs.columns
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, base).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert all(a >= b for a, b in zip(counts, counts[1:])) and counts[-1] > 0 and counts[1] < counts[0]
    assert all(len(r["text"]) == r["n_chars"] for r in docs.collect())
    packed = pipeline.STAGES[-1][1](spark, docs, base)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_stages_equal_brute_force(spark):
    """Lines, near copies and packing of odd rows and of a table's first documents, stage by stage on the stage's own input."""
    if not os.path.isdir(BASE):
        pytest.skip("no test data")
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = dict(pipeline.STAGES)
    plain = spark.read.parquet(f"{BASE}/documents.parquet").where("n_chars < 900").select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (None, "a line without id that is quite long for a line\n\nand one more"), (10**6, ""), (10**6 + 1, "same row twice"), (10**6 + 1, "same row twice"), (10**6 + 2, " \n ")], "doc_id long, text string")
    every = plain.unionByName(odd).withColumn("n_chars", F.char_length("text").cast("long"))
    for c in ("lost", "owner", "other", "contaminated", "class", "_score"):
        every = every.withColumn(c, F.lit(1))
    for name, stage in pipeline.STAGES[:-1]:
        none = stage(spark, every.limit(0), BASE)
        assert none.columns == every.columns and none.count() == 0
    scored = stages["quality_classifier"](spark, every, BASE).cache()
    assert scored.columns == every.columns and scored.where("text = 'same row twice'").count() in (0, 2)

    rows = [(r["doc_id"], r["text"]) for r in every.collect()]
    lost = test_lines.brute(rows)
    want = []
    for d, t in rows:
        gone = lost.get(test_lines.L.NO_ID if d is None else d)
        left = t if t is None or not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        if not gone or left.strip(" \t\n\x0b\f\r"):
            want.append((d, left))
    deduped = stages["line_dedup"](spark, every, BASE).cache()
    assert deduped.columns == every.columns
    assert sorted(((r["doc_id"], r["text"]) for r in deduped.collect()), key=str) == sorted(want, key=str)

    kept = stages["ngram_jaccard_join"](spark, deduped, BASE).cache()
    assert kept.columns == every.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((d for d, _, c in test_jaccard.brute(want) if d is None or d == c), key=str)

    clean = stages["benchmark_decontamination"](spark, kept, BASE)
    assert clean.columns == every.columns and clean.where("doc_id is null").count() == kept.where("doc_id is null").count()
    packed = stages["best_fit_packing"](spark, clean, BASE).collect()
    assert sum(p["piece"] == 0 for p in packed) == clean.count()
    fill = {}
    for p in packed:
        fill.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
