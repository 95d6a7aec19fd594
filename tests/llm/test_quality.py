"""Statistics and rules against plain Python, and the classifier on held-out rows."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelens.llm import quality_rules as Q
from tidelens.llm import rule_ensemble as R
from tidelens.llm._stats import text_stats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", None, " a  b\n\na  b\n a  b\nx", "é " * 17, "w " * 40, "\n\n", "a\n\x0b\na\n \n", "A B! c# " * 30, "one two three four five six seven eight nine " * 2, "x" * 5000, "THE END!! #1 <b>\n" * 9]


def plain(text):
    text = text or ""
    w = WORDS.findall(text)
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(text)


def test_statistics():
    got = text_stats(pa.array(TEXTS, pa.string()))
    for k, text in enumerate(TEXTS):
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars")) == plain(text)
    assert len(text_stats(pa.array([], pa.string()))["n_words"]) == 0


def test_ledger_policies_and_ablations(spark):
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x", 0)], "doc_id long, text string, n_words string, failed int")
    rows = Q.quality_rules(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        n, chars, symbols, dup, repeat, _ = plain(TEXTS[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])
        own = r["failed_bits"] & Q.mask(Q.POLICIES["v1"])
        assert r["ablation_bit"] == (own if own.bit_count() == 1 else 0)
    book = Q.ledger(docs).collect()
    got = {r["rule"]: r for r in Q.ablations(Q.ledger(docs), "v1").collect()}
    mask = Q.mask(Q.POLICIES["v1"])
    for rule in Q.POLICIES["v1"]:
        bit = Q.mask([rule])
        assert got[rule]["n_failed"] == sum(bool(r["failed"] & bit) for r in book)
        assert got[rule]["n_only"] == sum(r["failed"] & mask == bit for r in book)
        assert got[rule]["n_kept_without"] == sum(not r["failed"] & mask & ~bit for r in book)
    assert Q.quality_rules(docs.limit(0)).count() == 0


def test_fit_finds_a_conjunction_and_compiles_it(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.4)).astype(float)
    model = R.fit(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:300]], "a double, b double, c double")
    scores = np.array([r[0] for r in frame.select(model.column(lambda i: F.col("abc"[i]))).collect()])
    assert (((scores >= 0.5) == (y[:300] > 0)).mean()) > 0.98
    margin = model.intercept + sum(w * R.holds(rule, x[:300]) for rule, w in zip(model.rules, model.weights))
    assert np.abs(scores - 1 / (1 + np.exp(-margin))).max() < 1e-9  # the compiled column is the fitted model, row by row
    assert len(R.fit(x, np.ones(2000)).rules) == 0 and R.fit(np.zeros((0, 3)), np.zeros(0)).intercept == 0


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no test data")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = {r["doc_id"]: r for r in R.quality_classifier(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for d, r in rows.items())
    own = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert len(own) > 40 and np.mean([p == q for p, q in own]) > 0.9


def test_scoring_keeps_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s", 1), (None, "", "s", 2), (3, "a b", "s", 3)], "doc_id long, text string, score string, _stats int")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    out = R.quality_classifier(docs, labels).collect()
    assert len(out) == 3 and all(0 <= r["score"] <= 1 for r in out)
    kept = R.scored(docs, R.train(docs, labels), "_score")
    assert kept.columns == [*docs.columns, "_score"] and kept.count() == 3
