"""Packing and token files against the tokenizers library, encoded text by text."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidelens.llm import packing, token_files
from tidelens.llm._bpe import BatchEncoder
from tidelens.llm.queries import vocabulary

TEXTS = [(5, "hello world, it's  fine\n\n ok"), (1, ""), (2, None), (9, "the quick brown fox " * 700), (7, "a"), (7, "a"), (3, "né <|endoftext|> 日本語 ½ 'll I'll"), (4, "x" * 3000)]
SCHEMA = "doc_id long, text string, length string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_batch_encoder_equals_the_library(reference):
    import random

    random.seed(0)
    letters = "ab'stredvlm  \n\t!1é½ 　x.́😀"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)] + [t for _, t in TEXTS]
    ids, off = BatchEncoder(vocabulary()).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == reference(text)


def test_levels_random_access():
    ids = np.random.default_rng(0).choice([0, 1, 255, 256, 65535, 65536, 70000, 2**31], 5000).astype(np.uint32)
    levels = token_files.Levels(token_files.WIDTHS, *token_files.encode_levels(ids))
    assert (levels.read(0, len(ids)) == ids).all()
    for at in (0, 1, 511, 512, 513, 4999):
        assert levels.read(at, at + 1)[0] == ids[at]
    assert (levels.read(700, 2100) == ids[700:2100]).all()
    assert len(levels.read(5, 5)) == 0


def test_token_files(docs, reference):
    rows = [tuple(r) for r in token_files.token_files(docs, vocabulary()).orderBy("start").collect()]
    expected, at = [], 0
    for doc, text in sorted(TEXTS, key=lambda x: (x[0], x[1] or "")):
        ids = [*reference(text), 0]
        expected.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        at += len(ids)
    assert rows == expected


def test_tokens_at(spark, docs, reference, tmp_path):
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, path, vocabulary(), shard_tokens=100)
    stream = [i for _, text in sorted(TEXTS, key=lambda x: (x[0], x[1] or "")) for i in [*reference(text), 0]]
    places = spark.createDataFrame([(0,), (17,), (len(stream) - 1,)], "place long")
    assert {r["place"]: r["token_id"] for r in token_files.tokens_at(spark, path, places).collect()} == {p: stream[p] for p in (0, 17, len(stream) - 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert token_files.token_files(none, vocabulary()).count() == 0
    assert packing.best_fit_packing(none, vocabulary()).count() == 0


def test_packing(docs, reference):
    rows = packing.best_fit_packing(docs, vocabulary()).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for doc, text in set(TEXTS):
        ids = [*reference(text), 2]
        copies = sum(d == doc for d, _ in TEXTS)
        own = sorted(by_doc[doc], key=lambda r: (r["piece"], r["sequence_id"]))[::copies]
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert all(r["length"] == 1024 for r in own[1:]) and own[0]["length"] == (len(ids) % 1024 or 1024)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4"))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) == -(-sum(r["length"] for r in rows) // 1024) or len(sequences) <= 1 + sum(r["length"] for r in rows) / 1024


def test_plan_covers_exactly_and_is_tight():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.minimum(rng.lognormal(5.5, 1, 20000).astype(int) + 1, 1024), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    runs = packing.plan(histogram)
    got = {}
    for times, own, copies in runs:
        assert (own * copies).sum() <= 1024
        for n, c in zip(own.tolist(), copies.tolist()):
            got[n] = got.get(n, 0) + times * c
    assert got == histogram
    assert sum(r[0] for r in runs) <= 1.01 * np.ceil((lengths * counts).sum() / 1024)
