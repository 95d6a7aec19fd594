"""Repeated bytes against brute force."""

import hashlib
import random

import numpy as np

from tidelens.llm import repeated_bytes as R


def brute(rows):
    """A row's bytes go where a string of LENGTH bytes that covers them starts at an earlier (doc_id, place)."""
    first = {}
    texts = [(R.NO_ID if d is None else d, (text or "").encode()) for d, text in rows]
    for d, b in texts:
        for i in range(len(b) - R.LENGTH + 1):
            s = b[i : i + R.LENGTH]
            first[s] = min(first.get(s, (d, i)), (d, i))
    out = []
    for (d, b), (own, _) in zip(texts, rows):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - R.LENGTH + 1):
            if first[b[i : i + R.LENGTH]] < (d, i):
                gone[i : i + R.LENGTH] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out.append((own, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    words = [word() for _ in range(400)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passages = [make(n) for n in (15, 22, 30, 60)]
    texts = [None, "", "short", "a" * 99, "a" * 100, "a" * 350, "ab " * 200, "x" * 3000]
    for _ in range(60):
        parts = [make(rng.randrange(0, 50)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(3), rng.choice(passages))
        texts.append(" ".join(parts))
    texts += [texts[20], texts[21] + "!", "?" + texts[22], texts[23][50:300], texts[24].replace("a", "o", 3)]
    rng.shuffle(texts)
    return [(7 * k - 20, t) for k, t in enumerate(texts)]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, start string, owner int").repartition(5)
    assert sorted(map(tuple, R.repeated_bytes(docs).collect()), key=str) == brute(rows)


def test_shared_and_missing_ids_equal_brute_force(spark):
    """A repeated row keeps what its first keeps; rows of one doc_id lose their own spans only."""
    texts = [t for _, t in corpus()]
    rows = [(k // 3 if k % 5 else None, t) for k, t in enumerate(texts)] + [(2, texts[30]), (2, texts[30]), (None, texts[31]), (None, texts[31])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, R.repeated_bytes(docs).collect()), key=str) == brute(rows)


def test_hot_grams_equal_brute_force(spark):
    """A passage that is cut differently in every document makes grams with more contexts than a slice sends."""
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(14))
    other = passage[:60] + " " + "".join(rng.choice("abcdefgh") for _ in range(80))
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(d, noise(rng.randrange(60)) + rng.choice([passage, other, passage + other])[rng.randrange(4) :] + noise(rng.randrange(60))) for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = R.repeated_spans(docs)
    assert found.count() > 0
    assert sorted(map(tuple, R.repeated_bytes(docs).collect()), key=str) == brute(rows)


def test_a_slice_sends_one_mark_of_a_hot_gram():
    n = 1000
    rows = R._entries(np.full(n, 8, np.uint64), np.arange(n, dtype=np.uint64), np.arange(n), R._place(np.arange(n), np.zeros(n, np.int64)), 4)
    assert sum(map(len, rows.column("gram").to_pylist())) == 8
    assert sum(map(len, rows.column("passed_key").to_pylist())) == 8 * n


def test_equal_strings_column_by_column():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, (40, R.WIDTH)).astype(np.uint8)
    text[10:20] = text[:10]
    text[12, 140:] = 120
    text[15, :30] = 120
    left, right = rng.integers(40, R.SIDE + 1, 40), rng.integers(40, R.SIDE + 1, 40)
    got = R.equal_strings(text, left, right, np.arange(40))
    for i in range(40):
        for o in range(R.SIDE + 1):
            fits = lambda k: left[k] >= R.SIDE - o and right[k] >= o
            want = fits(i) and any(fits(k) and (text[k, o : o + R.LENGTH] == text[i, o : o + R.LENGTH]).all() for k in range(i))
            assert got[i, o] == want


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert R.repeated_bytes(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    got = R.repeated_bytes(spark.createDataFrame([(None, text), (1, text), (2, None)], schema)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {None: 0, 1: len(text), 2: 0}
