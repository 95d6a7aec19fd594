"""Components and bounds against brute force."""

import random
import re

import numpy as np
import pytest

from tidelens.llm import _runs, jaccard_join as J
from tidelens.llm._graph import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for k, (_, text) in enumerate(rows):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORDS.findall(text or "")]
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups = {}
    for k in sets:
        groups.setdefault(find(k), []).append(rows[k][0])
    least = lambda ids: min((d for d in ids if d is not None), default=None)
    own = lambda k: least(groups[find(k)]) if sets[k] else rows[k][0]
    return sorted(((rows[k][0], len(sets[k]), own(k)) for k in sets), key=str)


def corpus(seed):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [None, "", " \n", "one two", "one  TWO", "one two three four five", "É a b c d e f", "é a b c d e f"]
    passage = " ".join(random.choices(vocabulary, k=25))
    for _ in range(25):
        base = random.choices(vocabulary, k=random.randint(8, 120))
        for _ in range(random.randint(1, 6)):
            own = list(base)
            for _ in range(random.randint(0, 3)):
                own[random.randrange(len(own))] = random.choice(vocabulary)
            texts.append(" ".join(own) + (" " + passage if random.random() < 0.4 else ""))
    hot = random.choices(vocabulary, k=90)
    for _ in range(60):
        own = list(hot)
        for _ in range(random.randint(0, 3)):
            own[random.randrange(90)] = random.choice(vocabulary)
        texts.append(" ".join(own))
    random.shuffle(texts)
    return [(3 * k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed,short", [(1, 24), (2, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, short):
    monkeypatch.setattr(_runs, "SMALL", 6)
    monkeypatch.setattr(_runs, "SHORT", short)
    monkeypatch.setattr(_runs, "BLOCK", 16)
    monkeypatch.setattr(J, "PARTNERS", 5)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "clash", 0) for d, t in rows], "doc_id long, text string, other string, point int")
    assert sorted(map(tuple, J.jaccard_components(docs).collect()), key=str) == brute(rows)
    if short == 24:
        kept = J.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_shared_and_missing_ids_keep_their_links(spark):
    """Rows of one doc_id or of none have their own texts: each keeps its links, and a row without doc_id joins two others."""
    rows = [(d if k % 4 else None if k % 8 else d // 9, t) for k, (d, t) in enumerate(corpus(3))]
    words = [f"v{k}" for k in range(60)]
    a, b, c = (" ".join(words[:n] + [f"x{k}" for k in range(n, 60)]) for n in (60, 54, 48))
    rows += [(9001, a), (None, b), (9003, c), (9005, a + " y"), (9005, "other text of the same id entirely"), (None, None), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(docs).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_finds_every_pair_that_the_bound_allows():
    rng = np.random.default_rng(0)
    sizes = rng.integers(5, 80, 300)
    points = np.array([np.bincount(rng.integers(0, J.GROUPS, n), minlength=J.GROUPS) for n in sizes])
    points[100:150] = points[50:100]
    sizes[100:150] = sizes[50:100]
    got = set(map(tuple, J.tree_pairs(points, sizes, lambda i, j: i != j).tolist()))
    want = {(i, j) for j in range(300) for i in range(j) if 100 * min(sizes[i], sizes[j]) >= 75 * max(sizes[i], sizes[j]) and np.minimum(points[i], points[j]).sum() >= J.needed(sizes[i], sizes[j])}
    assert got == want


def test_points_bound_the_overlap_at_any_size():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 40_000, np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (3, 900, 1100, 5000, 20_000, 30_000)]
    import pyarrow as pa

    own = J._Bound(pa.array([J.point(s) for s in sets], pa.binary()), np.array([len(s) for s in sets]))
    assert own.points.sum(1).tolist() == [len(s) for s in sets]
    for i in range(6):
        for j in range(6):
            assert J.finer_bound(J.point(sets[i]), J.point(sets[j])) >= len(np.intersect1d(sets[i], sets[j]))
    assert len(J.point(np.arange(3000, dtype=np.uint64) << np.uint64(40))) >= J.GROUPS  # many members in one group


def test_dense_blocks_find_every_link():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120, np.uint64)
    sets = [np.unique(np.where(rng.random(120) < rng.choice([0.05, 0.12, 0.3]), rng.integers(0, 2**63, 120, np.uint64), base)) for _ in range(150)]
    n = len(sets)
    table = pa.table({"members": pa.array([s.tobytes() for s in sets], pa.binary()), "root": np.arange(n) // 2, "asks": np.arange(n) % 3 > 0, "member": np.ones(n, bool)})
    own = J._Dense(table)
    a, b = own.large(0, n)
    assert 0 < len(a) < n and own.linked(a, b).all()
    root = np.arange(n) // 2
    for x, y in zip(a.tolist(), b.tolist()):
        root[root == root[x]] = root[y]
    for x in range(n):
        for y in range(x):
            assert root[x] == root[y] or not (x % 3 or y % 3) or not J.similar(sets[x], sets[y])


def test_graph_components(spark):
    random.seed(5)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, 500 + k) for k in range(40)] + [(random.randrange(1000, 1100), random.randrange(1000, 1100)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and all(a in got for a, b in edges if a != b)
