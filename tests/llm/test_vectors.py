"""Codes against Lloyd rounds by full comparison."""

import hashlib
import math

import numpy as np
import pytest

from tidelens.llm import vector_codes as V

FIELDS = "vec_id long, embedding array<float>, label int, vector string, code int"


def lloyd(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v) and len(v) % 4 == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // 4
    parts = [[tuple(v[k * w : (k + 1) * w]) for _, v, _ in kept] for k in range(4)]
    books = [list(p[:entries]) for p in parts]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for part, book in zip(parts, books):
            own = [near(p, book)[1] for p in part]
            for k in set(own):
                mine = [p for p, o in zip(part, own) if o == k]
                book[k] = tuple(sum(x) // len(mine) for x in zip(*mine))
    found = [[near(p, book) for p in part] for part, book in zip(parts, books)]
    errors = [sum(f[n][0] for f in found) for n in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    name = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{f[n][1]:02x}" for f in found), errors[n], by_label[label], name) for n, (i, _, label) in enumerate(kept)]


def rows(seed, n, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.2, (12, width))
    out = [(int(i), (centres[i % 12] + rng.normal(0, 0.02, width)).astype(np.float32).tolist(), None if i % 7 == 0 else int(i % 5)) for i in rng.permutation(n) * 3]
    one = out[5][1]
    out += [(10_000 + k, one, k % 3) for k in range(n // 3)]  # copies of one vector
    out += [(20_000 + k, (np.round(rng.normal(0, 1, width)) / 1024).tolist(), 1) for k in range(40)]  # many ties
    bad = [None, [], [0.1] * (width - 1), [0.1] * (width - 1) + [None], [float("nan")] + [0.0] * (width - 1), [float("inf")] * width, [0.5] * (2 * width)]
    out += [(5_000 + k, v, 2) for k, v in enumerate(bad)]
    out += [(None, one, 1), (None, [0.25] * width, None), (0, [0.125] * width, 3)]
    return out


@pytest.mark.parametrize("seed,n,chunk", [(1, 300, 4096), (2, 420, 300), (3, 30, 4096)])
def test_codes_equal_full_comparison(spark, monkeypatch, seed, n, chunk):
    data = rows(seed, n)
    docs = spark.createDataFrame([(*r, "clash", 0) for r in data], FIELDS).repartition(5)
    got = sorted((tuple(r) for r in V.vector_codes(docs).collect()), key=str)
    assert got == sorted(lloyd(data), key=str)


def test_tree_gives_the_lowest_nearest_entry():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.integers(-4, 5, (400, 3)), rng.integers(-900, 900, (300, 3)), np.repeat([[5, 5, 5]], 200, 0)])
    tree, order = V.Tree.built(points)
    assert (tree.points == points[order]).all()
    for k in range(len(tree.start)):
        own = tree.points[tree.start[k] : tree.end[k]]
        assert math.isclose(tree.radius[k], math.sqrt(((own - own[0]) ** 2).sum(1).max()))
        if tree.children[k]:
            below = range(tree.child[k], tree.child[k] + tree.children[k])
            assert [tree.start[c] for c in below] == [tree.start[k], *(tree.end[c] for c in below)][:-1] and tree.end[below[-1]] == tree.end[k]
    for book in (points[:40], rng.integers(-900, 900, (256, 3)), np.zeros((5, 3), np.int64)):
        start, end, entry, compared = tree.nearest(book)
        own = np.full(len(points), -1)
        for a, b, e in zip(start, end, entry):
            assert (own[a:b] == -1).all()
            own[a:b] = e
        assert (own == ((tree.points[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()
        assert compared < len(points)


def test_large_integers_stay_exact():
    rng = np.random.default_rng(5)
    points, book = rng.integers(-(2**27), 2**27, (50, 4)), rng.integers(-(2**27), 2**27, (9, 4))
    assert V.distances(points, book).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in book] for p in points]


def test_no_vector_is_kept(spark):
    assert V.vector_codes(spark.createDataFrame([], FIELDS)).count() == 0
    assert V.vector_codes(spark.createDataFrame([(1, None, 1, "", 0), (2, [], 1, "", 0)], FIELDS)).count() == 0
