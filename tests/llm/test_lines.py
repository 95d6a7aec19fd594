"""Line dedup against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidelens.llm import _runs
from tidelens.llm import line_dedup as L


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(line, n, rng):
    line = list(line)
    for _ in range(n):
        k = rng.randrange(len(line) + 1)
        what = rng.randrange(3)
        if what == 0:
            line.insert(k, rng.choice("abcé"))
        elif line and what == 1:
            line.pop(min(k, len(line) - 1))
        elif line:
            line[min(k, len(line) - 1)] = rng.choice("xyzü")
    return "".join(line)


def test_within_equals_the_full_table():
    rng = random.Random(1)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abé ") for _ in range(rng.randrange(1, 60)))
        pairs.append((a, edited(a, rng.randrange(5), rng)))
    for edits in (1, 2, 3):
        own = [(a, b) for a, b in pairs if min(len(a), len(b)) >= edits]
        size = np.array([len(x) for pair in own for x in pair])
        symbols = np.array([ord(c) for pair in own for x in pair for c in x])
        i = np.arange(0, 2 * len(own), 2)
        got = L.within(symbols, np.cumsum(size) - size, size, i, i + 1, edits)
        assert got.tolist() == [distance(a, b) <= edits for a, b in own]


def reworded(line, n, rng, words):
    out = line.split(" ")
    for _ in range(n):
        k = rng.randrange(len(out) + 1)
        what = rng.randrange(3)
        if what == 0:
            out.insert(k, rng.choice(words))
        elif out and what == 1:
            out.pop(min(k, len(out) - 1))
        elif out:
            out[min(k, len(out) - 1)] = rng.choice(words)
    return " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(80)]
    base = [" ".join(rng.choices(words, k=rng.choice([2, 3, 6, 9, 10, 15, 25, 35, 60]))) for _ in range(50)]
    docs = [(0, None), (1, ""), (2, "\n\n \n"), (None, base[0]), (None, base[1] + "\n" + base[1])]
    for d in range(3, 70):
        own = []
        for _ in range(rng.randrange(1, 9)):
            line = rng.choice(base)
            line = edited(line, rng.choice([0, 0, 1, 2, 4]), rng) if rng.random() < 0.5 else reworded(line, rng.choice([0, 1, 2, 3, 4]), rng, words)
            own.append(line)
        docs.append((d, "\n".join(own)))
    docs += docs[10:13]  # repeated rows
    docs.append((20, "\n".join(base[:4])))  # a shared doc_id
    rng.shuffle(docs)
    return docs


def near(a, b):
    """The definition, on whole tables of distances."""
    for x, y, allowed in ((a.split(), b.split(), lambda n: min(3, n // 10)), (a, b, lambda n: min(2, n // 16) if n <= 80 else 0)):
        m = min(len(x), len(y))
        if allowed(m) and abs(len(x) - len(y)) <= allowed(m) and distance(x, y) <= allowed(m):
            return True
    return False


def brute(docs):
    lines = {}
    for d, text in docs:
        d = L.NO_ID if d is None else d
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\f\r"):
                lines.setdefault(line, set()).add((d, k))
    names = list(lines)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if near(a, b):
                root[find(a)] = find(b)
    keep = {}
    for x in names:
        keep[find(x)] = min(min(lines[x]), keep.get(find(x), (10**9, 0)))
    lost = {}
    for x in names:
        for place in lines[x]:
            if place != keep[find(x)]:
                lost.setdefault(place[0], set()).add(place[1])
    return {d: sorted(v) for d, v in lost.items()}


@pytest.mark.parametrize("seed,short,local,block_bytes", [(1, 24, 32, 10**6), (2, 2, 3, 2000)])
def test_duplicate_lines_equal_brute_force(spark, monkeypatch, seed, short, local, block_bytes):
    for name, value in (("SHORT", short), ("LOCAL", local), ("BLOCK", 8), ("BLOCK_BYTES", block_bytes)):
        monkeypatch.setattr(_runs, name, value)
    docs = corpus(seed)
    frame = spark.createDataFrame([(d, t, 7, "s", 1) for d, t in docs], "doc_id long, text string, n_chars long, owner string, Lost int")
    lost = brute(docs)
    assert {r["doc_id"]: sorted(r["lines"]) for r in L.duplicate_lines(frame).collect()} == lost
    if short == 2:
        return
    out = L.dedup_lines(frame)
    assert out.columns == frame.columns
    lines = lambda d: lost.get(L.NO_ID if d is None else d)
    expected = [(d, t if t is None or not lines(d) else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lines(d))) for d, t in docs]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(expected, key=str)


def test_blocks_find_every_link():
    """A long run in blocks: links between components, at most one less than there are lines, and none is missed."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=24)) for _ in range(12)]
    lines = [reworded(rng.choice(base), rng.randrange(4), rng, words) for _ in range(300)]
    n = len(lines)
    table = pa.table({"line_text": lines, "root": list(range(n)), "id": list(range(n)), "asks": [True] * n, "member": [True] * n})
    a, b = L._Block(table).large(0, n)
    assert len(a) < n
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert near(lines[x], lines[y])
        parent[find(x)] = find(y)
    for x in range(n):
        for y in range(x):
            assert not near(lines[x], lines[y]) or find(x) == find(y)


def test_probes_find_every_edit():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(16, 82)))
        b = edited(a, rng.randrange(3), rng)
        short, long = sorted((a, b), key=len)
        t = int(L.point_edits(np.array(len(short))))
        if not t or distance(a, b) > t:
            continue
        probes = lambda x: [(int(size[0]), k, x[int(at[0]) : int(at[0] + n[0])], own) for _, size, k, at, n, own in L.probes(np.array([len(x)]), L.point_edits, L.MOST_POINTS) if len(at)]
        index = {p[:3] for p in probes(short) if p[3]}
        assert index & {p[:3] for p in probes(long)}


def test_edits_flip_few_sketch_bits():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(60)]
    for _ in range(300):
        a = " ".join(rng.choices(words, k=30))
        for b in (edited(a, L.MOST_POINTS, rng), reworded(a, L.MOST_WORDS, rng, words)):
            bits = L._Symbols.of(pa.array([a, b])).sketches()
            assert int(np.bitwise_count(bits[0] ^ bits[1]).sum()) <= L.MOST_FLIPS


def test_keys_tell_lines_apart():
    rng = random.Random(6)
    text = "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)) for _ in range(200))
    rows = list(L._entries(1)([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])]))
    entries = np.frombuffer(rows[0].column("entries")[0].as_py(), _runs.ENTRY)
    assert len(np.unique(entries["key"] | _runs.LOW)) == len(entries) == 200 * 26


def test_a_common_key_is_cut_within_each_slice():
    """Of an id-rich key a slice sends its leader alone to the key's bucket; all its entries go on as a long run."""
    rows = _runs.packed(np.full(1000, 5 << 40, np.uint64), np.arange(1000), 4)
    assert sum(len(x) for x in rows.column("entries").to_pylist()) == _runs.ENTRY.itemsize
    assert sum(len(x) for x in rows.column("cut").to_pylist()) == 1000 * _runs.CUT.itemsize


def test_a_cut_run_meets_the_other_slices():
    """An id that holds a cut key in another slice is in the long run with all the others, and named runs count once."""
    key = np.uint64(5 << 40)
    batches = [_runs.packed(np.full(n, key | _runs.ROLE), np.arange(a, a + n), 1) for a, n in ((0, 100), (500, 2))]
    batches.append(_runs.packed(np.repeat(np.array([7, 8, 9], np.uint64) << np.uint64(40), 9) | _runs.ROLE, np.tile(np.arange(900, 909), 3), 1))
    out = pa.Table.from_batches(list(_runs._bucket(L.may_pair, 1)(batches))).to_pylist()
    runs = {}
    for r in out:
        if r["long"]:
            runs.setdefault(r["key"], []).append(r["a"])
    assert sorted(map(sorted, map(set, runs.values()))) == [[*range(100), 500, 501], list(range(900, 909))]
    assert sorted(map(len, runs.values()))[0] == 9


def test_a_hundred_lines_differing_in_a_word_are_one_class(spark):
    words = [f"w{k}" for k in range(30)]
    text = [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(30)]
    lost = L.duplicate_lines(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in lost) == list(range(1, 30))


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
