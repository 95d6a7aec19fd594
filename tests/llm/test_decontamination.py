"""Contaminated pairs of hand-made documents, and exact passages against a brute-force search."""

from pyspark.sql import functions as F

from tidelens.llm.decontamination import canonical, contaminated_pairs, decontaminate

ITEM = "A train leaves Boston at 40 miles an hour. How far does it go in 3 hours if Mary drives at 40 miles an hour?"
BENCH = [(0, ITEM), (1, "the ruhe zin of tael mor pask weno dri lute bern osk vaim terre noll"), (2, "only four words here"), (3, None), (4, "two words")]
DOCS = [
    (1, f"Some intro text. {ITEM} And more."),
    (2, "Blah blah. A train leaves Denver at 65 miles an hour. How far does it go in 7 hours if Alice drives at 65 miles an hour? End."),
    (3, "Blah blah. A train leaves Denver at 65 miles an hour. How far does it go in 7 hours if Alice drives at 70 miles an hour? End."),
    (4, "an innocent text about trains and hours that shares nothing of length with any of the items in the list"),
    (5, "x " * 3000 + "THE ruhe, zin of tael mor pask: weno dri lute bern osk vaim terre noll " + "y " * 3000),
    (6, None), (7, ""), (8, "prefix only four words here suffix"), (5, "again"), (9, "the ruhe zin of tael mor pask weno"),
]


def test_canonical(spark):
    row = spark.createDataFrame([("He paid 3.50 dollars to Jane Doe, 20kg (12%).",)], "t string").select(canonical(F.col("t")).alias("c")).first()
    assert row["c"] == "he paid \ue001 \ue002 to \ue003 \ue003 \ue001\ue002 \ue001\ue002"


def test_pairs(spark):
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in DOCS], "doc_id long, text string, item_id string, coverage int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated_pairs(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 0), (5, 1), (8, 2)}
    assert not got[1, 0]["reworded"] and got[2, 0]["reworded"] and got[1, 0]["coverage"] == 1.0
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 7, 9]


def test_empty(spark):
    docs, bench = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    assert contaminated_pairs(docs.limit(0), bench).count() == 0
    assert contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == len(DOCS)


def test_passages_of_generated_documents(spark):
    import os
    import re

    import pytest

    base = "/root/testdata/sf0.001"
    if not os.path.isdir(base):
        pytest.skip("no test data")
    docs, bench = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/benchmark.parquet")
    flat = lambda t: " ".join(re.findall(r"[^\W\d_]+", (t or "").lower()))
    items = [(r["item_id"], flat(r["text"])) for r in bench.collect()]
    brute = {(r["doc_id"], i) for r in docs.collect() for i, t in items if t and f" {t} " in f" {flat(r['text'])} "}
    got = {(r["doc_id"], r["item_id"]) for r in contaminated_pairs(docs, bench).collect()}
    assert brute and brute <= got
    assert {d for d, _ in got} == {d for d, _ in brute}


def test_items_of_one_to_five_windows_at_every_place(spark):
    plain = "zin tael mor pask weno dri lute bern osk vaim terre noll".split()
    bench = spark.createDataFrame([(n, " ".join(f"{w}{'abcde'[n - 8]}" for w in plain[:n])) for n in range(8, 13)], "item_id long, text string")
    docs = [(10 * r["item_id"] + k, "a " * k + r["text"] + " b") for r in bench.collect() for k in range(3)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in contaminated_pairs(docs, bench).collect()} == {(10 * n + k, n) for n in range(8, 13) for k in range(3)}


def test_slots(spark):
    item = "the farmer sold 3 apples and then 5 pears to his old friend before going home with 3 apples, and a smile"
    long = "the farmer sold 3 apples and then he walked along the river for a while with his old dog until the sun went down over the hills and sold 3 apples"
    bench = spark.createDataFrame([(0, item), (1, long)], "item_id long, text string")
    docs = [
        (1, "Now " + item.replace("3", "4").replace("5", "4") + " again"),
        (2, "Now " + item.replace("3", "(7)", 1).replace("3", "7,") + " again"),
        (3, "Now " + item.replace("3", "7", 1) + " again"),
        (4, "Now " + long[::-1].replace("3", "8", 1)[::-1]),
    ]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated_pairs(docs, bench).collect()}
    # Two values that turn equal, values with other punctuation; a value that stands for two; a long verbatim part beside such a value.
    assert (1, 0) in got and (2, 0) in got and (4, 1) in got


def test_items_with_few_literals(spark):
    items = ["What is 12 + 45 - 7 * 3 ?", "1 2 3 5 8 13 21 34 55 89", "Anna Lee, Bob Ray, Cy Poe, Dee Fox, Ed Orr", "The Old Man And The Sea By Ernest", "Who won?", "we saw Anna Lee Bob Ray Cy Poe Dee Fox"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = [(10 * i + k, f"{'so ' * k}{t.lower() if k == 2 else t} thus") for i, t in enumerate(items) for k in range(3)]
    docs += [(100, "What is 13 + 46 - 8 * 4 ?"), (101, "2 3 5 8 14 21 34 55 90 and some"), (102, "Anna Ray, Bob Lee, Cy Fox, Dee Poe, Ed Orr"), (103, "who has won")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated_pairs(docs, bench).collect()}
    assert {(10 * i + k, i) for i in range(len(items)) for k in range(3)} <= got
    assert not {d for d, _ in got} & {100, 101, 102, 103}


def brute(docs, bench):
    """The definition, window by window, in plain Python."""
    import regex

    from tidelens.llm import decontamination as D

    def canon(t):
        t = regex.sub(r"\p{N}++(?:[.,:/]\p{N}++)*+", D.NUMBER, t)
        t = regex.sub(rf"(?<={D.NUMBER})([ \t-]?)(?:(?i:{D.UNITS})\b|[%$€£°])", lambda m: m[1] + D.UNIT, t)
        t = regex.sub(r"(?=\p{Lu})(?<=[^.!?:\s][ \t])\p{Lu}[\p{L}\p{M}'’-]*+", D.NAME, t)
        return regex.sub(rf"[^\p{{L}}\p{{M}}\s{D.NUMBER}{D.UNIT}{D.NAME}]++", "", t.lower())

    def value(w):
        w = regex.sub(r"[^\p{L}\p{M}\p{N}.,:/]++", "", w)
        return regex.sub(r"(?<!\p{N})[.,:/]++|[.,:/]++(?!\p{N})", "", w).lower()

    held = lambda w: any(x in w for x in (D.NUMBER, D.UNIT, D.NAME))

    def aligned(t):
        both = [(c, r) for c, r in zip(regex.split(r"[ \t\n\x0B\f\r]+", canon(t)), regex.split(r"[ \t\n\x0B\f\r]+", t)) if c]
        return [c for c, _ in both], [value(r) if held(c) else c for c, r in both]

    out = set()
    by_doc = {}
    for d, t in docs:
        if t is not None:
            by_doc.setdefault(d, []).append(aligned(t))
    for i, t in bench:
        if t is None:
            continue
        c, r = aligned(t)
        if not c:
            continue
        size = min(len(c), D.WINDOW)
        places = range(len(c) - size + 1)
        typed = {p: len(c) >= D.SHORTEST and sum(not held(w) for w in c[p : p + size]) >= min(D.LITERALS, size) for p in places}
        for d, texts in by_doc.items():
            hits = []
            for dc, dr in texts:
                for q in range(len(dc) - size + 1):
                    windows = {tuple(dc[q : q + size]), tuple(dr[q : q + size])}
                    for p in places:
                        if typed[p] and tuple(c[p : p + size]) in windows or tuple(r[p : p + size]) in windows:
                            hits.append((q - p, p, tuple(zip(dc[q : q + size], r[p : p + size], dr[q : q + size]))))
            slots = {}
            for shift, _, pairs in hits:
                for template, a, b in pairs:
                    if held(template):
                        slots.setdefault(shift, {}).setdefault(a, set()).add(b)
            kept = {p for shift, p, pairs in hits if all(a == b for _, a, b in pairs) or all(len(v) == 1 for v in slots.get(shift, {}).values())}
            n_typed = sum(typed.values())
            coverage = max(len(kept) / len(places), sum(typed[p] for p in kept) / n_typed if n_typed else 0)
            if kept and (coverage >= D.COVERAGE or len(kept) >= D.RUN):
                out.add((d, i))
    return out


def test_pairs_equal_brute_force(spark):
    """What must be found and what must not: verbatim, re-parameterised and inconsistently changed passages among unlike texts."""
    import random
    import re

    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(60)]
    names = ["Alice", "Boston", "Carol", "Denver", "Ella"]
    word = lambda: rng.choice(words) if rng.random() < 0.75 else rng.choice([str(rng.randrange(1, 99)), rng.choice(names), f"{rng.randrange(9)} hours"])
    items = [" ".join(word() for _ in range(rng.choice([1, 3, 5, 8, 9, 12, 20, 30]))) for _ in range(40)]
    docs = []
    for d in range(160):
        item = rng.choice(items)
        how = rng.randrange(5)
        if how == 1:  # re-parameterised: every number stands for one other
            item = re.sub(r"\d+", lambda m: str(int(m[0]) + 3), item)
        elif how == 2:  # changed at random
            item = re.sub(r"\d+", lambda m: str(rng.randrange(1, 99)), item)
        elif how == 3:  # a part of it
            own = item.split()
            item = " ".join(own[rng.randrange(len(own)) :])
        elif how == 4:
            item = ""
        docs.append((d if d % 40 else 7, " ".join(word() for _ in range(rng.randrange(30))) + " " + item + ", " + " ".join(word() for _ in range(rng.randrange(30)))))
    bench = list(enumerate(items))
    got = contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute(docs, bench)
    assert any(r["reworded"] for r in got)
    assert sorted({d for d, _ in brute(DOCS, BENCH)}) == [1, 2, 5, 8]
