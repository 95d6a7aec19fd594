"""The audit against SQL over every kept term of every group."""

import random

import pytest

from tidelens.llm import oracles, source_audit as A

FIELDS = "text string, lang string, source string, N int, term string"


def rows(seed):
    random.seed(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "x", "é", "Ü", "日本", "\u0085", "\U0001f600")]
    out = [(None, None, None), ("", "de", "only-empty"), ("42 -- \n", "xx", ""), ("Q", "xx", "q"), ("a b", "en", None), ("A\x00a @[`{\x7fb", "en", "s0")]
    for k in range(260):
        lang = random.choice(["en", "en", "fr", None])
        source = random.choice(["s0", "s0", "s0", *(f"s{k}" for k in range(9)), "Ä", None])
        text = " ".join(random.choices(words, k=random.randint(0, 40), weights=[1 / (i + 1) for i in range(len(words))]))
        out.append((random.choice([text, text.upper(), "1".join(text.split())]), lang, source))
    return out + out[40:60]


def want(data, least, ranks):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [[x and x.replace("\x00", "\x01") for x in r] for r in data])
    found = con.execute(f"SELECT lang, source, part, item, value, rank FROM ({oracles.source_audit(least, ranks)})")
    return sorted(found.fetchall())


@pytest.mark.parametrize("seed,tile,terms", [(1, 64, 2048), (2, 3, 7)])
def test_audit_equals_sql(spark, monkeypatch, seed, tile, terms):
    monkeypatch.setattr(A, "TILE", tile)
    monkeypatch.setattr(A, "TERMS", terms)
    monkeypatch.setattr(A, "LEAST_DOCS", 4)
    data = rows(seed)
    docs = spark.createDataFrame([(*r, 1, "clash") for r in data], FIELDS)
    got = sorted(tuple(r) for r in A.source_audit(docs).collect())
    assert got == want(data, 4, A.RANKS)
    assert any(r[2] == "pair" and r[4] == 0 for r in got)  # a language that keeps no term


def test_merged_cells_are_cut_in_utf8_order(spark):
    """Eighty terms of one cell: the first fifty by their bytes stay."""
    words = [f"{a}{b}" for a in "aéz日" for b in "abcdefghijklmnopqrst"]
    data = [(" ".join(words), "en", "a")] * 30 + [("other " * 90, "en", "b")] * 30
    got = A.source_audit(spark.createDataFrame(data, "text string, lang string, source string")).where("part = 'term' AND source = 'a'").orderBy("rank").collect()
    assert [r["item"] for r in got] == sorted(words, key=lambda w: w.encode())[:50]
    assert [r["rank"] for r in got] == list(range(1, 51)) and len({r["value"] for r in got}) == 1


def test_shares_are_exact_where_products_overflow(spark):
    big = [(0, 10**15, 10**4), (10**15, 10**15 + 7, 3), (123456789012345, 9 * 10**15 // 1001, 99), (5, 11, 1)]
    df = spark.createDataFrame(big, "c long, n long, v long")
    got = [r[0] for r in df.select(A.share(df.c, df.n, df.v)).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in big]


def test_empty_table(spark):
    assert A.source_audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
