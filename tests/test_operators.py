"""Operators on hand-computed frames, one at least per trap."""

import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidelens.operators import analysis, correlate, enrich, normalize, rubric, search, stats, synthesis, trends
from tidelens.sources import sinks

DAY = datetime(2024, 1, 1)


def series(spark, **counts):
    rows = [(k, DAY + timedelta(days=i)) for k, own in counts.items() for i, n in enumerate(own) for _ in range(n)]
    return spark.createDataFrame(rows, "keyword string, ts timestamp_ntz")


def test_series_metrics(spark):
    got = {r["keyword"]: r for r in trends.series_metrics(trends.timeline(series(spark, up=[1, 2, 3], flat=[1, 1, 1], gap=[1, 0, 2]))).collect()}
    assert got["up"]["velocity"] == pytest.approx(0.5) and got["up"]["strength"] == pytest.approx(0.44) and got["up"]["trend_type"] == "emerging"
    assert got["flat"]["velocity"] == 0 and got["flat"]["strength"] == pytest.approx(0.33) and got["flat"]["trend_type"] == "stable"
    assert got["gap"]["days"] == 2 and got["gap"]["velocity"] == pytest.approx(1 / 1.5)  # observed days, not calendar days
    assert got["up"]["peak_day"] == date(2024, 1, 3) and got["flat"]["peak_day"] == date(2024, 1, 1)


def test_emergence(spark):
    m = series(spark, late=[0] * 7 + [1] * 7, even=[1] * 14).withColumnRenamed("keyword", "topic")
    got = {r["topic"]: r for r in trends.emergence(trends.dense_timeline(m, "2024-01-01", "2024-01-14"), "2024-01-14").collect()}
    assert got["late"]["emergence_score"] == 1.0 and got["even"]["emergence_score"] == pytest.approx(0.5)
    assert got["late"]["emergence_date"] == date(2024, 1, 7) and got["even"]["emergence_date"] is None
    assert got["late"]["recent_points"] == [1] * 7 and got["even"]["growth_rate"] == 0


def test_pairs(spark):
    e = spark.createDataFrame([(p, "keyword", x) for p, own in ((1, "abc"), (2, "bcd"), (3, "abc")) for x in own] + [(1, "topic", "T"), (3, "topic", "t")], "paper_id long, kind string, element string")
    got = [r.asDict() for r in correlate.paper_pairs(e).collect()]
    assert len(got) == 1 and (got[0]["paper_a"], got[0]["paper_b"]) == (1, 3)
    assert got[0]["score"] == pytest.approx(0.7) and got[0]["kind"] == "keyword" and got[0]["shared"] == ["a", "b", "c"] and got[0]["confidence"] == pytest.approx(0.6)


def test_pairs_equal_brute_force_with_a_keyword_that_all_hold(spark):
    import random

    rng = random.Random(7)
    papers = {}
    for p in range(60):
        papers[p] = {"keyword": {"hot", *rng.sample("abcdefghijklmnop", rng.randrange(0, 6))}, "entity": set(rng.sample("uvwxyz", rng.randrange(0, 4))), "topic": set(rng.sample("12345", rng.randrange(0, 3)))}
    rows = [(p, kind, x) for p, kinds in papers.items() for kind, own in kinds.items() for x in own]
    want = {}
    for a in papers:
        for b in range(a + 1, 60):
            score = sum(w * (len(papers[a][k] & papers[b][k]) / len(papers[a][k] | papers[b][k]) if papers[a][k] and papers[b][k] else 0) for k, w in correlate.KINDS.items())
            if score >= 0.3 - 1e-12:
                want[a, b] = score
    got = {(r["paper_a"], r["paper_b"]): r["score"] for r in correlate.paper_pairs(spark.createDataFrame(rows, "paper_id long, kind string, element string")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_pairs_join_by_equality(spark):
    e = spark.createDataFrame([(1, "keyword", "a")], "paper_id long, kind string, element string")
    plan = correlate.paper_pairs(e)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_clusters(spark):
    t = spark.createDataFrame([(p, "main", 1) for p in (1, 2, 3)] + [(1, "side", 2), (4, "rare", 1)], "paper_id long, topic string, rank int")
    k = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "z")], "paper_id long, keyword string")
    r = correlate.topic_clusters(t, k).collect()
    assert len(r) == 1 and r[0]["size"] == 3 and r[0]["coherence"] == pytest.approx(1 / 3) and r[0]["related_topics"] == ["side"] and r[0]["central_keywords"] == ["x", "y", "z"]


def test_summaries_keep_order_and_short_texts(spark):
    d = spark.createDataFrame([(1, "One. Two. Three."), (2, "alpha alpha. beta. gamma gamma. delta. alpha gamma. the. and."), (3, "")], "document_id long, text string")
    got = {r["document_id"]: r["summary"] for r in analysis.summaries(d).collect()}
    assert got[1] == "One. Two. Three." and got[3] == ""
    assert got[2].startswith("alpha alpha.") and "the." not in got[2]


def test_sentiment_and_full_analysis(spark):
    d = spark.createDataFrame([(1, "A good great day. Bad dataset called Alpha."), (2, "")], "document_id long, text string")
    got = {r["document_id"]: r for r in analysis.analyze(d).collect()}
    assert got[1]["polarity"] == pytest.approx((0.7 + 0.8 - 0.7) / 3) and got[1]["sentiment_label"] == "positive"
    assert got[1]["entities"]["DATASET"] == ["Alpha"] or got[1]["entities"]["DATASET"] == ["called"]
    assert got[2]["word_count"] == 0 and got[2]["sentence_count"] == 0 and got[2]["readability"] == 0


def test_merges(spark):
    a = spark.createDataFrame([(1, "a", 10, 1), (1, "b", 20, 2)], "id long, v string, created int, seq int")
    b = spark.createDataFrame([(1, "c", 30, 3), (2, "x", 5, 1)], "id long, v string, created int, seq int")
    assert sorted(map(tuple, sinks.latest_wins(a, b, ["id"], ["created"]).collect())) == [(1, "c", 10, 3), (2, "x", 5, 1)]
    old = spark.createDataFrame([(1, "k", 1.0, 0), (2, "k", 2.0, 0)], "parent long, keyword string, score double, seq int")
    new = spark.createDataFrame([(1, "n", 3.0, 1), (1, "n", 4.0, 2)], "parent long, keyword string, score double, seq int")
    assert sorted(map(tuple, sinks.replace_children(old, new, "parent", ["keyword"]).collect())) == [(1, "n", 4.0, 2), (2, "k", 2.0, 0)]
    r = "document_id string, provider string, research_quality_score double, seq int"
    merged = sinks.merge_reports(spark.createDataFrame([("d", "p", 5.0, 1)], r), spark.createDataFrame([("d", "q", 7.0, 2)], r)).first()
    assert merged["provider"] == "p" and merged["research_quality_score"] == 7.0


def test_search(spark):
    d = spark.createDataFrame([(1, "Deep learning", "on graphs", "a", DAY), (2, "Deep", "sea", "a", None), (3, "learning deep", "", "b", DAY + timedelta(days=1))], "id long, title string, content string, source_type string, published_date timestamp_ntz")
    assert [r["id"] for r in search.search_all(d, "deep learning").collect()] == [3, 1]
    assert [r["id"] for r in search.search_all(d, "deep learning", ["a"]).collect()] == [1]
    assert search.search_all(d, "the").count() == 0 == search.search_all(d, "").count()
    many = search.search_many(search.inverted_index(d), spark.createDataFrame([(1, "deep"), (1, "learning"), (2, "sea")], "query_id long, term string"))
    assert sorted(map(tuple, many.collect())) == [(1, 1), (1, 3), (2, 2)]
    c = spark.createDataFrame([("one two three four five six seven eight nine ai",), ("only nine words here with ai in it ok",)], "text string")
    assert search.comments(c).count() == 1


def test_insider_filings(spark):
    f = spark.createDataFrame([("1", "4", "2024-01-05", "a"), ("1", "4", "2023-01-05", "b"), ("1", "4", "odd", "c"), ("1", "4", None, "d"), ("1", "10-K", "2024-01-05", "e")], "cik string, form_type string, filing_date string, filename string")
    assert sorted(r["filename"] for r in search.insider_filings(f, "2024-01-08").collect()) == ["a", "c"]


def test_content_rows_fall_back_by_key(spark):
    rows = [("s", "1", DAY, {"content": "", "abstract": "a long abstract"}), ("s", "2", DAY, {"abstract": "a long abstract", "pdf_url": "u"}), ("s", "3", DAY, {"content": "short"})]
    d = spark.createDataFrame(rows, "source_type string, source_id string, collected_at timestamp, data map<string,string>")
    got = normalize.content_rows(d).collect()
    assert [(r["source_id"], r["url"]) for r in got] == [("2", "u")]


def test_normalizers(spark):
    f = spark.createDataFrame([("public_docs", "s", DAY, "8-K", "Acme Big Corp Inc", "12", "2024-01-05", "Current Report", None, "u")], "source_type string, source_id string, collected_at timestamp, form_type string, company_name string, cik string, filing_date string, form_description string, summary string, filing_url string")
    r = normalize.filing(f, "2024-01-05").first()
    assert r["title"] == "8-K: Acme Big Corp Inc (CIK: 12)" and r["keywords"] == ["8-K", "Acme", "Big", "Corp"] and r["summary"] == "Current Report filed by Acme Big Corp Inc"
    assert r["content"] == "Filing Type: Current Report | Company: Acme Big Corp Inc | Central Index Key (CIK): 12" and r["metrics"] == {"importance": 9.0}
    a = spark.createDataFrame([("academic", "x", DAY, "T", "Abs", ["A"], "2024-01-01T00:00:00Z", "u", None, ["c"], 3, None, None)], "source_type string, source_id string, collected_at timestamp, title string, abstract string, authors array<string>, published string, url string, keywords array<string>, categories array<string>, citations int, downloads int, impact_factor double")
    got = normalize.union(normalize.filing(f, "2024-01-05"), normalize.academic(a)).where("source_type = 'academic'").first()
    assert got["metrics"] == {"citations": 3.0} and got["title"] == "T"


def test_enrichment(spark):
    long = "word " * 40
    pages = spark.createDataFrame([("u", f"<html><head><meta name=\"author\" content=\"Ann\"></head><body><h1>A title here</h1><nav>menu</nav><article>{long}&amp; Search end</article></body></html>"), ("v", "<body><p>tiny homeless</p></body>")], "url string, html string")
    got = {r["url"]: r for r in enrich.page_fields(pages).collect()}
    assert got["u"]["title"] == "A title here" and got["u"]["author"] == "Ann" and got["u"]["content"] == long + "& Search end" and "Search" not in got["u"]["clean_text"]
    assert got["v"]["clean_text"] == "tiny less"  # navigation words go inside words too
    c = spark.createDataFrame([(1, "u", "web", ""), (2, "zzz", "web", "abc"), (3, "https://arxiv.org/abs/1", "a", "abc")], "id long, url string, source_type string, content string")
    m = {r["id"]: r for r in enrich.merge_pages(c, enrich.page_fields(pages).withColumn("success", F.lit(True))).collect()}
    assert m[1]["ratio"] == float("inf") and m[1]["success"] and m[2]["ratio"] == 1.0 and not m[2]["success"] and m[3]["enrichment_type"] == "pdf_extract"


def test_contents_stay_one_row_each(spark):
    """Two fetched pages of one url, and two contents of it."""
    c = spark.createDataFrame([(1, "u", "web", "ab"), (2, "u", "web", "cd"), (3, "v", "web", "ef")], "id long, url string, source_type string, content string")
    pages = spark.createDataFrame([(1, "u", "old", True), (2, "u", "zz", False), (2, "u", "page", True), (3, "v", "", True), (3, "v", None, None)], "id long, url string, clean_text string, success boolean")
    by_url = {r["id"]: r["enriched_content"] for r in enrich.merge_pages(c, pages, " ").collect()}
    assert by_url == {1: "ab page", 2: "cd page", 3: "ef"} and enrich.merge_pages(c, pages).count() == 3
    by_id = enrich.merge_pages(c, pages.drop("url"), " ", key="id").collect()
    assert sorted((r["id"], r["enriched_content"], r["success"]) for r in by_id) == [(1, "ab old", True), (2, "cd page", True), (3, "ef", False)]


def test_page_elements_nest(spark):
    words = "Some words of the page. " * 6
    nested = f'<body><header><p class="byline">By <b>Ann</b> Lee</p></header><div class="lead content"><div><p>{words}</p></div><nav>menu<nav>deep</nav></nav><p>The end.</p></div><p>outside</p></body>'
    open_ = f"<h1>Left <i>open<div id='content'>{words}<footer>gone"
    dated = '<time datetime="2024-03-05">x</time><title>A page with &lt;time&gt;</title><span class="date">2020-01-01</span>'
    rows = [("a", nested), ("b", open_), ("c", dated), ("d", None), ("e", "")]
    got = {r["url"]: r for r in enrich.page_fields(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got["a"]["content"] == f"{words}The end." and got["a"]["author"] == "By Ann Lee"
    assert got["b"]["content"] == words.strip() and got["b"]["title"].startswith("Left open Some words")
    assert got["c"]["published_date"] == datetime(2024, 3, 5) and got["c"]["title"] == "A page with <time>"
    assert got["d"]["content"] == got["e"]["content"] == "" and got["d"]["word_count"] == 0


def test_rubric(spark):
    raw = ['{"research_quality_score": 7.5, "novel_contributions": ["a"]}', 'x ```json\n{"research_quality_score": 8 (Paper 1), "novel_contributions": ["b"],}\n``` y', 'no json', '"research_quality_score": 6, "novel_contributions": ["c", "d"] and {broken']
    got = rubric.parse_responses(spark.createDataFrame(list(enumerate(raw)), "response_id long, raw_response string")).orderBy("response_id").collect()
    assert [r["research_quality_score"] for r in got] == [7.5, 8.0, None, 6.0]
    assert [r["novel_contributions"] for r in got] == [["a"], ["b"], None, ["c", "d"]] and got[2]["error"]
    s = spark.createDataFrame([(["a", "b"], (8.0, None, 6.0, 7.0), {"m": "x"}), ([], None, {})], "c array<string>, s struct<novelty:double,technical_rigor:double,practical_impact:double,theoretical_contribution:double>, m map<string,string>")
    assert [r[0] for r in s.select(rubric.quality_score("c", "s", "m")).collect()] == [0.95, 0.0]
    t = spark.createDataFrame([(1, "Contribution: a new and useful thing\nMethod: short\nContribution: the last one that counts here")], "response_id long, raw_response string")
    r = rubric.labelled_lines(t).first()
    assert r["contribution"] == "the last one that counts here" and r["approach"] == "short" and r["completeness"] == 2.0
    assert spark.range(1).select(rubric.list_response(F.lit("- one\n2. two\n"))).first()[0] == ["one", "two"]


def test_mining(spark):
    p = spark.createDataFrame([("d", 0, "Fast: x", "We look at things. A novel method cuts cost by 20%. It allows much more work"), ("d", 1, "Text embedding", "Short one")], "document_id string, at int, title string, abstract string")
    r = rubric.mine_insights(p).first()
    assert r["mined_contributions"] == ["A novel method cuts cost by 20%."] and r["mined_innovations"] == ["A novel method cuts cost by 20%."]
    assert r["mined_implications"] == ["A novel method cuts cost by 20%.", "Improved text embeddings enable better search and recommendation systems"]


def test_synthesis(spark):
    p = spark.createDataFrame([(k, f"vision {k}", "image attention", ["A", f"B{k}"], ["graph network"], ["medical use"]) for k in range(5)], "paper_id long, title string, abstract string, authors array<string>, innovations array<string>, implications array<string>")
    t = {r["trend_name"]: r for r in synthesis.all_trends(p).collect()}
    assert t["graph"]["confidence"] == 1.0 and t["graph"]["timeframe"] == "established" and "Attention Mechanisms" in t and "Healthcare" in t
    row = synthesis.synthesize(p).first()
    assert row["papers"] == 5 and row["single_domain"] and row["small_sample"]
    assert synthesis.synthesize(p.limit(4)).count() == 0
    c = synthesis.collaboration(p).first()
    assert c["prolific"] == 1 and c["researchers"] == ["A"] and c["diversity"] == pytest.approx(0.6)


def test_statistics(spark):
    none = spark.createDataFrame([], "id string, source_type string, content string, collected_at timestamp_ntz")
    assert stats.executive_summary(none, none).first()["coverage"] == 0.0
    r = spark.createDataFrame([(None, DAY, 1), (5.0, DAY, 1), (8.0, DAY, 1)], "research_quality_score double, timestamp timestamp_ntz, tokens_used long")
    got = stats.report_stats(r, "2024-01-10").first()
    assert (got["high_quality"], got["medium_quality"], got["low_quality"], got["total"]) == (1, 1, 0, 3)
    m = series(spark, a=[1, 0, 1], b=[0, 0, 1])
    assert [x["keyword"] for x in stats.new_keywords(m).collect()] == ["b"]  # the day before with data is the first


def test_text_files_are_analysed_whole(spark, tmp_path):
    """One document a file, named by its path."""
    (tmp_path / "a.txt").write_text("Graph methods work well. Graph methods scale.\nThey are good.\n")  # the line end after the last full stop begins an empty sentence
    (tmp_path / "b.txt").write_text("!")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in analysis.analyze_files(spark, "file://" + str(tmp_path)).collect()}
    assert set(rows) == {"a.txt", "b.txt"} and len({r["document_id"] for r in rows.values()}) == 2
    assert (rows["a.txt"]["word_count"], rows["a.txt"]["sentence_count"]) == (13, 4) and rows["a.txt"]["keywords"]
    assert (rows["b.txt"]["word_count"], rows["b.txt"]["sentence_count"], rows["b.txt"]["keywords"]) == (1, 1, None)


def test_papers_behind_trends_and_connections(spark):
    rows = [(w, f"2024-01-0{day}", 10 * day + k, dom) for w, n in (("up", 5), ("once", 1)) for day in range(1, n + 1) for k in range(day) for dom in ("general", "ai")]
    m = spark.createDataFrame(rows, "keyword string, ts string, paper_id long, domain string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    signals = trends.keyword_trends(m, floor=0.0)
    assert [(r["keyword"], r["n_papers"], r["domains"]) for r in signals.collect()] == [("up", 15, ["ai"])]
    assert {(r["keyword"], r["paper_id"]) for r in trends.trend_papers(signals, m).collect()} == {("up", 10 * day + k) for day in range(1, 6) for k in range(day)}
    p = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (3, "c")], "paper_id long, domain string")
    k = spark.createDataFrame([(1, f"w{i:02d}") for i in range(12)] + [(2, "w00"), (3, "z")], "paper_id long, keyword string")
    assert {tuple(r) for r in correlate.bridge_papers(p).collect()} == {("a", "b", 1), ("a", "b", 2), ("b", "c", 3)}
    (row,) = correlate.research_connections(p, k).collect()
    assert (row["bridges"], row["shared_keywords"], row["strength"]) == (2, [f"w{i:02d}" for i in range(10)], 2 / 3)


def test_terms_are_counted_inside_their_documents(spark):
    """Ranks as counting by hand gives them, of a word that comes 30,000 times as well, and nothing but the table's own dealing is shuffled or sorted."""
    from collections import Counter

    texts = ["alpha beta alpha gamma beta alpha", "", None, "zeta " * 30_000 + "yota yota yotas", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}xx" for k in range(300)), "x1 the of ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    for ranked, grams, top in ((analysis.frequency_keywords(docs), (1,), 10), (analysis.tfidf_keywords(docs), (1, 2, 3), 100)):
        got = ranked.collect()
        for d, text in enumerate(texts):
            words = [w for w in (text or "").split() if w.isalpha() and w not in ("the", "of") and len(w) > (3 if len(grams) == 1 else 1)]
            terms = Counter(" ".join(words[i : i + k]) for k in grams for i in range(len(words) - k + 1))
            want = sorted(terms.items(), key=lambda x: (-x[1], x[0]))[:top]
            name, n = ("keyword", "frequency") if len(grams) == 1 else ("term", "n")
            assert [(r[name], r[n]) for r in got if r["document_id"] == d] == want
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Exchange", "Window", "Sort", "Aggregate"))
    counts = {(r["document_id"], r["term"]): r["n"] for r in analysis.term_counts(docs).collect()}
    assert counts[3, "zeta"] == 30_000 and counts[0, "alpha"] == 3 and len(counts) == 3 + 3 + 300 + 1


def test_analysis_shuffles_nothing(spark):
    text = "Alpha beta. Beta beta! Gamma? The. Delta alpha. Beta gamma gamma. Epsilon."
    docs = spark.createDataFrame([(1, text, "x"), (2, "...  ! a. b. c. d. e. 1.", "y"), (3, None, "z")], "document_id long, text string, path string")
    out = analysis.analyze(docs, also=("path",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = {r["path"]: r for r in out.collect()}
    # The weight of a term rises with its number: beta 4 times, gamma 3, alpha 2; "The." has no content word.
    assert got["x"]["summary"] == "Alpha beta. Beta beta! Gamma? Delta alpha. Beta gamma gamma."
    assert got["x"]["topics"] == ["alpha beta", "beta beta", "beta gamma", "alpha beta beta", "beta beta beta"]
    assert (got["y"]["polarity"], got["y"]["sentiment_label"], got["y"]["neutral_sentences"]) == (0.0, "neutral", 8) and got["z"]["keywords"] is None and got["z"]["entities"] is None
    lexicon = spark.createDataFrame([("alpha", 0.5, 0.25), ("beta", -1.0, 1.0)], "word string, polarity double, subjectivity double")
    own = {r["document_id"]: r for r in analysis.analyze(docs, lexicon).collect()}
    assert own[1]["polarity"] == pytest.approx((2 * 0.5 - 4) / 6) and own[1]["summary"] == got["x"]["summary"] and own[3]["sentiment_label"] == "neutral"


def test_pairs_meet_in_blocks_and_are_not_shuffled(spark, monkeypatch):
    import random

    rng = random.Random(3)
    papers = {p: {"keyword": {"hot", *rng.sample("abcdefgh", rng.randrange(0, 4))}, "entity": set(rng.sample("xyz", rng.randrange(0, 3))), "topic": {rng.choice("12")}} for p in range(40)}
    jaccard = lambda x, y: len(x & y) / len(x | y) if x & y else 0.0
    score = lambda p, q: sum(w * jaccard(papers[p][k], papers[q][k]) for k, w in correlate.KINDS.items())
    want = {(p, q) for p in papers for q in range(p + 1, 40) if score(p, q) >= 0.3 - 1e-12}
    rows = [(p, kind, x) for p, kinds in papers.items() for kind, own in kinds.items() for x in own]
    elements = spark.createDataFrame([*rows, (None, "topic", "1")], "paper_id long, kind string, element string")
    monkeypatch.setattr(correlate, "BLOCK", 3)
    for parts in ((1e-6,), (6.0, 1.0)):
        monkeypatch.setattr(correlate, "PARTS", (*parts, 1.0) if len(parts) == 1 else parts)
        pairs = correlate.paper_pairs(elements)
        got = [(r["paper_a"], r["paper_b"]) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert "hashpartitioning(paper_a" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_source_overlap_ranks_shared_keywords_and_gathers_only_those_shown(spark):
    rows = [(s, f"k{k:04d}") for s, n in (("x", 900), ("y", 700), ("z", 3)) for k in range(n)] + [("x", "k0001"), (None, "k0002"), ("w", "alone")]
    out = stats.source_overlap(spark.createDataFrame(rows, "source_type string, keyword string"), 4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    first = [f"k{k:04d}" for k in range(4)]
    assert sorted(map(tuple, out.collect())) == [("x", "y", 700, first), ("x", "z", 3, first[:3]), ("y", "z", 3, first[:3])]
    assert "collect_set" not in plan and "collect_list(struct(rank" in plan


def test_many_small_files(spark, tmp_path):
    """Forty folders of a file each are written without checksum files, and listed by a few tasks, not by one for each."""
    path, sc = str(tmp_path / "texts"), spark.sparkContext
    rows = [(k, f"text {k} {n}") for k in range(40) for n in range(2)]
    sinks.write_files(spark.createDataFrame(rows, "file long, value string").repartition("file").sortWithinPartitions("file", "value"), "file://" + path, "file")
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f != "_SUCCESS"]
    assert len(found) == 40 and all(f.endswith(".txt") for f in found)
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    sc.setJobGroup("files", "files")
    try:
        docs = analysis.analyze_files(spark, "file://" + path)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("files")]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert max(sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds) <= 4 * sc.defaultParallelism
    assert spark.conf.get(setting) == before
    assert sorted((int(r["path"].split("file=")[1].split("/")[0]), r["word_count"]) for r in docs.select("path", "word_count").collect()) == [(k, 6) for k in range(40)]
