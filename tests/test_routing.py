"""One feed of mixed results through the router."""

import json

from tidelens.operators import normalize


def _feed(spark, rows):
    return normalize.landed(spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string"))


def test_each_kind_finds_its_normalizer(spark):
    base = {"source_id": "7", "collected_at": "2024-01-10T00:00:00Z"}
    repo = {"id": 5, "full_name": "a/b", "owner": {"login": "me"}, "languages": {"C": 3, "Go": 1}, "topics": ["X"], "language": None, "license": None}
    rows = [
        {**base, "source_type": "academic", "data": {"title": "T", "abstract": "A", "authors": ["x"], "citations": 3}},
        {**base, "source_type": "public_docs", "metadata": {"source": "sec_edgar"}, "data": {"form_type": "8-K", "cik": "9", "filing_date": "2024-01-09"}},
        {**base, "source_type": "public_docs", "metadata": {"source": "gazette"}, "data": {"summary": "s", "authors": "not a list", "tags": ["t", 5]}},
        {**base, "source_type": "public_docs", "data": {"content": "c"}},
        *({**base, "source_type": "code_projects", "metadata": {"type": t} if t else {}, "data": repo} for t in ("repository", "repository_search", "gist", None)),
        {**base, "source_type": "code_projects", "metadata": {"type": "issue"}, "data": {"id": 1, "title": "i", "state": "open", "user": {"login": "u"}, "labels": [{"name": "bug"}]}},
        {**base, "source_type": "code_projects", "metadata": {"type": "pull_request"}, "data": {"id": 2, "title": "p", "state": "open", "draft": True, "head": {"ref": "h"}, "base": {"ref": "m"}}},
        {**base, "source_type": "code_projects", "metadata": {"type": "user_event"}, "data": {"id": "e", "type": "Push", "actor": {"login": "u"}, "repo": {"name": "o/r"}}},
        {**base, "source_type": "social", "data": {"title": "dropped"}},
        "no json", "", "[1, 2]",
    ]
    out = normalize.routed(_feed(spark, rows), "2024-01-10").collect()
    count = {}
    for r in out:
        count[r["route"]] = count.get(r["route"], 0) + 1
    assert count == {"academic": 1, "filing": 1, "public_document": 2, "repository": 4, "issue": 1, "pull_request": 1, "user_event": 1}
    own = {r["route"]: r for r in out}
    assert own["academic"]["metrics"] == {"citations": 3.0} and own["academic"]["content"] == "A" and own["academic"]["keywords"] == []
    assert own["filing"]["id"] == "sec_9_8_K_2024_01_09" and "urgent" in own["filing"]["tags"]
    assert own["repository"]["title"] == "a/b" and own["repository"]["content"] == "Languages: C, Go | Topics: X" and own["repository"]["metrics"]["language_C"] == 75.0
    assert own["issue"]["keywords"] == ["bug"] and own["pull_request"]["tags"] == ["pull_request", "open", "draft"] and own["user_event"]["title"] == "u Push on o/r"
    assert {r["content"] for r in out if r["route"] == "public_document"} == {"s", "c"}
    assert all(r["source_id"] == "7" and str(r["collected_date"]) == "2024-01-10 00:00:00" for r in out)


def test_one_scan(spark):
    df = normalize.routed(_feed(spark, [{"source_type": "academic", "data": {}}]), "2024-01-10")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
