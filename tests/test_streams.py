"""Streams over several batches: first rows, panes, repeated batches."""

import json
import os
import time
from datetime import date, timedelta

import pytest

from tidelens.sources import sinks
from tidelens.streaming import jobs

EVENT = "source_id string, ts timestamp, place int, keyword string"


def _land(folder, number, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{number:03d}.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    os.utime(f"{folder}/{number:03d}.json", (time.time() - 1000 + number,) * 2)


def _events(*rows):
    return [{"source_id": k, "ts": f"2024-01-{d:02d}T{h:02d}:00:00Z", "place": p, "keyword": "w"} for k, d, h, p in rows]


def _run(spark, tmp_path, job, schema, per_trigger=1):
    out = str(tmp_path / "out")
    jobs.ingest(job(jobs.landed(spark, str(tmp_path / "in"), EVENT, per_trigger)), out, str(tmp_path / "state")).awaitTermination()
    return spark.read.schema(schema).parquet(out)


def test_first_row_of_a_key_over_batches(spark, tmp_path):
    """A duplicate in a later batch goes, one after the expiry stays, and in a batch the first in the list's order stays."""
    land = lambda n, rows: _land(str(tmp_path / "in"), n, rows)
    land(1, _events(("a", 1, 5, 2), ("a", 1, 6, 1), ("b", 1, 7, 3)))
    land(2, _events(("a", 3, 0, 1), ("c", 3, 0, 2), ("b", 2, 0, 3)))
    land(3, _events(("d", 12, 0, 1), ("a", 9, 5, 2)))  # a returns after seven days
    land(4, _events(("a", 12, 1, 1), ("b", 13, 0, 2), ("c", 2, 0, 9)))  # b and its first row are forgotten; c comes behind the watermark
    rows = _run(spark, tmp_path, lambda s: jobs.first_seen(s, ["source_id"], ["place"], "ts", "1 day", "7 days"), EVENT).collect()
    assert sorted((r["source_id"], r["ts"].day, r["place"]) for r in rows) == [("a", 1, 1), ("a", 9, 2), ("b", 1, 3), ("b", 13, 2), ("c", 3, 2), ("d", 12, 1)]


def test_panes_give_all_windows_and_leave_late_rows_out(spark, tmp_path):
    land = lambda n, rows: _land(str(tmp_path / "in"), n, rows)
    land(1, _events(*(("x", 1 + k % 5, 3, k) for k in range(10))))
    land(2, _events(("x", 8, 3, 0), ("x", 3, 1, 1)))  # the third is closed when this batch is counted only
    land(3, _events(("x", 1, 1, 0), ("x", 12, 3, 1)))  # the first was closed by the batch before
    land(4, _events(("x", 20, 3, 0)))
    days = _run(spark, tmp_path, jobs.panes, "keyword string, day date, n long")
    got = {r["day"]: r["n"] for r in days.collect()}
    base = date(2024, 1, 1)
    assert got == {base: 2, base + timedelta(1): 2, base + timedelta(2): 3, base + timedelta(3): 2, base + timedelta(4): 2, base + timedelta(7): 1, base + timedelta(11): 1}
    sums = {(r["days"], r["start"]): r["n"] for r in jobs.window_sums(days, (2, 7, 30)).collect()}
    want = {}
    for d, n in got.items():
        for size in (2, 7, 30):
            for k in range(size):
                want[size, d - timedelta(k)] = want.get((size, d - timedelta(k)), 0) + n
    assert sums == want
    ends = jobs.window_sums(days, (7,), "2024-01-09").collect()
    assert ends and all(r["end"] <= date(2024, 1, 9) and r["end"] == r["start"] + timedelta(7) for r in ends)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = sinks.Versions("file://" + str(tmp_path / "store"))
    schema = "id long, text string"
    calls = []

    def merge(batch, number):
        def tables():
            calls.append(number)
            return {"rows": store.read(spark, "rows", schema).unionByName(batch)}

        return store.commit(spark, number, tables)

    one, two = (spark.createDataFrame([(k, f"t{k}")], schema) for k in (1, 2))
    assert store.read(spark, "rows", schema).count() == 0
    assert merge(one, 0) and merge(two, 1)
    assert not merge(one, 0) and not merge(two, 1) and calls == [0, 1]
    assert sorted(tuple(r) for r in store.read(spark, "rows", schema).collect()) == [(1, "t1"), (2, "t2")]

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.commit(spark, 2, fails)
    assert store.last(spark)["number"] == 1 and merge(one, 2)
    folders = [r["folder"] for r in store.log(spark).orderBy("number").collect()]
    store.vacuum(spark, 1)
    assert [os.path.exists(f.removeprefix("file://")) for f in folders] == [False, False, True]
    assert store.read(spark, "rows", schema).count() == 3 and store.read(spark, "other", schema).count() == 0
