"""Export files arriving one after another."""

from __future__ import annotations

import datetime as dt
import json

from daybook.sources import exports, files
from daybook.streaming import loads, weeks


def test_arriving_exports_load_once(spark, tmp_path):
    folder = tmp_path / "in"
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def arrive(name, *found):
        (folder / name).mkdir(parents=True)
        rows = [{"title": t, "time": f"2026-03-0{d}T07:00:00Z"} for t, d in found]
        (folder / name / "MyActivity.json").write_text(json.dumps(rows))

    def load():
        raw = loads.stream_json_export(spark, str(folder), files.SEARCH_GLOB, exports.SEARCH_SCHEMA)
        rows = exports.normalize_searches(raw)
        loads.run_to_end(loads.stream_insert_dedupe(rows, out, log, ("ts", "query"), within="ts"))
        return sorted(r.query for r in spark.read.parquet(out).collect())

    arrive("a", ("Searched for tea", 1), ("Searched for tea", 1), ("Visited x", 1), ("Searched for mugs", 2))
    assert load() == ["mugs", "tea"]
    assert load() == ["mugs", "tea"]
    arrive("b", ("Searched for mugs", 2), ("Searched for tea", 3))
    assert load() == ["mugs", "tea", "tea"]


SCHEMA = "ts timestamp, price long, note string"


def arrivals(spark, folder):
    """Write one batch of (day of January 2026 or None, price) per call."""

    def arrive(name, *rows):
        day = lambda n: None if n is None else dt.datetime(2026, 1, 1) + dt.timedelta(days=n - 1, hours=13)
        spark.createDataFrame([(day(n), v, "x") for n, v in rows], SCHEMA).write.parquet(str(folder / name))

    return arrive


def test_weeks_close_and_late_rows_are_kept_apart(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    arrive = arrivals(spark, tmp_path / "in")

    def load():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        loads.run_to_end(weeks.close_weeks(stream, out, log, "ts", "7 days", {"price": "bigint"}))
        opened = {r.week_start.day: r.price for r in weeks.open_weeks(spark, out).collect()}
        closed = {r.week_start.day: r.price for r in weeks.closed_weeks(spark, out).collect()}
        return closed, opened, sorted((r.batch, r.price) for r in weeks.late_rows(spark, out).collect())

    arrive("a", (5, 1), (6, 2), (12, 4), (None, 99))
    assert load() == ({}, {5: 3, 12: 4}, [(0, 99)])
    # The week of the 5th ends on the 12th and closes when the 19th is reached, after this batch.
    arrive("b", (20, 8), (7, 16), (7, 16))
    assert load() == ({5: 35}, {12: 4, 19: 8}, [(0, 99)])
    arrive("c", (8, 32), (13, 64))
    assert load() == ({5: 35}, {12: 68, 19: 8}, [(0, 99), (2, 32)])
    assert load() == ({5: 35}, {12: 68, 19: 8}, [(0, 99), (2, 32)])
    # A jump closes what is open; only the new week is left as state.
    arrive("d", (90, 5))
    assert load()[1] == {30: 5}
    # The newest batch runs again, as after a failure before its commit, and replaces itself.
    before = load()
    (tmp_path / "log" / "commits" / "3").unlink()
    (tmp_path / "log" / "commits" / ".3.crc").unlink()
    assert load() == before


def test_bounded_dedupe_frees_its_state(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    arrive = arrivals(spark, tmp_path / "in")

    def load():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        query = loads.append_stream(loads.dedupe_in_stream(stream, "ts", "10 days", key="price"), out, log)
        loads.run_to_end(query)
        state = query.lastProgress["stateOperators"]
        return sorted(r.price for r in spark.read.parquet(out).collect()), sum(s["numRowsTotal"] for s in state)

    arrive("a", (1, 1), (1, 1), (2, 2), (3, 3))
    assert load() == ([1, 2, 3], 3)
    arrive("b", (4, 2), (9, 4))
    assert load() == ([1, 2, 3, 4], 4)
    # Time moves on by a month: the keys of before are forgotten.
    arrive("c", (40, 5))
    assert load() == ([1, 2, 3, 4, 5], 1)
    arrive("d", (2, 6), (41, 5), (41, 2))
    rows, state = load()
    assert rows == [1, 2, 2, 3, 4, 5] and state == 2
