"""Row dedupe, ledger, spines, profiles, exports."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daybook.operators import merge, profiling, spine
from daybook.plans import export

SCHEMA = "dedupe_key string, file string, line int, v int"


def test_load_twice_is_load_once(spark):
    rows = [("a", "f1", 1, 10), ("a", "f1", 2, 11), ("b", "f1", 3, 12), ("c", "f2", 1, 13), ("a", "f0", 9, 14)]
    batch = spark.createDataFrame(rows, SCHEMA)
    target = spark.createDataFrame([("c", "old", 0, 1)], SCHEMA)
    order = ("file", "line")
    first = merge.insert_dedupe(batch, target, order)
    assert sorted(r.v for r in first.collect()) == [12, 14]
    assert merge.insert_counts(batch, target).first() == (2, 3)
    loaded = target.unionByName(first)
    assert merge.insert_dedupe(batch, loaded, order).count() == 0
    assert merge.insert_counts(batch, loaded).first() == (0, 5)
    shuffled = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)
    assert sorted(merge.insert_dedupe(shuffled, target, order).collect()) == sorted(first.collect())


def test_one_key_may_fill_the_batch(spark):
    batch = spark.range(0, 300000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("dedupe_key"), F.col("id").alias("line"))
    out = merge.insert_dedupe(batch, batch.limit(0), ("line",))
    assert out.count() == 200001
    assert out.filter("dedupe_key = 'hot'").first().line == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_nearby_target_gives_the_same_rows(spark, tmp_path):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    schema = "dedupe_key string, ts timestamp, line int"
    old = spark.createDataFrame([(f"k{n}", day(n), 0) for n in range(400)], schema)
    old.repartitionByRange(8, "ts").write.parquet(str(tmp_path / "t"))
    target = spark.read.parquet(str(tmp_path / "t"))
    batch = spark.createDataFrame([(f"k{n}", day(n), n) for n in range(390, 410)] + [("k395", day(395), 1)], schema)
    near = merge.insert_dedupe(batch, target, ("line",), within="ts")
    assert sorted(near.collect()) == sorted(merge.insert_dedupe(batch, target, ("line",)).collect())
    assert near.count() == 10
    assert merge.insert_dedupe(batch.limit(0), target, ("line",), within="ts").count() == 0


def test_latest_replaces(spark):
    target = spark.createDataFrame([("a", "f", 1, 1), ("b", "f", 1, 2)], SCHEMA)
    batch = spark.createDataFrame([("a", "f", 2, 3), ("a", "f", 3, 4)], SCHEMA)
    assert sorted((r.dedupe_key, r.v) for r in merge.upsert_latest(batch, target, ("line",)).collect()) == [("a", 4), ("b", 2)]


def test_ledger(spark):
    at = lambda h: dt.datetime(2026, 1, 1, h)
    schema = "file_sha256 string, path string, source string, imported_at timestamp, rows_inserted long"
    ledger = spark.createDataFrame([("x", "p1", "bank", at(1), 6)], schema)
    again = spark.createDataFrame([("x", "p2", "other", at(2), 0), ("y", "p3", "bank", at(2), 4)], schema)
    merged = {r.file_sha256: r for r in merge.upsert_ledger(ledger, again).collect()}
    assert merged["x"] == ("x", "p2", "bank", at(2), 0)
    assert len(merged) == 2
    files = spark.createDataFrame([("x", "p9"), ("z", "p8")], "file_sha256 string, path string")
    assert [r.file_sha256 for r in merge.new_files(files, ledger).collect()] == ["z"]
    assert merge.new_files(files, ledger, force=True).count() == 2


def test_manual_log(spark):
    log = spark.createDataFrame([("Gym", dt.date(2026, 7, 6), 45.0), ("gym", dt.date(2026, 7, 6), 50.0)], "activity string, day date, minutes double")
    empty = spark.createDataFrame([], "dedupe_key string")
    rows = merge.manual_activities(log, empty, "Asia/Kolkata")
    (row,) = rows.collect()
    assert (row.activity_type, row.duration_min, row.ts_start) == ("strength_training", 45.0, dt.datetime(2026, 7, 6, 6, 30))
    assert merge.manual_activities(log, rows, "Asia/Kolkata").count() == 0


def test_append_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "n int, s string")
    b = spark.createDataFrame([("y", 2.5)], "s string, d double")
    assert {tuple(r) for r in merge.append_by_name(a, b).collect()} == {(1, "x", None), (None, "y", 2.5)}


def facts(spark, rows):
    return [(spark.createDataFrame(rows, "user int, ts timestamp"), "ts")]


def test_empty_spine_is_a_year(spark):
    days = spine.day_spine(facts(spark, []), "2026-03-10")
    assert days.count() == 366
    weeks = spine.week_spine(days)
    none = spark.createDataFrame([], "activity_type string, ts_start timestamp")
    flagged = spine.flag_weeks(weeks, none)
    assert weeks.count() >= 52 and flagged.filter("went_to_gym").count() == 0
    some = spark.createDataFrame([("gym", dt.datetime(2026, 3, 7, 9)), ("walk", dt.datetime(2026, 1, 7))], "activity_type string, ts_start timestamp")
    assert [r.week_start for r in spine.flag_weeks(weeks, some).filter("went_to_gym").collect()] == [dt.date(2026, 3, 2)]


def test_spine_per_entity(spark):
    rows = [(1, dt.datetime(2026, 3, 1, 23)), (2, dt.datetime(2026, 3, 9)), (1, dt.datetime(2026, 3, 5))]
    days = spine.day_spine(facts(spark, rows), "2026-03-10", ["user"], 0)
    assert {(r.user, r.n) for r in days.groupBy("user").agg(F.count("*").alias("n")).collect()} == {(1, 10), (2, 2)}
    seen = spark.createDataFrame(rows, "user int, ts timestamp").select("user", F.col("ts").cast("date").alias("day"))
    assert spine.gaps(days, seen, ["user", "day"]).count() == 9


def test_current_date_is_the_default(spark):
    last = spine.day_spine(facts(spark, [])).agg(F.max("day").alias("d"), F.current_date().alias("t")).first()
    assert last.d == last.t


def test_vocabulary(spark):
    tx = spark.createDataFrame([(f"c{i:03d}", "acc", "free text") for i in range(80)], "category string, account string, narration string")
    act = spark.createDataFrame([(None,), ("run",)], "activity_type string")
    columns = [("transactions", "category"), ("transactions", "account"), ("activities", "activity_type")]
    tables = {"transactions": tx, "activities": act}
    rows = profiling.vocabulary(tables, columns).collect()
    assert len([r for r in rows if r.column == "category"]) == 50
    assert max(r.value for r in rows if r.column == "category") == "c049"
    assert {r.value for r in rows if r.column != "category"} == {"acc", "run"}
    assert profiling.vocabulary(tables, columns, sharing="none").count() == 0


def test_numeric_summary(spark):
    df = spark.createDataFrame([("2026-01-05", False, None, 100), ("2026-01-12", True, 1.0, 200)], "w string, f boolean, d double, spend int")
    assert profiling.numeric_summary(df).first() == ("spend", 300.0, 150.0)
    assert profiling.numeric_summary(df.limit(1)).count() == 0
    assert profiling.numeric_summary(df.select("w")).count() == 0


def test_row_cap(spark):
    df = spark.range(2000)
    assert profiling.capped(df).count() == 500
    assert profiling.capped(df.limit(7)).count() == 7
    assert [r.id for r in profiling.capped(df, 2, ["id"]).collect()] == [0, 1]


def test_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok', None), (2, "plain", 2.5)], "n int, s string, d double")
    export.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').schema(df.schema).csv(str(tmp_path / "csv"))
    assert sorted(back.collect()) == sorted(df.collect())
    export.write_json(df, str(tmp_path / "json"))
    assert sorted(spark.read.schema(df.schema).json(str(tmp_path / "json")).collect()) == sorted(df.collect())


@pytest.mark.parametrize("value, kind, shown", [
    (1234567.5, "double", "1,234,567.5"), (2.0, "double", "2"), (100.0, "double", "100"), (None, "double", ""),
    ("1234.5", "decimal(12,2)", "1,234.50"), ("2026-01-05 07:08:09", "timestamp", "2026-01-05 07:08"),
    ("2026-01-05", "date", "2026-01-05"), ("x", "string", "x")])
def test_display(spark, value, kind, shown):
    df = spark.createDataFrame([(str(value) if value is not None else None,)], "v string").select(F.col("v").cast(kind).alias("v"))
    assert export.display(df).first().v == shown
