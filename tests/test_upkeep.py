"""Jobs on the stored tables: files left alone, counts, summaries."""

from __future__ import annotations

import datetime as dt
import os
from pathlib import Path

from tests.samples import PROFILE, RULES, TZ

from daybook.plans import imports, upkeep
from daybook.plans.warehouse import append_load, read_table
from daybook.schemas import CategoryRule


def stored_files(warehouse, table):
    """Data file -> time of its last change."""
    return {str(p): os.stat(p).st_mtime_ns for p in Path(warehouse, table).rglob("*.parquet")}


def transactions(spark, rows):
    """(day, narration, key) as curated rows."""
    made = [(dt.datetime.fromisoformat(day), narration, "bank", key) for day, narration, key in rows]
    return spark.createDataFrame(made, "ts timestamp, narration string, source string, dedupe_key string")


def test_new_rules_touch_only_the_months_they_change(spark, warehouse):
    append_load(transactions(spark, [("2024-01-05", "corner mill", "a"), ("2024-01-31", "ferry", "b"), ("2024-02-01", "ferry", "c")]),
                warehouse, "transactions", "one")
    append_load(transactions(spark, [("2024-02-02", "mill", "d"), ("2024-03-01", None, "e")]), warehouse, "transactions", "two")
    assert upkeep.recategorize_stored(spark, warehouse, RULES).first() == (4, 4, 3)
    before = stored_files(warehouse, "transactions")
    labels = lambda: {r.dedupe_key: r.category for r in read_table(spark, warehouse, "transactions").collect()}
    assert labels() == {"a": "bread", "b": "travel", "c": "travel", "d": "bread", "e": None}
    # The same rules again change nothing.
    assert upkeep.recategorize_stored(spark, warehouse, RULES).first() == (0, 4, 0)
    assert stored_files(warehouse, "transactions") == before
    # A rule on mills alone leaves the files of the other partitions as they are.
    rules = [CategoryRule("corner", "shop"), *RULES]
    assert upkeep.recategorize_stored(spark, warehouse, rules).first() == (1, 4, 1)
    after = stored_files(warehouse, "transactions")
    kept = lambda files: {p: t for p, t in files.items() if "load=one/month=202401" not in p}
    assert kept(after) == kept(before) and after != before
    assert labels() == {"a": "shop", "b": "travel", "c": "travel", "d": "bread", "e": None}
    # Rules may take labels away, too.
    assert upkeep.recategorize_stored(spark, warehouse, []).first() == (4, 0, 3)


def test_new_rules_on_an_empty_table(spark, warehouse):
    assert upkeep.recategorize_stored(spark, warehouse, RULES).first() == (0, 0, 0)


def test_new_rules_after_an_import_keep_its_rows(spark, bank, warehouse):
    imports.run_job(spark, imports.bank_job([PROFILE], [], TZ), bank, warehouse)
    was = read_table(spark, warehouse, "transactions")
    rows = sorted(was.drop("category", "merchant").collect())
    n = upkeep.recategorize_stored(spark, warehouse, RULES).first()
    now = read_table(spark, warehouse, "transactions")
    assert sorted(now.drop("category", "merchant").collect()) == rows
    assert n.rows_categorized == now.filter("category is not null").count() == 4
    # A forced import finds the keys it has.
    again = imports.run_job(spark, imports.bank_job([PROFILE], [], TZ), bank, warehouse, force=True).first()
    assert (again.rows_inserted, again.rows_skipped) == (0, 5)


def test_log_on_the_stored_table(spark, warehouse):
    log = lambda *rows: spark.createDataFrame(list(rows), "activity string, day date, minutes double")
    day = dt.date(2026, 7, 6)
    first = upkeep.log_activities(spark, warehouse, log(("Gym", day, 45.0), ("gym", day, 50.0), ("chess club", day, None), (None, day, 1.0)), TZ)
    assert first.first() == (2, 1)
    assert upkeep.log_activities(spark, warehouse, log(("gym", day, 30.0)), TZ).first() == (0, 1)
    rows = {r.activity_type: r for r in read_table(spark, warehouse, "activities").collect()}
    assert set(rows) == {"strength_training", "chess_club"}
    assert rows["strength_training"].ts_start == dt.datetime(2026, 7, 6, 6, 30) and rows["chess_club"].duration_min is None
    # Without a day it is logged as of now, once a day.
    assert upkeep.log_activities(spark, warehouse, log(("walk", None, 10.0)), TZ).first() == (1, 0)
    assert upkeep.log_activities(spark, warehouse, log(("walk", None, 12.0)), TZ).first() == (0, 1)
    assert upkeep.log_activities(spark, warehouse, log(), TZ).first() == (0, 0)


def test_summary_of_a_run(spark, takeout, warehouse):
    (Path(takeout) / "Takeout" / "Calendar" / "Harbour.ics").write_text("BEGIN:VCALENDAR\r\nEND:VCALENDAR\r\n")
    (Path(takeout) / "Takeout" / "Calendar" / "Harbour.ics").rename(Path(takeout) / "Takeout" / "Harbour.txt")
    metrics = imports.run_jobs(spark, imports.takeout_jobs(TZ), takeout, warehouse)
    row = upkeep.run_summary(spark, warehouse, metrics, takeout).first()
    # Three searches, two watches, two days, two sessions.
    assert (row.source, row.rows_inserted, row.rows_skipped) == ("takeout", 9, 1)
    assert (row.first_day, row.last_day) == (dt.date(2024, 7, 1), dt.date(2024, 10, 5))
    assert "activities" in row.tables and row.files_skipped == 0
    told = sorted(r.warning for r in upkeep.run_warnings(spark, warehouse, metrics, takeout).collect())
    assert "Calendar: not present in this export" in told and row.warnings == len(told)
    again = imports.run_jobs(spark, imports.takeout_jobs(TZ), takeout, warehouse)
    row = upkeep.run_summary(spark, warehouse, again, takeout).first()
    assert (row.rows_inserted, row.files_imported, row.warnings) == (0, 0, 1)
    assert row.last_day == dt.date(2024, 10, 5)
