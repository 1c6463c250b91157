"""Import jobs on files: golden counts, a second run, a forced run."""

from __future__ import annotations

import datetime as dt
import os

from tests.samples import PROFILE, RULES, TZ

from daybook.operators.spine import day_spine, flag_weeks, week_spine
from daybook.plans import imports
from daybook.plans.warehouse import read_ledger, read_raw, read_table, read_warnings
from daybook.schemas import BankProfile
from daybook.sources import files


def counts(metrics):
    rows = metrics.collect()
    return (
        sum(r.rows_inserted for r in rows),
        sum(r.rows_skipped for r in rows),
        sum(r.files_skipped for r in rows),
    )


def test_music(spark, music, warehouse, zoned):
    jobs = imports.music_jobs()
    assert counts(imports.run_jobs(spark, jobs, music, warehouse)) == (7, 0, 0)
    listens = read_table(spark, warehouse, "listens")
    assert {r.track for r in listens.filter("skipped").collect()} == {"Reed"}
    zoned(TZ)
    first = read_table(spark, warehouse, "listens").filter("ts > '2023-01-01'").orderBy("ts").selectExpr(
        "date_format(ts, 'dd HH:mm') as t").first().t
    assert first == "31 05:29"
    zoned("UTC")
    assert counts(imports.run_jobs(spark, jobs, music, warehouse)) == (0, 0, 2)
    assert counts(imports.run_jobs(spark, jobs, music, warehouse, force=True)) == (0, 7, 0)
    raw = read_raw(spark, warehouse, "raw_listens_extended")
    assert raw.count() == 6  # three rows, staged twice
    assert {r.reason_start for r in raw.collect()} == {"trackdone", "clickrow", "fwdbtn"}
    assert {r.warning for r in read_warnings(spark, warehouse).collect()} == {"skipped 1 rows with no track name"}
    ledger = {r.path.rsplit("/", 1)[1]: r.rows_inserted for r in read_ledger(spark, warehouse).collect()}
    assert ledger == {"StreamingHistory_music_3.json": 0, "Streaming_History_Audio_2022_7.json": 0}


def test_two_files_of_one_content(spark, music, warehouse):
    with open(f"{music}/StreamingHistory_music_3.json") as f:
        same = f.read()
    with open(f"{music}/more/StreamingHistory copy.json", "w") as f:
        f.write(same)
    job = imports.music_jobs()[0]
    assert counts(imports.run_job(spark, job, music, warehouse)) == (5, 0, 1)
    assert counts(imports.run_job(spark, job, music, warehouse, force=True)) == (0, 10, 0)


def test_damaged_files_are_told_of_and_tried_again(spark, music, warehouse):
    good = open(f"{music}/StreamingHistory_music_3.json").read()
    with open(f"{music}/StreamingHistory_cut.json", "w") as f:
        f.write(good[: len(good) // 2])
    with open(f"{music}/StreamingHistory_odd.json", "w") as f:
        f.write('[{"endTime": "yesterday", "artistName": "Elm", "trackName": "X", "msPlayed": 3}, '
                '{"endTime": "2023-01-01 10:00", "artistName": "Elm", "trackName": "Y", "msPlayed": 3}]')
    job = imports.music_jobs()[0]
    assert counts(imports.run_job(spark, job, music, warehouse)) == (6, 0, 0)
    assert read_table(spark, warehouse, "listens").filter("ts is null or track is null").count() == 0
    told = {(r.path.rsplit("/", 1)[1], r.warning) for r in read_warnings(spark, warehouse).collect()}
    assert told == {("StreamingHistory_cut.json", "unreadable file"), ("StreamingHistory_odd.json", "dropped 1 rows without a required value")}
    assert {r.path.rsplit("/", 1)[1] for r in read_ledger(spark, warehouse).collect()} == {"StreamingHistory_music_3.json", "StreamingHistory_odd.json"}
    with open(f"{music}/StreamingHistory_cut.json", "w") as f:
        f.write(good.replace("Drum Pond", "Drum Lake"))
    assert counts(imports.run_job(spark, job, music, warehouse)) == (2, 3, 2)


def test_rows_without_a_time_stay_comparable(spark):
    from daybook.operators.merge import near

    target = spark.createDataFrame([("a", None), ("b", "2020-01-01"), ("c", "2024-05-05")], "dedupe_key string, ts string")
    batch = spark.createDataFrame([("x", "2024-05-06")], "dedupe_key string, ts string")
    kept = near(target.selectExpr("dedupe_key", "cast(ts as timestamp) ts"), batch.selectExpr("dedupe_key", "cast(ts as timestamp) ts"), "ts")
    assert {r.dedupe_key for r in kept.collect()} == {"a", "c"}


def test_bank(spark, bank, warehouse):
    job = imports.bank_job([PROFILE], RULES, TZ)
    assert counts(imports.run_job(spark, job, bank, warehouse)) == (5, 0, 0)
    rows = read_table(spark, warehouse, "transactions").orderBy("ts").collect()
    assert [float(r.amount) for r in rows] == [-18.05, -2006, 31000.75, -640.4, -90]
    assert [r.merchant for r in rows] == ["OLD MILL", "BAKERY TWO", "HARBOUR WORKS", "FERRY LINE", None]
    assert [r.category for r in rows] == ["bread", "bread", None, "travel", "cash"]
    assert {r.account for r in rows} == {"river_current"}
    assert rows[0].ts == dt.datetime(2022, 6, 29, 18, 30)
    assert counts(imports.run_job(spark, job, bank, warehouse)) == (0, 0, 1)


def test_a_statement_waits_for_its_profile(spark, bank, warehouse):
    other = BankProfile("other", ("Nothing", "Like", "This"), "Nothing", "Like")
    assert counts(imports.run_job(spark, imports.bank_job([other], RULES, TZ), bank, warehouse)) == (0, 0, 0)
    assert read_ledger(spark, warehouse).count() == 0
    assert counts(imports.run_job(spark, imports.bank_job([PROFILE], RULES, TZ), bank, warehouse)) == (5, 0, 0)


def test_chats(spark, chats, warehouse):
    job = imports.chat_job("ASHA ", TZ)
    assert counts(imports.run_job(spark, job, chats, warehouse)) == (9, 0, 0)
    rows = read_table(spark, warehouse, "messages")
    assert rows.filter("is_me").count() == 3
    assert {r.chat for r in rows.collect()} == {"Tove", "Allotment"}
    assert rows.filter("text = 'what a mast'").first().word_count == 3
    assert rows.filter("text = 'no wind\nmaybe sunday\nbring rope'").count() == 1
    assert rows.filter("is_media and text is null and word_count is null").count() == 2
    assert counts(imports.run_job(spark, job, chats, warehouse)) == (0, 0, 2)


def test_takeout(spark, takeout, warehouse):
    jobs = imports.takeout_jobs(TZ)
    metrics = imports.run_jobs(spark, jobs, takeout, warehouse)
    per_table = {r.table: r.rows_inserted for r in metrics.collect()}
    assert per_table == {
        "searches": 3, "youtube_watches": 2, "daily_metrics": 2, "activities": 2, "calendar_events": 3}
    watches = read_table(spark, warehouse, "youtube_watches").orderBy("ts").collect()
    assert [(w.title, w.channel) for w in watches] == [("Splicing", "Ropewalk"), ("https://example.org/removed", None)]
    days = read_table(spark, warehouse, "daily_metrics").orderBy("day").collect()
    assert [(d.steps, d.distance_m, d.calories, d.active_min) for d in days] == [(1003, 812.25, 1701.5, 12.0), (None,) * 4]
    done = read_table(spark, warehouse, "activities").orderBy("ts_start").collect()
    assert [(r.activity_type, r.duration_min, r.calories) for r in done] == [("rowing", 45.5, 288.125), ("rock_climbing", 75.0, 501.5)]
    events = read_table(spark, warehouse, "calendar_events").orderBy("ts_start").collect()
    assert [(r.title, r.all_day) for r in events] == [("Launch; west dock", False), ("Regatta", True), ("Tide, low", False)]
    assert events[0].ts_start == dt.datetime(2024, 7, 4, 14, 0)
    assert events[1].ts_start == dt.datetime(2024, 7, 19, 18, 30)
    assert "titleUrl" in read_raw(spark, warehouse, "raw_searches").columns

    assert [r.warning for r in read_warnings(spark, warehouse).collect()] == ["ignoring unknown column 'Max speed'"]

    facts = [(read_table(spark, warehouse, t), "ts") for t in ("transactions", "listens", "messages")]
    weeks = flag_weeks(week_spine(day_spine(facts, "2024-12-10")), read_table(spark, warehouse, "activities"), ["rowing"])
    assert [r.week_start for r in weeks.filter("went_to_gym").collect()] == [dt.date(2024, 7, 1)]
    assert weeks.count() >= 52

    assert counts(imports.run_jobs(spark, jobs, takeout, warehouse)) == (0, 0, 6)


def test_every_daily_file_has_its_own_header(spark, takeout, warehouse):
    folder = f"{takeout}/Takeout/Fit/Daily activity metrics/old"
    os.makedirs(folder)
    for name, text in (("a", "Date,Calories,Step count,Distance\n2024-07-09,200,6,7.5\n"), ("b", "Steps,Calories\n1,2\n")):
        os.makedirs(f"{takeout}/Takeout/{name}/Daily activity metrics")
        with open(f"{takeout}/Takeout/{name}/Daily activity metrics/Daily activity metrics.csv", "w") as f:
            f.write(text)
    job = imports.takeout_jobs(TZ)[2]
    assert counts(imports.run_job(spark, job, takeout, warehouse)) == (3, 0, 0)
    day = read_table(spark, warehouse, "daily_metrics").filter("day = '2024-07-09'").first()
    assert (day.steps, day.distance_m, day.calories, day.active_min) == (6, 7.5, 200.0, None)
    told = {(r.path.split("/")[-3], r.warning) for r in read_warnings(spark, warehouse).collect()}
    assert ("b", "no date column recognized") in told
    assert counts(imports.run_job(spark, job, takeout, warehouse)) == (0, 0, 2)


def test_activity_of_another_product_is_left_alone(spark, takeout, warehouse):
    folder = f"{takeout}/Takeout/My Activity/Maps"
    os.makedirs(folder)
    with open(f"{folder}/MyActivity.json", "w") as f:
        f.write('[{"title": "Searched for a pier", "time": "2024-10-03T05:00:00.250Z"}]')
    assert counts(imports.run_job(spark, imports.takeout_jobs(TZ)[0], takeout, warehouse)) == (3, 1, 0)


def test_raw_keeps_dropped_rows(spark, takeout, warehouse):
    imports.run_job(spark, imports.takeout_jobs(TZ)[0], takeout, warehouse)
    assert spark.read.parquet(f"{warehouse}/raw_searches/*").count() == 6


def test_missing_products(spark, takeout, tmp_path):
    report = files.missing_products(files.find_files(spark, takeout)).collect()
    assert {r.product: r.missing for r in report} == {
        "Search history": False, "YouTube history": False, "Google Fit": False, "Calendar": False}
    only = tmp_path / "other" / "Takeout" / "Calendar"
    only.mkdir(parents=True)
    (only / "x.ics").write_text("BEGIN:VCALENDAR\nEND:VCALENDAR\n")
    report = files.missing_products(files.find_files(spark, str(tmp_path / "other"))).collect()
    assert sum(r.missing for r in report) == 3


def test_broken_session_file_gives_no_row(spark, takeout, warehouse):
    with open(f"{takeout}/Takeout/Fit/All Sessions/c.json", "w") as f:
        f.write("{not json")
    job = imports.takeout_jobs(TZ)[3]
    assert counts(imports.run_job(spark, job, takeout, warehouse)) == (2, 0, 0)
    (warning,) = read_warnings(spark, warehouse).collect()
    assert warning.path.endswith("c.json") and warning.warning == "unreadable file"


def test_unknown_statement_and_quiet_chat(spark, bank, chats, warehouse):
    with open(f"{bank}/other.csv", "w") as f:
        f.write("When,What\n1,2\n")
    with open(f"{chats}/Empty_chat.txt", "w") as f:
        f.write("nothing to see\n")
    imports.run_job(spark, imports.bank_job([PROFILE], RULES, TZ), bank, warehouse)
    imports.run_job(spark, imports.chat_job("Asha", TZ), chats, warehouse)
    noticed = {(r.path.rsplit("/", 1)[1], r.warning) for r in read_warnings(spark, warehouse).collect()}
    assert noticed == {("other.csv", "no profile matches the header"), ("Empty_chat.txt", "no message lines recognized")}


def test_routing(spark):
    rows = [
        ("/a/StreamingHistory_0.json", ""), ("/a/WhatsApp Chat with X.txt", ""),
        ("/a/notes.txt", "\n‎[01/02/26, 8:01:00 AM] A: hi"), ("/a/notes.txt", "hello\n01/02/26, 8:01 - A: hi"),
        ("/a/x.CSV", ""), ("/a/Takeout/Fit/daily.csv", ""), ("/a/takeout-1.zip", ""),
        ("/a/Takeout/My_chat.txt", ""), ("/a/b.pdf", None),
    ]
    df = spark.createDataFrame(rows, "path string, head string")
    got = [(r.source, r.status) for r in files.route_files(df).collect()]
    assert got == [
        ("spotify", "ok"), ("whatsapp", "ok"), ("whatsapp", "ok"), (None, "none"), ("bank", "ok"),
        ("takeout", "ok"), ("takeout", "ok"), (None, "ambiguous"), (None, "none")]
