"""A session in UTC, and export files of every kind with invented contents."""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from daybook.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def zoned(spark):
    """Set another session time zone for one test."""

    def use(tz):
        spark.conf.set("spark.sql.session.timeZone", tz)

    yield use
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.fixture()
def warehouse(tmp_path):
    return str(tmp_path / "warehouse")


def _json(path: Path, value) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value), encoding="utf-8")


@pytest.fixture()
def music(tmp_path):
    """Five short plays, two of them alike but for the minute; three long ones, one a podcast."""
    root = tmp_path / "music"
    short = [("2023-07-30 23:59", "Kite", "Drum Pond", 61_000), ("2023-07-31 00:00", "Kite", "Drum Pond", 61_000),
             ("2023-08-02 04:17", "Ä Moth", "Reed", 0), ("2023-11-11 11:11", "Kite", "Sill", 999_999), ("2023-12-31 20:45", "Oak", "Ash", 7)]
    _json(root / "StreamingHistory_music_3.json", [
        {"endTime": at, "artistName": who, "trackName": what, "msPlayed": ms} for at, who, what, ms in short])
    prefix = "master_metadata_"
    long = [("2022-05-05T05:05:05Z", 88_000, "Reed", "Ä Moth", "Wings", True, "trackdone"),
            ("2022-05-06T21:00:59Z", 15, None, None, None, False, "clickrow"),
            ("2022-09-30T12:30:00Z", 240_500, "Sill", "Kite", None, False, "fwdbtn")]
    _json(root / "more" / "Streaming_History_Audio_2022_7.json", [
        {"ts": at, "ms_played": ms, f"{prefix}track_name": what, f"{prefix}album_artist_name": who,
         f"{prefix}album_album_name": album, "skipped": cut, "reason_start": why}
        for at, ms, what, who, album, cut, why in long])
    return str(root)


@pytest.fixture()
def chats(tmp_path):
    root = tmp_path / "chats"
    root.mkdir()
    (root / "WhatsApp Chat with Tove.txt").write_text("\n".join([
        "05/09/23, 6:40 am - Messages are end-to-end encrypted.",
        "05/09/23, 6:41 am - Asha: boat at nine?",
        "05/09/23, 11:02 pm - Tove: no wind", "maybe sunday", "bring rope",
        "25/09/23, 1:00 pm - Tove: <Media omitted>",
        "26/09/2023, 00:05 - Asha: what a mast",
        "",
    ]), encoding="utf-8")
    mark = "\u200e"
    (root / "Allotment_chat.txt").write_text("\n".join([
        f"{mark}[19/04/25, 7:15:01 PM] Allotment: {mark}Messages are end-to-end encrypted.",
        "[19/04/25, 7:16:30 PM] Nils: who has the key",
        f"[20/04/25, 5:59:59 AM] Asha: {mark}image omitted",
        "[20/04/25, 6:00:10 AM] Nils: thanks!",
        "[21/04/25, 12:00:00 PM] Nils: beans are in",
        "",
    ]), encoding="utf-8")
    return str(root)


@pytest.fixture()
def bank(tmp_path):
    root = tmp_path / "bank"
    root.mkdir()
    (root / "river.csv").write_text("\n".join([
        "River bank,,,", "made for you,,,", "",
        "In,Details,Booked,Out",
        ",UPI-OLD MILL-om@x-77,30-06-2022,18.05",
        ',UPI/DR/99/BAKERY TWO/KKBK/b@y,01-07-2022,"2,006.00"',
        '"31,000.75",IMPS-77 HARBOUR WORKS,02-07-2022,',
        ",POS 8 FERRY LINE,03-07-2022,640.4",
        ",ATM WDL 5,09-07-2022,90",
        ",Brought forward,10-07-2022,",
        "",
    ]), encoding="utf-8")
    return str(root)


@pytest.fixture()
def takeout(tmp_path):
    root = tmp_path / "export" / "Takeout"
    _json(root / "My Activity" / "Search" / "MyActivity.json", [
        {"header": "Search", "title": title, "time": time, "titleUrl": "https://example.org/?q=1"} for title, time in (
            ("Searched for tide tables", "2024-10-03T05:00:00.250Z"), ("Searched for ", "2024-10-03T05:01:00.000Z"),
            ("Searched for tide tables", "2024-10-03T05:00:00.250Z"), ("Visited the harbour", "2024-10-03T05:02:00.000Z"),
            ("Searched for knots", "2024-10-04T23:10:00.000Z"), ("Searched for paint", "2024-10-05T01:00:00.000Z"))])
    video = lambda title, time, **more: {"title": title, "time": time, **more}
    _json(root / "YouTube and YouTube Music" / "history" / "watch-history.json", [
        video("Watched Splicing", "2024-08-08T08:08:00.000Z", subtitles=[{"name": "Ropewalk", "url": "https://example.org/r"}]),
        video("Watched an advert", "2024-08-09T10:00:00.000Z", details=[{"name": "From Google Ads"}]),
        video("Watched https://example.org/removed", "2024-08-10T10:00:00.000Z")])
    daily = root / "Fit" / "Daily activity metrics" / "Daily activity metrics.csv"
    daily.parent.mkdir(parents=True)
    daily.write_text(
        "Date,Max speed,Distance (m),Step count,Calories (kcal),Move Minutes count\n"
        "2024-07-01,1.5,812.25,1003,1701.5,12\n2024-07-02,,,,,\n", encoding="utf-8",
    )
    session = lambda kind, start, end, seconds, kcal: {
        "fitnessActivity": kind, "startTime": start, "endTime": end, "duration": seconds,
        "aggregate": [{"metricName": "com.google.step_count.delta", "floatValue": 9.0},
                      {"metricName": "com.google.calories.expended", "floatValue": kcal}],
    }
    _json(root / "Fit" / "All Sessions" / "m_ROWING.json", session(
        "Rowing", "2024-07-01T05:45:00.000+05:30", "2024-07-01T06:30:30.000+05:30", "2730.000s", 288.125))
    _json(root / "Fit" / "All Sessions" / "n_ROCK_CLIMBING.json", session(
        "Rock climbing", "2024-07-06T16:00:00.000+05:30", "2024-07-06T17:15:00.000+05:30", "4500.000s", 501.5))
    events = [
        ["DTSTART;TZID=America/Lima:20240704T090000", "SUMMARY:Launch\\; west", "  dock", "RRULE:FREQ=DAILY;COUNT=3"],
        ["DTSTART;VALUE=DATE:20240720", "DTEND;VALUE=DATE:20240722", "SUMMARY:Regatta", "UID:reg@x"],
        ["DTSTART:20240801T000500Z", "DTEND:20240801T001000Z", "SUMMARY:Tide\\, low", "UID:tide@x"],
        ["SUMMARY:No start"],
    ]
    lines = ["BEGIN:VCALENDAR", *[x for e in events for x in ("BEGIN:VEVENT", *e, "END:VEVENT")], "END:VCALENDAR", ""]
    ics = root / "Calendar" / "Harbour.ics"
    ics.parent.mkdir(parents=True)
    ics.write_bytes("\r\n".join(lines).encode())
    return str(root.parent)
