"""Chat parsing: styles, dates, continuations, and independence of how files are split."""

from __future__ import annotations

import datetime as dt

import pytest

from daybook.operators import chat
from daybook.sources.chat_lines import text_lines


def lines_of(spark, text, per_chunk=1000):
    rows = [("f", n // per_chunk, n, 0, line) for n, line in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "path string, block long, line_id long, pos int, line string")


def parse(spark, text, per_chunk=1000):
    rows = chat.parse_chat(lines_of(spark, text, per_chunk)).orderBy("message_no").collect()
    return [(r.wall_ts, r.sender, r.text, r.is_media) for r in rows]


@pytest.mark.parametrize(
    "line, dayfirst, ambiguous",
    [
        ("[29/1/2022, 6:05:40 AM] Tove: tide is out", True, False),
        ("7/30/21, 23:59 - Nils: late ferry", False, False),
        ("12/12/19, 1:01 am - Asha: same both ways\n1/2/20, 1:02 am - Asha: and again", True, True),
        ("a boat, no date", True, True),
    ],
)
def test_date_order(spark, line, dayfirst, ambiguous):
    row = chat.detect_date_order(lines_of(spark, line)).first()
    assert (row.dayfirst, row.ambiguous) == (dayfirst, ambiguous)


def test_first_decisive_line_wins(spark):
    row = chat.detect_date_order(lines_of(spark, "03/04/24, 9:14 - A: x\n03/13/24, 9:14 - A: y\n13/03/24, 9:14 - A: z")).first()
    assert (row.dayfirst, row.ambiguous) == (False, False)


TEXT = (
    "lost line\n"
    "12/03/24, 12:05 am - Ana: first: one\n"
    "\n"
    "more\n"
    "12/03/24, 12:06 am - Group was renamed\n"
    "after system\n"
    "31/02/24, 9:00 - Ana: no such day\n"
    "still first\n"
    "12/03/24, 12:30 pm - Ben: <Media omitted>\n"
    "caption\n"
    "[12/03/24, 9:14:33 PM] Ana: other style\n"
    "12/03/24, 23:59:58 - Ben: last"
)


@pytest.mark.parametrize("per_chunk", [1, 2, 3, 5, 100])
def test_messages_do_not_depend_on_chunks(spark, per_chunk):
    assert parse(spark, TEXT, per_chunk) == [
        (dt.datetime(2024, 3, 12, 0, 5), "Ana", "first: one\nmore\nafter system\nstill first", False),
        (dt.datetime(2024, 3, 12, 12, 30), "Ben", "\ncaption\n[12/03/24, 9:14:33 PM] Ana: other style", True),
        (dt.datetime(2024, 3, 12, 23, 59, 58), "Ben", "last", False),
    ]


def test_month_first_file(spark):
    got = parse(spark, "03/04/24, 9:14 - A: x\n03/13/24, 9:15 - A: y")
    assert [g[0].date() for g in got] == [dt.date(2024, 3, 4), dt.date(2024, 3, 13)]


def test_narrow_space_before_pm(spark):
    got = parse(spark, "13/03/24, 9:14 pm - A: x")
    assert got == [(dt.datetime(2024, 3, 13, 21, 14), "A", "x", False)]


def test_warnings(spark):
    row = chat.chat_warnings(lines_of(spark, TEXT)).first()
    assert (row.ambiguous_dates, row.unrecognized, row.unparseable) == (False, False, 1)
    row = chat.chat_warnings(lines_of(spark, "nothing here")).first()
    assert (row.ambiguous_dates, row.unrecognized, row.unparseable) == (True, True, 0)


def test_unusual_line_breaks_and_file_splits(spark, tmp_path):
    body = "\n".join(f"13/03/24, 9:{i % 60:02d} - A: line {i}\x0bsecond third" for i in range(400))
    (tmp_path / "x_chat.txt").write_text(body, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = text_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 3
        rows = chat.parse_chat(lines).orderBy("message_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.text for r in rows] == [f"line {i}\nsecond\nthird" for i in range(400)]
