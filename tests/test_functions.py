"""Parsing, keys and text helpers."""

from __future__ import annotations

import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from daybook.functions import amounts, dates, keys, text
from daybook.operators import enrich
from daybook.operators.merge import activity_label
from daybook.schemas import CategoryRule


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, day",
    [
        ("01/02/2026", dt.date(2026, 2, 1)), ("1/2/26", dt.date(2026, 2, 1)), ("01-02-99", dt.date(1999, 2, 1)),
        (" 2026-02-01 ", dt.date(2026, 2, 1)), ("1 Feb 2026", dt.date(2026, 2, 1)), ("01-Feb-2026", dt.date(2026, 2, 1)),
        ("1 February 2026", dt.date(2026, 2, 1)), ("31/02/2026", None), ("n/a", None), ("", None), (None, None),
    ],
)
def test_parse_date(spark, raw, day):
    assert one(spark, raw, dates.parse_date) == day


def test_own_format_comes_first(spark):
    assert one(spark, "02/01/2026", lambda c: dates.parse_date(c, ["%m/%d/%Y"])) == dt.date(2026, 2, 1)


@pytest.mark.parametrize(
    "raw, compat, strict",
    [
        ("₹1,240.00", "1240.00", "1240.00"), ("1,240.00 Dr", "-1240.00", "-1240.00"),
        ("1,240.00 CR", "1240.00", "1240.00"), ("-5", "-5.00", "-5.00"), ("Rs.500", "0.50", "500.00"),
        ("1,240.00 Dr.", None, "-1240.00"), ("", None, None), ("abc", None, None), (None, None, None),
    ],
)
def test_amount(spark, raw, compat, strict):
    as_decimal = lambda v: None if v is None else Decimal(v)
    assert one(spark, raw, amounts.parse_amount) == as_decimal(compat)
    assert one(spark, raw, lambda c: amounts.parse_amount(c, strict=True)) == as_decimal(strict)


def test_debit_hides_credit_unless_told(spark):
    df = spark.createDataFrame([("0.00", "9.00")], "d string, c string")
    pair = lambda **kw: df.select(amounts.debit_credit(F.col("d"), F.col("c"), **kw).alias("r")).first().r
    assert pair() == Decimal("0.00")
    assert pair(zero_is_null=True) == Decimal("9.00")


@pytest.mark.parametrize("raw, n", [("3.7", 4), ("1e3", 1000), ("x", None), ("-2.5", -3), (None, None)])
def test_safe_int(spark, raw, n):
    assert one(spark, raw, text.safe_int) == n


def test_text_helpers(spark):
    assert one(spark, "2700.5s", text.duration_minutes) == pytest.approx(2700.5 / 60)
    assert one(spark, "90", text.duration_minutes) == 1.5
    assert one(spark, "soon", text.duration_minutes) is None
    assert one(spark, " Strength training! ", text.snake_case) == "strength_training"
    assert one(spark, "", text.snake_case) is None
    assert one(spark, " a b \n c ", text.word_count) == 3
    assert one(spark, "", text.word_count) is None
    assert one(spark, "﻿‎a b‏", text.clean_line) == "a b"
    assert one(spark, "The cat_2 is ÉTÉ, a co-op", text.tokens) == ["the", "cat_2", "été"]
    assert one(spark, "Gym", activity_label) == "strength_training"
    assert one(spark, "Evening Walk", activity_label) == "evening_walk"


def test_term_counts_match_a_plain_count(spark):
    docs = ["the cat the dog the end", "", "a an", "one", None, "bee bee bee"]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    got = {r.i: [(x.term, x.tf) for x in r.term_counts or []] for r in text.with_term_counts(df, "t").collect()}
    assert got == {
        0: [("cat", 1), ("dog", 1), ("end", 1), ("the", 3)], 1: [], 2: [], 3: [("one", 1)], 4: [], 5: [("bee", 3)]}


def test_row_key(spark):
    df = spark.createDataFrame([("a", None, 3)], "a string, b string, c int")
    got = df.select(keys.row_key("x", F.col("a"), F.col("b"), F.col("c")).alias("k")).first().k
    assert got == hashlib.sha256(b"x|a||3").hexdigest()


@pytest.mark.parametrize("tz", ["UTC", "America/New_York", "Asia/Kolkata", "Europe/Berlin"])
def test_keys_do_not_move_with_the_session_zone(spark, zoned, tz):
    # Instants around the 2024 clock changes of New York and Berlin.
    seconds = [1710054000 + 1800 * i for i in range(8)] + [1711846800 + 1800 * i for i in range(8)]
    zoned(tz)
    df = spark.createDataFrame([(s,) for s in seconds], "s long").select(
        F.timestamp_seconds("s").alias("ts"), F.lit("t").alias("track"), F.lit("a").alias("artist"),
        F.lit(1).alias("ms_played"), "s")
    for r in keys.with_listen_key(df).collect():
        wall = dt.datetime.fromtimestamp(r.s, dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
        assert r.dedupe_key == hashlib.sha256(f"spotify|{wall}|t|a|1".encode()).hexdigest()


def test_merchant_and_category(spark):
    starter = [CategoryRule("swiggy|zomato", "food_delivery"), CategoryRule("ola", "transport")]
    rows = ["UPI/DR/604/ZOMATO/UTIB/z@x", "UPI-SWIGGY-s@icici-42", "POS 4123 AMAZON PAY", "IMPS-HDFC1-Ram Kumar", "Coca Cola"]
    df = spark.createDataFrame([(r,) for r in rows], "narration string")
    got = [(r.merchant, r.category) for r in enrich.enrich(df, starter).collect()]
    assert got == [
        ("ZOMATO", "food_delivery"), ("SWIGGY", "food_delivery"), ("AMAZON PAY", None), ("RAM KUMAR", None), (None, "transport")]


def test_rules_table_in_both_forms(spark):
    rules = spark.createDataFrame(
        [(0, None, "z"), (1, r"pay\s+ind", "a"), (1, "upi", None), (1, "", "z"), (2, "amazon|zomato", "b"), (3, "o", "c"), (4, "^upi", "d")],
        "rule_no int, match string, category string")
    rows = ["POS 1 AMAZON PAY INDIA", "UPI-ZOMATO-z-1", "POS 2 AMAZON", "UPI only", "NEFT-B1-POLO", "zzz"]
    df = spark.createDataFrame([(r,) for r in rows], "narration string")
    inline = {r.narration: r.category for r in enrich.enrich(df, enrich.listed_rules(rules)).collect()}
    joined = {r.narration: r.category for r in enrich.enrich_by_table(df, rules).collect()}
    assert inline == joined == dict(zip(rows, ["a", "b", "b", "c", "c", None]))


def test_unusable_rules_are_left_out(spark):
    rows = [(3, "k", "late"), (1, "tea", "drink"), (2, None, "gone"), (4, "x", ""), (5, "", "gone"), (6, "y", None)]
    table = spark.createDataFrame(rows, "rule_no int, match string, category string")
    assert enrich.listed_rules(table) == [CategoryRule("tea", "drink"), CategoryRule("k", "late")]


def test_recategorize(spark):
    old, new = [CategoryRule("noodle", "food"), CategoryRule("curry", "food")], [CategoryRule("acme", "salary"), CategoryRule("noodle", "food")]
    df = spark.createDataFrame([("UPI-NOODLE-x-1",), ("UPI-CURRY-x-1",), ("NEFT-B1-ACME",)], "narration string")
    stored = enrich.enrich(df, old)
    assert [r.category for r in enrich.recategorize(stored, new).collect()] == ["food", None, "salary"]
    assert {r.merchant for r in enrich.recategorize_delta(stored, new).collect()} == {"CURRY", "ACME"}
