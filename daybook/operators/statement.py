"""Statement cells to transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.amounts import debit_credit, parse_amount
from daybook.functions.dates import local_to_instant, parse_date
from daybook.functions.keys import with_transaction_key
from daybook.operators.columns import computed_once
from daybook.operators.enrich import enrich
from daybook.schemas import BankProfile, CategoryRule


def statement_amount(strict: bool = False, zero_is_null: bool = False) -> Column:
    """Signed amount by the style of the row's profile."""
    pair = debit_credit(F.col("debit_text"), F.col("credit_text"), strict, zero_is_null)
    single = parse_amount(F.col("amount_text"), strict)
    return F.when(F.col("amount_style") == "debit_credit", pair).otherwise(single)


def statement_day(profiles: Sequence[BankProfile]) -> Column:
    """Day of a row: the format of its profile first, then the fallbacks."""
    text = F.col("date_text")
    day = parse_date(text)
    for p in profiles:
        if p.date_format:
            own = parse_date(text, [p.date_format])
            day = F.when(F.col("profile") == p.name, own).otherwise(day)
    return day


def normalize_statement(
    rows: DataFrame,
    profiles: Sequence[BankProfile],
    rules: Sequence[CategoryRule],
    tz: str = "UTC",
    currency: str = "INR",
    account: str | None = None,
    strict: bool = False,
    zero_is_null: bool = False,
) -> DataFrame:
    """Curated transactions of statement rows; balance lines and unreadable rows are dropped.

    The account is the given one, else a column of that name, else the profile's name.
    """
    if account:
        owner = F.lit(account)
    else:
        owner = F.col("account") if "account" in rows.columns else F.col("profile")
    # Bookkeeping columns of the scan, which order duplicates and count rows per file.
    carried = [c for c in ("path", "block", "line_id", "pos", "row_no") if c in rows.columns]
    read = rows.select(
        statement_day(profiles).alias("_day"),
        statement_amount(strict, zero_is_null).alias("amount"),
        F.trim("narration_text").alias("narration"),
        owner.alias("account"),
        *carried,
    )
    kept = computed_once(read).filter(
        F.col("_day").isNotNull()
        & F.col("amount").isNotNull()
        & (F.col("narration") != "")
        & ~F.lower("narration").rlike("(opening|closing) balance")
    )
    shaped = (
        kept.withColumn("ts", local_to_instant(F.col("_day"), tz))
        .withColumn("currency", F.lit(currency))
        .withColumn("source", F.lit("bank"))
        .drop("_day")
    )
    return with_transaction_key(enrich(shaped, rules), tz)
