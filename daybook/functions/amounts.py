"""Money text to signed decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
PLAIN = r"^-?\d+(?:\.\d+)?$"


def _signed(sign: Column, number: Column) -> Column:
    """The number as it is without a sign, else its magnitude with that sign."""
    pair = F.array(F.struct(sign.alias("s"), number.alias("n")))
    return F.get(
        F.transform(
            pair,
            lambda p: F.when(p["s"] < 0, -F.abs(p["n"]))
            .when(p["s"] > 0, F.abs(p["n"]))
            .otherwise(p["n"])
            .cast(MONEY),
        ),
        F.lit(0),
    )


def parse_amount(text: Column, strict: bool = False) -> Column:
    """Signed amount of one cell: a ``Dr`` suffix makes it negative, ``Cr`` positive.

    The default drops every character but digits, dot and minus, so ``Rs.500`` reads as
    0.50 and ``1,240.00 Dr.`` as NULL. ``strict`` reads the first number instead.
    """
    if strict:
        digits = F.regexp_extract(F.regexp_replace(text, ",", ""), r"-?\d+(?:\.\d+)?", 0)
    else:
        digits = F.regexp_replace(text, "[^0-9.-]", "")
    # The shape is tested first: a cast that fails costs a raised and swallowed error.
    number = F.when(digits.rlike(r"^-?(?:\d+\.?\d*|\.\d+)$"), digits.try_cast(MONEY))
    upper = F.upper(F.coalesce(text, F.lit("")))
    sign = F.when(upper.rlike(r"DR\.?\s*$"), F.lit(-1)).when(upper.rlike(r"CR\.?\s*$"), F.lit(1))
    # Most cells are empty or a plain number, which both ways read as it stands.
    return F.when(text.rlike(PLAIN), text.try_cast(MONEY)).when(text != "", _signed(sign, number))


def debit_credit(
    debit: Column, credit: Column, strict: bool = False, zero_is_null: bool = False
) -> Column:
    """Signed amount of a debit/credit pair; a debit wins over a credit.

    ``zero_is_null`` lets the credit show where the bank fills the debit with ``0.00``.
    """
    out, into = parse_amount(debit, strict), parse_amount(credit, strict)
    if zero_is_null:
        out = F.nullif(out, F.lit(0).cast(MONEY))
    return F.coalesce(-F.abs(out), F.abs(into)).cast(MONEY)
