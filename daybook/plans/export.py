"""Results as CSV or JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, DoubleType, FloatType, TimestampNTZType, TimestampType


def display(df: DataFrame) -> DataFrame:
    """Every column as display text: thousands, two decimals, minutes; NULL becomes empty."""

    def text(name: str, kind) -> Column:
        value = F.col(f"`{name}`")
        if isinstance(kind, DecimalType):
            shown = F.format_number(value, 2)
        elif isinstance(kind, (DoubleType, FloatType)):
            shown = F.regexp_replace(F.format_number(value, 2), r"\.?0+$", "")
        elif isinstance(kind, (TimestampType, TimestampNTZType)):
            shown = F.date_format(value, "yyyy-MM-dd HH:mm")
        elif isinstance(kind, DateType):
            shown = F.date_format(value, "yyyy-MM-dd")
        else:
            shown = value.cast("string")
        return F.coalesce(shown, F.lit("")).alias(name)

    return df.select(*[text(f.name, f.dataType) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside values are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
