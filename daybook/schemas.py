"""Schemas of the curated tables, the import ledger and the configuration rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _schema(columns: str) -> StructType:
    """A schema from ``name type`` pairs; ``!`` after the type forbids NULL."""
    schema = StructType()
    for column in columns.split(", "):
        name, kind = column.split(" ")
        schema.add(name, kind.rstrip("!"), not kind.endswith("!"))
    return schema


CURATED: dict[str, StructType] = {
    "transactions": _schema(
        "ts timestamp!, amount decimal(12,2)!, currency string, narration string, "
        "merchant string, category string, account string, source string!, "
        "dedupe_key string!"
    ),
    "messages": _schema(
        "ts timestamp!, chat string!, sender string!, "
        "is_me boolean!, text string, is_media boolean, word_count integer, "
        "source string!, dedupe_key string!"
    ),
    "listens": _schema(
        "ts timestamp!, track string, artist string, album string, ms_played integer, "
        "skipped boolean, source string!, dedupe_key string!"
    ),
    "activities": _schema(
        "ts_start timestamp!, ts_end timestamp, activity_type string, "
        "duration_min double, calories double, steps integer, source string!, "
        "dedupe_key string!"
    ),
    "daily_metrics": _schema(
        "day date!, steps integer, distance_m double, calories double, active_min double, "
        "source string!, dedupe_key string!"
    ),
    "searches": _schema(
        "ts timestamp!, query string!, source string!, "
        "dedupe_key string!"
    ),
    "youtube_watches": _schema(
        "ts timestamp!, title string, channel string, source string!, "
        "dedupe_key string!"
    ),
    "calendar_events": _schema(
        "ts_start timestamp!, ts_end timestamp, title string, all_day boolean, "
        "source string!, dedupe_key string!"
    ),
}

LEDGER = _schema(
    "file_sha256 string!, path string, source string, imported_at timestamp, "
    "rows_inserted long"
)

# Column that dates a row, per curated table.
TIME_COLUMN: dict[str, str] = {
    "transactions": "ts",
    "messages": "ts",
    "listens": "ts",
    "activities": "ts_start",
    "daily_metrics": "day",
    "searches": "ts",
    "youtube_watches": "ts",
    "calendar_events": "ts_start",
}

# Closed categorical columns; free text is never listed here.
VOCABULARY_COLUMNS: list[tuple[str, str]] = [
    ("transactions", "category"),
    ("transactions", "account"),
    ("activities", "activity_type"),
]


@dataclass(frozen=True)
class BankProfile:
    """How one bank lays out its statement export."""

    name: str
    header_signature: tuple[str, ...]
    date_col: str
    narration_col: str
    amount_style: str = "signed"
    amount_col: str | None = None
    debit_col: str | None = None
    credit_col: str | None = None
    date_format: str | None = None

    @property
    def signature(self) -> str:
        return "|".join(sorted(h.strip().lower() for h in self.header_signature if h.strip()))


@dataclass(frozen=True)
class CategoryRule:
    """One ordered rule: a case-insensitive regex and the label it gives."""

    match: str
    category: str


def conform(df: DataFrame, table: str, extra: Sequence[str] = ()) -> DataFrame:
    """Project onto a curated schema, plus ``extra`` columns; absent columns become typed NULLs."""
    have = set(df.columns)
    fields = [
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CURATED[table].fields
    ]
    return df.select(*fields, *extra)


def required(table: str) -> list[str]:
    """Columns of a curated table that must have a value."""
    return [f.name for f in CURATED[table].fields if not f.nullable]
