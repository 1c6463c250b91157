"""Row keys: a hash over the natural key of a row, the same under any session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from daybook.functions.dates import local_day, utc_text


def row_key(*parts: Column | str) -> Column:
    """sha256 over the parts joined by ``|``; NULL counts as the empty string."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(
        F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256
    )


def _utc(df: DataFrame, column: str) -> Column:
    return utc_text(F.col(column), isinstance(df.schema[column].dataType, TimestampType))


def with_listen_key(df: DataFrame) -> DataFrame:
    key = row_key("spotify", _utc(df, "ts"), F.col("track"), F.col("artist"), F.col("ms_played"))
    return df.withColumn("dedupe_key", key)


def with_search_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedupe_key", row_key("google_search", _utc(df, "ts"), F.col("query")))


def with_watch_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedupe_key", row_key("youtube", _utc(df, "ts"), F.col("title")))


def with_message_key(df: DataFrame) -> DataFrame:
    parts = [F.col("chat"), _utc(df, "ts"), F.col("sender"), F.col("text")]
    return df.withColumn("dedupe_key", row_key("whatsapp", *parts))


def with_session_key(df: DataFrame) -> DataFrame:
    key = row_key("google_fit", _utc(df, "ts_start"), F.col("activity_type"))
    return df.withColumn("dedupe_key", key)


def with_daily_key(df: DataFrame) -> DataFrame:
    return df.withColumn("dedupe_key", row_key("google_fit", F.col("day")))


def with_event_key(df: DataFrame) -> DataFrame:
    """Calendar rows: the UID where there is one, else start and title."""
    by_uid = row_key("calendar", F.col("uid"))
    by_start = row_key("calendar", _utc(df, "ts_start"), F.col("title"))
    has_uid = F.coalesce(F.col("uid"), F.lit("")) != ""
    return df.withColumn("dedupe_key", F.when(has_uid, by_uid).otherwise(by_start))


def with_transaction_key(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Statements date by day only, so equal payments on one day and account share a key."""
    zoned = isinstance(df.schema["ts"].dataType, TimestampType)
    day = local_day(F.col("ts"), tz) if zoned else F.col("ts").cast("date")
    parts = [F.col("account"), day, F.col("amount"), F.col("narration")]
    return df.withColumn("dedupe_key", row_key("bank", *parts))


def with_manual_key(df: DataFrame, day: Column) -> DataFrame:
    return df.withColumn("dedupe_key", row_key("manual", day, F.col("activity_type")))
