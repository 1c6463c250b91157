"""Idempotent loads: row dedupe by key, the file ledger, appends by column name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.fixed_values import ACTIVITY_ALIASES
from daybook.functions.dates import local_day, local_to_instant
from daybook.functions.keys import with_manual_key

KEY = "dedupe_key"


def collapse(batch: DataFrame, order: Sequence[str], key: str = KEY) -> DataFrame:
    """One row per key, the first by ``order``.

    The rank filter is pushed below the shuffle, so a key that fills the batch sends one
    row per task.
    """
    first = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return batch.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def latest(batch: DataFrame, order: Sequence[str], key: str = KEY) -> DataFrame:
    """One row per key, the last by ``order``."""
    last = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return batch.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")


def near(target: DataFrame, batch: DataFrame, ts: str, margin_days: int = 2) -> DataFrame:
    """Target rows dated within the span of the batch, give or take some days.

    The bounds are scalar subqueries, whose values Spark hands to the Parquet scan, so a load
    of one month does not read the keys of all years. Rows without a time may equal any batch
    row without one, so they stay. An empty batch keeps nothing else.
    """
    day = F.col(ts).cast("date")
    first = batch.agg(F.date_sub(F.min(day), margin_days).alias("d")).scalar()
    last = batch.agg(F.date_add(F.max(day), margin_days + 1).alias("d")).scalar()
    return target.filter(F.col(ts).isNull() | (F.col(ts) >= first) & (F.col(ts) < last))


def insert_dedupe(
    batch: DataFrame,
    target: DataFrame,
    order: Sequence[str],
    key: str = KEY,
    within: str | None = None,
) -> DataFrame:
    """Rows of the batch to append: collapsed by key, without the keys the target has.

    ``within`` names a time column that rows of equal key agree on, to the day; only the
    target rows near the batch are looked at then. Pass a written batch, for it is read
    once more. Leave it out for keys that say nothing of time, such as a calendar UID.
    """
    if within:
        target = near(target.select(key, within), batch, within)
    return collapse(batch, order, key).join(target.select(key), key, "left_anti")


def insert_counts(batch: DataFrame, target: DataFrame, key: str = KEY) -> DataFrame:
    """(rows_inserted, rows_skipped) of such a load, from the keys alone."""
    batch_keys = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = target.select(key).distinct().withColumn("_known", F.lit(True))
    is_new = F.col("_known").isNull()
    return (
        batch_keys.join(known, key, "left")
        .agg(
            F.count_if(is_new).alias("rows_inserted"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"),
        )
        .select("rows_inserted", (F.col("_total") - F.col("rows_inserted")).alias("rows_skipped"))
    )


def upsert_latest(
    batch: DataFrame, target: DataFrame, order: Sequence[str], key: str = KEY
) -> DataFrame:
    """The whole target after corrections: a batch row replaces the target row of its key."""
    fresh = latest(batch, order, key)
    kept = target.join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh)


def append_by_name(staged: DataFrame, more: DataFrame) -> DataFrame:
    """Append rows by column name; columns either side lacks become NULL."""
    return staged.unionByName(more, allowMissingColumns=True)


def new_files(files: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Files whose content was not imported yet; ``force`` keeps all."""
    if force:
        return files
    return files.join(ledger.select("file_sha256"), "file_sha256", "left_anti")


def upsert_ledger(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """Ledger after an import: path, time and rows of the last entry, source of the first."""
    last = F.max_by(F.struct("path", "rows_inserted"), "imported_at")
    return (
        ledger.unionByName(entries)
        .groupBy("file_sha256")
        .agg(
            last.alias("_l"),
            F.min_by("source", "imported_at").alias("source"),
            F.max("imported_at").alias("imported_at"),
        )
        .select(
            "file_sha256",
            F.col("_l.path").alias("path"),
            "source",
            "imported_at",
            F.col("_l.rows_inserted").alias("rows_inserted"),
        )
    )


def activity_label(spoken: Column) -> Column:
    """Alias of a spoken activity, else the words joined by underscores."""
    lower = F.lower(spoken)
    label = F.replace(lower, F.lit(" "), F.lit("_"))
    for alias, name in ACTIVITY_ALIASES.items():
        label = F.when(lower == alias, F.lit(name)).otherwise(label)
    return label


def manual_activities(
    log: DataFrame, activities: DataFrame, tz: str = "UTC", order: Sequence[str] = ("duration_min",)
) -> DataFrame:
    """Rows to append for a log of (activity, day, minutes): noon local, one per day and type.

    Without a day an activity is logged as of now, on the local day of now.
    """
    noon = F.col("day").cast("timestamp_ntz") + F.expr("interval 12 hours")
    now = F.current_timestamp()
    rows = log.select(
        F.coalesce("day", local_day(now, tz)).alias("day"),
        F.coalesce(local_to_instant(noon, tz), now).alias("ts_start"),
        F.lit(None).cast("timestamp").alias("ts_end"),
        activity_label(F.col("activity")).alias("activity_type"),
        F.col("minutes").cast("double").alias("duration_min"),
        F.lit(None).cast("double").alias("calories"),
        F.lit(None).cast("int").alias("steps"),
        F.lit("manual").alias("source"),
    )
    keyed = with_manual_key(rows, F.col("day")).drop("day")
    return insert_dedupe(keyed, activities, order)
