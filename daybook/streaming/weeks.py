"""Weekly sums of a stream in which weeks close and rows that come too late are kept apart."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

HIGH, WEEKS, LATE = "high", "weeks", "late"
WEEK = "week_start"


def _before(spark: SparkSession, path: str, part: str, batch_id: int) -> DataFrame | None:
    """What the batch before ``batch_id`` left in a part of the table; None ahead of the first."""
    return spark.read.parquet(f"{path}/{part}/batch={batch_id - 1}") if batch_id else None


def _summed(rows: DataFrame, sums: Mapping[str, str]) -> DataFrame:
    return rows.groupBy(WEEK).agg(*[F.sum(name).cast(kind).alias(name) for name, kind in sums.items()])


def close_weeks(
    stream: DataFrame, path: str, checkpoint: str, ts: str, delay: str, sums: Mapping[str, str]
) -> StreamingQuery:
    """Sum columns of a stream by Monday week; a week closes ``delay`` after its end.

    Time is the largest ``ts`` of earlier batches. A row is late if its week had closed before
    its batch began; late rows and rows without a time go to the table ``late`` as they came.
    ``sums`` maps the columns to sum to the type of their sum. Between batches only the sums of
    open weeks are carried on, so state is bounded by the delay and not by the history; a
    closed week is written once. Each batch writes folders of its own number and reads those of
    the batch before, so a batch that runs again after a failure replaces itself.

    An empty batch changes nothing; equal rows all count, since keys are the load's matter.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known, carried = (_before(spark, path, part, batch_id) for part in (HIGH, WEEKS))
        before = known.first()["high"] if known is not None else None
        rows = batch.persist()
        try:
            earlier = F.lit(before).cast("timestamp")
            newest = rows.agg(F.greatest(F.max(F.col(ts).cast("timestamp")), earlier).alias("high"))
            newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/{HIGH}/batch={batch_id}")
            high = spark.read.parquet(f"{path}/{HIGH}/batch={batch_id}").first()["high"]
            week = F.date_trunc("week", ts)
            late = F.col(ts).isNull() | F.coalesce(_closed(week, before, delay), F.lit(False))
            rows.filter(late).write.mode("overwrite").parquet(f"{path}/{LATE}/batch={batch_id}")
            weeks = _summed(rows.filter(~late).withColumn(WEEK, week.cast("date")), sums)
            if carried is not None:
                weeks = _summed(weeks.unionByName(carried.filter("is_open").drop("is_open")), sums)
            done = F.coalesce(_closed(F.col(WEEK).cast("timestamp"), high, delay), F.lit(False))
            # A row per week that is open or closes now; few enough for one file.
            weeks.withColumn("is_open", ~done).coalesce(1).write.mode("overwrite").parquet(f"{path}/{WEEKS}/batch={batch_id}")
        finally:
            rows.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _closed(week: Column, high: datetime | None, delay: str) -> Column:
    """Whether a week had ended ``delay`` before the time ``high``; NULL while no row has come."""
    return week + F.expr("interval 7 days") <= F.lit(high).cast("timestamp") - F.expr(f"interval {delay}")


def closed_weeks(spark: SparkSession, path: str) -> DataFrame:
    """Weeks that no row can change any more."""
    return spark.read.parquet(f"{path}/{WEEKS}").filter("not is_open").drop("batch")


def open_weeks(spark: SparkSession, path: str) -> DataFrame:
    """Sums so far of the weeks still open, as the newest batch left them."""
    newest = spark.read.parquet(f"{path}/{HIGH}").agg(F.max("batch").alias("b")).first()["b"]
    return spark.read.parquet(f"{path}/{WEEKS}/batch={newest}").filter("is_open")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose week had closed or that have no time, with the number of their batch."""
    return spark.read.parquet(f"{path}/{LATE}")
