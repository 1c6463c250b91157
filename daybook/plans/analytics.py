"""Named questions over the curated tables. ``as_of`` is the reporting day, today if absent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.fixed_values import REAL_LISTEN_MS
from daybook.functions.dates import as_of_date, week_start, year_start
from daybook.operators.profiling import table_status
from daybook.operators.spine import gaps
from daybook.schemas import TIME_COLUMN


def weekly_spend(transactions: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """Money spent per week, as a positive sum."""
    return (
        transactions.filter("amount < 0")
        .groupBy(*entity, week_start(F.col("ts")).alias("week_start"))
        .agg(F.sum(-F.col("amount")).alias("spend"))
    )


def at_merchant(transactions: DataFrame, name: str) -> DataFrame:
    """Rows whose merchant or narration mentions a name, in any case."""
    pattern = f"%{name}%"
    return transactions.filter(F.col("merchant").ilike(pattern) | F.col("narration").ilike(pattern))


def spend_in_unflagged_weeks(
    transactions: DataFrame,
    weeks: DataFrame,
    merchant: str,
    as_of: str | None = None,
    since: str | None = None,
    flag: str = "went_to_gym",
) -> DataFrame:
    """Spend at a merchant in each week without the flag, zero where there was none.

    The time bound is a plain comparison on ``ts``, which reaches the scan. ``since``
    defaults to the start of the year.
    """
    today = as_of_date(as_of)
    first = F.to_date(F.lit(since)) if since else year_start(today)
    spend = weekly_spend(at_merchant(transactions.filter(F.col("ts") >= first), merchant))
    quiet = weeks.filter(~F.col(flag) & (F.col("week_start") >= first) & (F.col("week_start") <= today))
    return (
        quiet.join(spend, "week_start", "left")
        .select("week_start", F.round(F.coalesce("spend", F.lit(0))).alias("spend"))
        .orderBy("week_start")
    )


def top_artists(listens: DataFrame, as_of: str | None = None, n: int = 5) -> DataFrame:
    """Artists by hours of real listening in the month before ``as_of``."""
    this_month = F.trunc(as_of_date(as_of), "month")
    last_month = F.add_months(this_month, -1)
    return (
        listens.filter(
            (F.col("ms_played") >= REAL_LISTEN_MS)
            & (F.col("ts") >= last_month)
            & (F.col("ts") < this_month)
        )
        .groupBy("artist")
        .agg(F.sum("ms_played").alias("_ms"))
        .select("artist", F.round(F.col("_ms") / 3600000.0, 1).alias("hours"))
        .orderBy(F.col("hours").desc(), "artist")
        .limit(n)
    )


def days_without_my_messages(
    days: DataFrame, messages: DataFrame, as_of: str | None = None, since: str | None = None
) -> DataFrame:
    """Days on which the owner sent nothing."""
    today = as_of_date(as_of)
    first = F.to_date(F.lit(since)) if since else year_start(today)
    sent = messages.filter(F.col("is_me") & (F.col("ts") >= first)).select(F.col("ts").cast("date").alias("day"))
    wanted = days.filter((F.col("day") >= first) & (F.col("day") <= today)).select("day")
    return gaps(wanted, sent, ["day"]).orderBy("day")


def spend_by_week(weeks: DataFrame, transactions: DataFrame) -> DataFrame:
    """Spend of the spine weeks that have any, with their flag."""
    return weeks.join(weekly_spend(transactions), "week_start").orderBy("week_start")


def status_report(tables: Mapping[str, DataFrame], ledger: DataFrame) -> DataFrame:
    """Rows and days per table, and a last line with the number of files in the ledger."""
    report = table_status({t: (df, TIME_COLUMN[t]) for t, df in tables.items()})
    files = ledger.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("_imports").alias("table"),
        "rows",
        F.lit(None).cast("date").alias("first_day"),
        F.lit(None).cast("date").alias("last_day"),
    )
    return report.unionByName(files)


def run_sql(spark: SparkSession, tables: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Any SQL over the curated tables, which are views of their names for the session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
