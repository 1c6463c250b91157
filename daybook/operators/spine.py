"""Calendar spines: rows for days and weeks on which nothing happened.

With ``entity`` columns a spine has one calendar per entity; without, there is one calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.fixed_values import GYM_ACTIVITIES
from daybook.functions.dates import as_of_date, month_start, week_start


def earliest_day(facts: Sequence[tuple[DataFrame, str]], entity: Sequence[str] = ()) -> DataFrame:
    """Earliest day over several facts; each fact is reduced before the union."""
    minima = [
        df.groupBy(*entity).agg(F.min(ts).cast("date").alias("first_day")) for df, ts in facts
    ]
    union = reduce(DataFrame.unionByName, minima)
    return union.groupBy(*entity).agg(F.min("first_day").alias("first_day"))


def day_spine(
    facts: Sequence[tuple[DataFrame, str]],
    as_of: str | Column | None = None,
    entity: Sequence[str] = (),
    lookback_days: int = 365,
) -> DataFrame:
    """(entity..., day, week_start, month_start) from the earliest fact, or a year back, to today."""
    today = F.col("_today")
    start = F.least(F.coalesce("first_day", today), F.date_sub(today, lookback_days))
    return (
        earliest_day(facts, entity)
        .withColumn("_today", as_of.cast("date") if isinstance(as_of, Column) else as_of_date(as_of))
        .select(*entity, F.explode(F.sequence(start, today)).alias("day"))
        .select(*entity, "day", week_start(F.col("day")).alias("week_start"), month_start(F.col("day")).alias("month_start"))
    )


def week_spine(days: DataFrame, entity: Sequence[str] = ()) -> DataFrame:
    """Distinct weeks of a day spine."""
    return days.select(*entity, "week_start").distinct()


def calendar_weeks(entities: DataFrame, first: str | Column, last: str | Column) -> DataFrame:
    """Every week between two days for every row of ``entities``."""
    weeks = F.sequence(week_start(F.col("_first")), F.col("_last"), F.expr("interval 7 days"))
    return _between(entities, first, last).select(*entities.columns, F.explode(weeks).alias("week_start"))


def calendar_days(entities: DataFrame, first: str | Column, last: str | Column) -> DataFrame:
    """Every day between two days for every row of ``entities``."""
    days = F.sequence(F.col("_first"), F.col("_last"))
    return _between(entities, first, last).select(*entities.columns, F.explode(days).alias("day"))


def _between(entities: DataFrame, first: str | Column, last: str | Column) -> DataFrame:
    at = lambda d: F.to_date(F.lit(d)) if isinstance(d, str) else d.cast("date")
    return entities.withColumns({"_first": at(first), "_last": at(last)})


def first_and_last(facts: DataFrame, ts: str) -> tuple[Column, Column]:
    """The first and the last day of a fact, as values that a query can use."""
    day = lambda f: facts.agg(f(ts).cast("date").alias("d")).scalar()
    return day(F.min), day(F.max)


def gap_intervals(
    facts: DataFrame, entity: Sequence[str], day: str = "day", first: str | Column | None = None, last: str | Column | None = None
) -> DataFrame:
    """(entity..., gap_start, gap_end, days): the longest runs of days without a fact, from ``first`` to ``last``.

    Both ends are those of all facts unless given. No calendar is laid out: a gap lies between a day of an entity and
    its next one, so the work follows the days with facts. Facts without a day or outside of the ends
    count for their entity's presence only; an entity that has no other is one gap.
    """
    least, most = first_and_last(facts, day)
    ended = _between(facts.select(*entity, F.col(day).cast("date").alias("_day")), least if first is None else first, most if last is None else last)
    inside = F.when(F.col("_day").between(F.col("_first"), F.col("_last")), F.col("_day"))
    seen = ended.withColumn("_day", inside).distinct()
    along = Window.partitionBy(*entity).orderBy(F.col("_day").asc_nulls_first())
    # The entity's row without a day, or the day before the first: where its first gap starts.
    seen = seen.withColumns({"_place": F.row_number().over(along), "_next": F.lead("_day").over(along)})
    after = F.struct(
        F.coalesce(F.date_add("_day", 1), F.col("_first")).alias("gap_start"),
        F.date_sub(F.coalesce("_next", F.date_add("_last", 1)), 1).alias("gap_end"),
    )
    before = F.when((F.col("_place") == 1) & F.col("_day").isNotNull(), F.struct(F.col("_first").alias("gap_start"), F.date_sub("_day", 1).alias("gap_end")))
    found = seen.select(*entity, F.inline(F.array_compact(F.array(before, after)))).filter("gap_start <= gap_end")
    return found.withColumn("days", F.date_diff("gap_end", "gap_start") + 1)


def gap_days(facts: DataFrame, entity: Sequence[str], day: str = "day", **ends) -> DataFrame:
    """(entity..., day): the days of ``gap_intervals`` one by one."""
    found = gap_intervals(facts, entity, day, **ends)
    return found.select(*entity, F.explode(F.sequence("gap_start", "gap_end")).alias(day))


def flag_weeks(
    weeks: DataFrame,
    activities: DataFrame,
    types: Sequence[str] = GYM_ACTIVITIES,
    entity: Sequence[str] = (),
    ts: str = "ts_start",
    flag: str = "went_to_gym",
) -> DataFrame:
    """Flag the weeks that have an activity of one of the types."""
    active = (
        activities.filter(F.col("activity_type").isin(list(types)))
        .select(*entity, week_start(F.col(ts)).alias("week_start"))
        .distinct()
        .withColumn(flag, F.lit(True))
    )
    return weeks.join(active, [*entity, "week_start"], "left").withColumn(
        flag, F.coalesce(flag, F.lit(False))
    )


def gaps(spine: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Spine rows without a fact. ``facts`` is reduced to its distinct keys first."""
    return spine.join(facts.select(*on).distinct(), list(on), "left_anti")
