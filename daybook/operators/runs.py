"""Sums along the rows of a file that lies in many splits, and numbers of runs of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, amount: Column, file: Sequence[str], chunk: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """Add the sum of ``amount`` over the rows of a file up to and with each row; null counts as 0.

    Amounts are added up per chunk, and a table of one row per chunk carries the sums of
    the chunks before. So no task needs a whole file.
    """
    marked = rows.withColumn("_amount", F.coalesce(amount.cast("long"), F.lit(0)))
    earlier = Window.partitionBy(*file).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        marked.groupBy(*file, *chunk)
        .agg(F.sum("_amount").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    so_far = (
        Window.partitionBy(*file, *chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.join(before, [*file, *chunk])
        .withColumn(into, F.col("_before") + F.sum("_amount").over(so_far))
        .drop("_amount", "_before")
    )


def number_runs(
    lines: DataFrame,
    start: Column,
    file: Sequence[str],
    chunk: Sequence[str],
    order: Sequence[str],
    into: str = "run_no",
) -> DataFrame:
    """Add the number of the run of each line within its file; lines before the first are 0.

    A run starts at a marked line and lasts to the next one.
    """
    return running_sum(lines, start.cast("int"), file, chunk, order, into)
