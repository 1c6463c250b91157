"""Profiles of tables: status, vocabulary, numeric footer, row cap, import summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from daybook.fixed_values import DEFAULT_ROW_CAP, VOCABULARY_CAP
from daybook.operators.merge import KEY


def table_status(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table, rows, first_day, last_day) of each table; one aggregate per table."""
    parts = [
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(ts).cast("date").alias("first_day"),
            F.max(ts).cast("date").alias("last_day"),
        ).select(F.lit(name).alias("table"), "*")
        for name, (df, ts) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def date_range(df: DataFrame, ts: str) -> DataFrame:
    """First and last day of a column."""
    return df.agg(F.min(ts).cast("date").alias("first_day"), F.max(ts).cast("date").alias("last_day"))


def vocabulary(
    tables: Mapping[str, DataFrame],
    columns: Sequence[tuple[str, str]],
    sharing: str = "categorical",
    cap: int = VOCABULARY_CAP,
) -> DataFrame:
    """Distinct values of closed columns, the first ``cap`` of each: (table, column, value).

    Every table is scanned once whatever the number of its columns. ``sharing="none"``
    gives no rows.
    """
    wanted: dict[str, list[str]] = {}
    for table, column in columns:
        wanted.setdefault(table, []).append(column)
    parts = []
    for table, names in wanted.items():
        pairs = F.array(
            *[F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in names]
        )
        parts.append(
            tables[table].select(F.lit(table).alias("table"), F.inline(pairs)).filter("value is not null").distinct()
        )
    first = Window.partitionBy("table", "column").orderBy("value")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("_n", F.row_number().over(first))
    keep = F.col("_n") <= cap
    return ranked.filter(keep if sharing == "categorical" else F.lit(False)).drop("_n")


def numeric_summary(df: DataFrame) -> DataFrame:
    """Total and average of the first numeric column without NULLs; no row below two rows."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, total double, average double")
    stats = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(names)],
        *[F.sum(F.col(f"`{c}`")).cast("double").alias(f"_s{i}") for i, c in enumerate(names)],
    )
    first = F.coalesce(
        *[
            F.when(
                F.col(f"_n{i}") == F.col("_n"),
                F.struct(F.lit(c).alias("column"), F.col(f"_s{i}").alias("total")),
            )
            for i, c in enumerate(names)
        ]
    )
    return (
        stats.withColumn("_f", first)
        .filter("_n >= 2 and _f is not null")
        .select("_f.column", "_f.total", (F.col("_f.total") / F.col("_n")).alias("average"))
    )


def capped(df: DataFrame, n: int = DEFAULT_ROW_CAP, order: Sequence[str] = ()) -> DataFrame:
    """At most ``n`` rows of an interactive result, the first by ``order``."""
    return (df.orderBy(*order) if order else df).limit(n)


def category_counts(transactions: DataFrame) -> DataFrame:
    """How many rows there are and how many carry a category."""
    return transactions.agg(
        F.count("category").alias("categorized"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("category").isNull()).alias("uncategorized"),
    )


def load_metrics(
    source: str, table: str, batch: DataFrame, target: DataFrame, ts: str
) -> DataFrame:
    """One row on a load into one table: inserted, skipped and the days the table then spans.

    Only keys and dates are read. Rows of equal key carry an equal date, so the span is that
    of batch and target together.
    """
    sides = batch.select(KEY, F.col(ts).alias("_t"), F.lit(1).alias("_b")).unionByName(
        target.select(KEY, F.col(ts).alias("_t"), F.lit(0).alias("_b"))
    )
    per_key = sides.groupBy(KEY).agg(
        F.sum("_b").alias("_n"),
        F.min("_b").alias("_only"),
        F.min("_t").alias("_lo"),
        F.max("_t").alias("_hi"),
    )
    return per_key.agg(
        F.count_if(F.col("_only") == 1).alias("rows_inserted"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_total"),
        F.min("_lo").cast("date").alias("first_day"),
        F.max("_hi").cast("date").alias("last_day"),
    ).select(
        F.lit(source).alias("source"),
        F.lit(table).alias("table"),
        "rows_inserted",
        (F.col("_total") - F.col("rows_inserted")).alias("rows_skipped"),
        "first_day",
        "last_day",
    )


def merge_metrics(metrics: Sequence[DataFrame]) -> DataFrame:
    """Metrics of several loads folded per source, with the tables each one touched."""
    return (
        reduce(DataFrame.unionByName, metrics)
        .groupBy("source")
        .agg(
            F.sum("rows_inserted").alias("rows_inserted"),
            F.sum("rows_skipped").alias("rows_skipped"),
            F.array_join(F.sort_array(F.collect_set("table")), "|").alias("tables"),
            F.min("first_day").alias("first_day"),
            F.max("last_day").alias("last_day"),
        )
    )
