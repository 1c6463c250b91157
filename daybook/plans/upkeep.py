"""Jobs on the stored tables: new category rules, activities logged by hand, the summary of a run."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators import enrich
from daybook.operators.merge import manual_activities
from daybook.operators.profiling import merge_metrics
from daybook.plans.warehouse import (
    PARTITIONS,
    append_load,
    read_load_warnings,
    read_partitions,
    read_table,
    replace_partitions,
)
from daybook.schemas import TIME_COLUMN, CategoryRule
from daybook.sources import files

RECATEGORIZED = "rows_changed bigint, rows_categorized bigint, partitions_rewritten bigint"
LOGGED = "rows_logged bigint, rows_known bigint"


def recategorize_stored(spark: SparkSession, root: str, rules: Sequence[CategoryRule]) -> DataFrame:
    """Set merchants and categories of the stored transactions anew; returns one row of counts.

    A first pass counts the rows that change per partition (load and month). Only those
    partitions are computed again, staged, and put in place of the old ones; files of all
    others stay as they are. A table without rows or without changes is left alone. After a
    failure a second run finds what is still to change.
    """
    stored = read_partitions(spark, root, "transactions")
    stage = f"{root}/_runs/recategorize-{uuid.uuid4().hex}"
    changed = enrich.recategorize_delta(stored, rules).groupBy(*PARTITIONS).agg(F.count(F.lit(1)).alias("n"))
    changed.write.parquet(f"{stage}/partitions")
    touched = spark.read.parquet(f"{stage}/partitions")
    total = touched.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("parts")).first()
    if total["parts"]:
        affected = stored.join(touched.select(*PARTITIONS), list(PARTITIONS), "left_semi").select(*stored.columns)
        enrich.recategorize(affected, rules).write.parquet(f"{stage}/rows")
        replace_partitions(spark.read.schema(stored.schema).parquet(f"{stage}/rows"), root, "transactions")
    labelled = read_table(spark, root, "transactions").agg(F.count("category").alias("n")).first()["n"]
    return spark.createDataFrame([(total["rows"], labelled, total["parts"])], RECATEGORIZED)


def log_activities(spark: SparkSession, root: str, log: DataFrame, tz: str) -> DataFrame:
    """Append a log of (activity, day, minutes) to the stored activities; returns one row of counts.

    An activity counts once a day, whatever its minutes; the shortest of a log is taken, one
    without minutes first. Without a day it is logged as of now. Rows without an activity are left out.
    """
    entries = log.filter("activity is not null")
    # "Now" is one instant for the whole load: it is written before it is counted.
    fresh = manual_activities(entries, read_table(spark, root, "activities"), tz)
    written = append_load(fresh, root, "activities", f"manual-{uuid.uuid4().hex}").count()
    return spark.createDataFrame([(written, entries.count() - written)], LOGGED)


def run_warnings(spark: SparkSession, root: str, metrics: DataFrame, takeout: str | None = None) -> DataFrame:
    """(source, path, warning) of the loads that ``metrics`` tells of, a folder of a takeout export
    given also the products it lacks. The warnings of a load that read nothing new are not repeated."""
    told = metrics.filter("files_imported > 0").select("load").distinct()
    found = read_load_warnings(spark, root).join(told, "load", "left_semi").select("source", "path", "warning")
    if takeout is None:
        return found
    lacking = files.missing_products(files.find_files(spark, takeout)).filter("missing")
    absent = F.concat("product", F.lit(": not present in this export"))
    return found.unionByName(lacking.select(F.lit("takeout").alias("source"), F.lit(takeout).alias("path"), absent.alias("warning")))


def run_summary(spark: SparkSession, root: str, metrics: DataFrame, takeout: str | None = None) -> DataFrame:
    """One row per source of a run: rows and files, tables, the days those tables now span, number of warnings."""
    spans = [
        read_table(spark, root, table).agg(
            F.min(time).cast("date").alias("first_day"), F.max(time).cast("date").alias("last_day")
        ).select(F.lit(table).alias("table"), "first_day", "last_day")
        for table, time in TIME_COLUMN.items()
    ]
    merged = merge_metrics([metrics.join(reduce(DataFrame.unionByName, spans), "table")])
    counted = metrics.groupBy("source").agg(
        F.sum("files_imported").alias("files_imported"), F.sum("files_skipped").alias("files_skipped")
    )
    warned = run_warnings(spark, root, metrics, takeout).groupBy("source").agg(F.count(F.lit(1)).alias("warnings"))
    return (
        merged.join(counted, "source").join(warned, "source", "left")
        .withColumn("warnings", F.coalesce("warnings", F.lit(0)))
    )
