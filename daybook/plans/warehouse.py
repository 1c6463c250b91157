"""A folder of curated Parquet tables that loads append to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from daybook.operators.merge import upsert_ledger
from daybook.schemas import CURATED, LEDGER, TIME_COLUMN, conform

LEDGER_TABLE = "_imports"
WARNINGS_TABLE = "_warnings"
# Folders of a curated table: one per load, in it one per month of its rows.
PARTITIONS = ("load", "month")
WARNINGS = StructType().add("source", "string").add("path", "string").add("warning", "string")


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A curated table; empty before its first load."""
    return _read(spark, f"{root}/{table}", CURATED[table])


def read_raw(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A raw staging table over all its loads; columns a load lacks are NULL."""
    return spark.read.option("mergeSchema", True).parquet(f"{root}/{table}")


def read_warnings(spark: SparkSession, root: str) -> DataFrame:
    """What import jobs noticed: (source, path, warning)."""
    return _read(spark, f"{root}/{WARNINGS_TABLE}", WARNINGS)


def read_load_warnings(spark: SparkSession, root: str) -> DataFrame:
    """As ``read_warnings``, with the load of each."""
    return _read(spark, f"{root}/{WARNINGS_TABLE}", StructType([*WARNINGS.fields, StructField("load", StringType())]))


def append_warnings(warnings: DataFrame, root: str, load: str) -> None:
    warnings.select(*WARNINGS.names).write.mode("overwrite").parquet(f"{root}/{WARNINGS_TABLE}/load={load}")


def append_load(df: DataFrame, root: str, table: str, load: str) -> DataFrame:
    """Write one load of a table, by month, and read it back with its file of origin.

    A load has a folder of its own that a retry overwrites, so writing it twice adds no rows.
    Rows of a month come together to keep files few; a month that is too large for a task is split.
    """
    path = f"{root}/{table}/load={load}"
    origin = F.col("path") if "path" in df.columns else F.lit(None).cast("string")
    curated = conform(df.withColumn("_path", origin), table, extra=("_path",))
    month = F.date_format(TIME_COLUMN[table], "yyyyMM").cast("int")
    by_month = curated.withColumn("month", month).hint("rebalance", "month")
    by_month.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("month").parquet(path)
    return df.sparkSession.read.schema(by_month.schema).parquet(path)


def read_partitions(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A curated table with the file of origin, load and month of every row."""
    schema = StructType([*CURATED[table].fields])
    for name, kind in (("_path", "string"), ("load", "string"), ("month", "integer")):
        schema = schema.add(name, kind)
    return _read(spark, f"{root}/{table}", schema)


def replace_partitions(df: DataFrame, root: str, table: str) -> None:
    """Put ``df`` in the place of the partitions (load, month) it has rows of; leave all others.

    ``df`` must not be read from the table itself: stage it first. A partition is replaced as a
    whole, so running it again after a failure ends in the same table.
    """
    rows = df.hint("rebalance", *PARTITIONS)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*PARTITIONS).parquet(f"{root}/{table}")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Current ledger: the entries appended so far, one row per content hash."""
    entries = _read(spark, f"{root}/{LEDGER_TABLE}", LEDGER)
    return upsert_ledger(entries.limit(0), entries)


def append_ledger(entries: DataFrame, root: str) -> None:
    """Append ledger entries; the latest one per hash counts."""
    entries.select(*LEDGER.names).write.mode("append").parquet(f"{root}/{LEDGER_TABLE}")
