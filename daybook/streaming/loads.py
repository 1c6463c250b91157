"""Structured Streaming forms of the loads: idempotent inserts and weekly rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from daybook.operators.merge import KEY, insert_dedupe


def _earlier(df: DataFrame, path: str, schema: StructType, batch_id: int) -> DataFrame:
    """What batches before ``batch_id`` wrote."""
    spark = df.sparkSession
    batch_field = StructField("batch", LongType())
    try:
        table = spark.read.schema(StructType([*schema.fields, batch_field])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return table.filter(F.col("batch") < batch_id).drop("batch")


def stream_insert_dedupe(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    order: Sequence[str],
    key: str = KEY,
    within: str | None = None,
) -> StreamingQuery:
    """Append the new rows of a keyed stream to the table at ``path``, each key once.

    The stream checkpoint is the file ledger. A batch writes to a folder of its number and
    looks only at earlier ones, so a batch that is run again after a failure replaces itself.
    Keys are checked against the table, not against state, hence over all history, or over
    the part of it near the batch if ``within`` is given (see ``insert_dedupe``).
    """
    key_schema = StructType([f for f in stream.schema.fields if f.name in (key, within)])

    def write(batch: DataFrame, batch_id: int) -> None:
        known = _earlier(batch, path, key_schema, batch_id)
        insert_dedupe(batch, known, order, key, within).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedupe_in_stream(stream: DataFrame, ts: str, delay: str, key: str = KEY) -> DataFrame:
    """Bounded alternative: duplicates within ``delay`` of each other are dropped by state."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files; the log in their folder names those that count."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def weekly_rollup(stream: DataFrame, ts: str, delay: str, **aggregates) -> DataFrame:
    """Aggregates per Monday week of a stream; late rows count until ``delay`` has passed.

    Seven-day windows are counted from the epoch, a Thursday, and so start four days later.
    """
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, "7 days", "7 days", "4 days").alias("_w"))
        .agg(*[column.alias(name) for name, column in aggregates.items()])
        .select(F.col("_w.start").cast("date").alias("week_start"), *aggregates)
    )


def write_changes(rollup: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the groups each batch changed; ``current`` reads the latest state of every group."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rollup.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current(changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Latest row per group of a table that ``write_changes`` wrote."""
    newest = Window.partitionBy(*key).orderBy(F.col("batch").desc())
    return (
        changes.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")
    )


def run_to_end(query: StreamingQuery) -> None:
    """Wait until an availableNow query has read all there is."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def stream_json_export(spark: SparkSession, folder: str, glob: str, schema: str) -> DataFrame:
    """Raw rows of JSON-array exports as files arrive; feed them to the export's normaliser."""
    return (
        spark.readStream.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .json(folder)
    )
