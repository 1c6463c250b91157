"""Every registered query against its SQL, the stream forms, and the shape of the plans."""

from __future__ import annotations

import os

import duckdb
import pytest
from tests.samples import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from daybook.plans import catalog
from daybook.sources import tables
from daybook.streaming import loads
from tools.compare import TABLES, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = duck.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["week_start", "spend"]


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if not n.startswith("stream_")])
def test_no_python_and_no_cartesian_product(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "InPandas", "CartesianProduct"):
        assert bad not in plan


def test_time_filter_reaches_the_scan(spark):
    plan = entry.queries()["spend_in_skipped_weeks"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01" in plan


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    source = tables.transactions(spark, SMALL).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    source.repartition(6).write.parquet(folder)
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    loads.run_to_end(loads.stream_insert_dedupe(stream, out, log, catalog.ROW_ORDER))
    written = spark.read.parquet(out)
    assert written.select("batch").distinct().count() == 6
    assert written.count() == written.select("dedupe_key").distinct().count() == source.select("dedupe_key").distinct().count()
    # Nothing new arrived: a second run adds nothing.
    loads.run_to_end(loads.stream_insert_dedupe(stream, out, log, catalog.ROW_ORDER))
    assert spark.read.parquet(out).count() == written.count()

    rollup = loads.weekly_rollup(stream, "ts", "4000 days", n=F.count(F.lit(1)))
    weeks, log = str(tmp_path / "weeks"), str(tmp_path / "log2")
    loads.run_to_end(loads.write_changes(rollup, weeks, log))
    streamed = loads.current(spark.read.parquet(weeks), ["week_start"])
    batch = source.groupBy(F.date_trunc("week", "ts").cast("date").alias("week_start")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_dedupe_in_stream_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "dedupe_key string, s long").select(
        "dedupe_key", F.timestamp_seconds("s").alias("ts")).write.parquet(folder)
    stream = spark.readStream.schema("dedupe_key string, ts timestamp").parquet(folder)
    query = (
        loads.dedupe_in_stream(stream, "ts", "1 hour").writeStream.format("memory").queryName("deduped")
        .option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start())
    loads.run_to_end(query)
    assert sorted(r.dedupe_key for r in spark.table("deduped").collect()) == ["a", "b"]
