"""What the operators share: tables, keys that order nulls last, and word runs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import time
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "16m"
# The white space that separates words; other white space is part of a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """How many pieces a shuffle makes: the session's own setting, which grows with the cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_last_key(name: str) -> Column:
    """A non-null string that sorts as the text column does, by code point with null last."""
    c = F.col(f"`{name}`").cast("string")
    return F.concat(F.when(c.isNull(), "1").otherwise("0"), F.coalesce(c, F.lit("")))


def md5_number(*parts: Column) -> Column:
    """A number below 2**32 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def crc32_mod(name: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")) % m


def arrow_strings(column) -> list[str]:
    """The texts of an Arrow column; null is empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_daybook_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="daybook-")) / "daybook_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "daybook").rglob("*.py")):
            out.write(path, str(path.relative_to(root)))
    context.addPyFile(str(archive))
    context._daybook_shipped = True


def give_back() -> None:
    """Return what a worker has freed to the system: workers are used again and would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def forget_words() -> None:
    """Drop the ids of words that this worker has kept, if it ever tokenised."""
    tokens = sys.modules.get("daybook.llm.tokens")
    if tokens is not None:
        tokens.forget()


def map_batches(df: DataFrame, function, schema, tokenises: bool = False) -> DataFrame:
    """``mapInArrow`` with the package at hand; a batch of long rows ends early.

    Workers are used again by other steps: only one that ``tokenises`` finds the words kept there by the last.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        if not tokenises:
            forget_words()
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are over, now and not at some later collection."""
    for _ in range(2):  # what the first round frees in Python holds objects that only the second can drop
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table below the shared folder whose readers are done."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
