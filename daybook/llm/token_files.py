"""Write the token ids of documents, in order of their ids, as coded files, and read them back.

Documents are range-partitioned by id; a task encodes texts and writes a file for every
``FILE_IDS`` ids (``codec`` has the format). File names carry their place, a task that runs again
writes the same bytes, and a file appears under its name only when it is whole. Reading is
Spark's: whole files as rows, decoded in tasks, and the number of ids before a file is a sum
over one row a file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.llm.codec import pack_file, unpack_file
from daybook.llm.common import arrow_strings, map_batches, partitions, release, table
from daybook.llm.packing import tokenizer_path
from daybook.llm.tokens import word_ids
from daybook.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
FILE_IDS = 6_000_000
SLICE = 500
SUFFIX = ".dayids"


def _store(folder: str, name: str, content: bytes) -> None:
    """Write a file of the shared folder under another name, then rename it."""
    from pyarrow import fs

    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    draft = f"{root}/_{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, f"{root}/{name}")


def write_token_files(
    docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Write all rows below ``folder`` and return (file, documents, ids, bytes) of each file.

    Rows stand in ascending order of id, null first; rows of one id follow each other. Null and
    empty texts are the end id alone. An empty table writes no file. Other columns are left out.
    """
    path = path or tokenizer_path(TOKENIZER)
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    order = F.col("doc_id").asc_nulls_first()
    # Rows of one id are told apart by their text, so that a hot id is no single partition.
    ordered = chosen.repartitionByRange(partitions(spark), order, F.xxhash64("text")).sortWithinPartitions(order, F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), np.array([end_id], dtype="<u4").tobytes()
        part, ids, held, size = TaskContext.get().partitionId() << 20, [], [], 0

        def out():
            name = f"ids-{part:016d}{SUFFIX}"
            content = pack_file(part, ids, [len(x) // 4 for x in held], np.frombuffer(b"".join(held), dtype="<u4"))
            _store(folder, name, content)
            return pa.RecordBatch.from_pydict({"file": [name], "documents": [len(ids)], "ids": [size], "bytes": [len(content)]})

        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                for i, x in zip(b.column(0).to_pylist(), words.encode(arrow_strings(b.column(1))), strict=True):
                    ids.append(i)
                    held.append(x + end)
                    size += len(held[-1]) // 4
                    if size >= FILE_IDS:
                        yield out()
                        part, ids, held, size = part + 1, [], [], 0
        if ids:
            yield out()

    return map_batches(ordered, run, "file string, documents bigint, ids bigint, bytes bigint", tokenises=True)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ``start`` counts the ids of all before it, ``ids`` are unsigned 32-bit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                part, ids, counts, tokens = unpack_file(b.column(0)[k].as_py())
                end = np.cumsum(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
                for lo in range(0, len(ids), SLICE):
                    some = slice(lo, lo + SLICE)
                    cut = zip((end[some] - np.array(counts[some], dtype=np.int64)).tolist(), end[some].tolist(), strict=True)
                    raw = [tokens[s:e].tobytes() for s, e in cut]
                    first = end[some] - np.array(counts[some], dtype=np.int64)
                    n = len(raw)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array(ids[some], pa.int64()), pa.array(first), pa.array(counts[some], pa.int64()), pa.array(raw, pa.binary())], ["part", "doc_id", "first", "n_tokens", "ids"])

    return map_batches(files, run, "part bigint, doc_id bigint, first bigint, n_tokens bigint, ids binary")


def document_digests(spark: SparkSession, folder: str, sizes: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; ``sizes`` has a row a file."""
    part = F.regexp_extract("file", r"ids-(\d+)", 1).cast("long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(part.alias("part"), "ids").select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    # The checksum is Spark's own, over the ids as they were read.
    docs = read_token_files(spark, folder).select("part", "doc_id", "first", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files written; see ``write_token_files``."""
    folder = scratch_path(spark, "token-files")
    written = write_token_files(table(spark, sf_dir, "documents"), folder)
    sizes = spark.createDataFrame(written.select("file", "ids").toArrow())  # a row a file
    release(spark)
    if sizes.isEmpty():
        return table(spark, sf_dir, "documents").select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("start", "n_tokens", "ids_crc32")])
    return document_digests(spark, folder, sizes)
