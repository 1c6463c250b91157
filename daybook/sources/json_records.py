"""The records of JSON files, found in splits of any size.

A file is read in pieces that end at a closing brace. Where a record ends depends on what came
before: inside a string a brace means nothing, inside a record it ends an inner object. Both
states compose along a file: a piece turns "inside a string" over if it has an odd number of
quotes, and adds its opening braces less one to the depth. So the state before a piece is a sum
over the pieces before it, which is taken per split first and then over splits. A
record without inner objects is one piece and stays where it was read; pieces of other records
are brought together by record. Line breaks play no part: an array on one line spreads over
all splits as well as one record a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.runs import running_sum

_FILE, _SPLIT, _ORDER = ["path"], ["block"], ["piece_id"]


def json_pieces(spark: SparkSession, root: str | list[str], glob: str) -> DataFrame:
    """(path, block, piece_id, size, value): pieces between closing braces, in order of (block, piece_id)."""
    scan = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "}").text(root)
    return scan.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("piece_id"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )


def placed_pieces(pieces: DataFrame) -> DataFrame:
    """Add ``opens``, ``depth`` before and ``after`` each piece, ``record`` (its number in the file) and ``head``,
    what stands before the first brace that opens a record."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # no escaped quotes
    counted = pieces.withColumn("_bare", bare).withColumn("_quotes", F.length("_bare") - F.length(F.replace("_bare", F.lit('"'))))
    placed = running_sum(counted, F.col("_quotes"), _FILE, _SPLIT, _ORDER, "_so_far")
    inside = (F.col("_so_far") - F.col("_quotes")) % 2 == 1
    code = F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), F.col("_bare"))
    placed = placed.withColumn("_code", F.regexp_replace(code, r'(?s)"[^"]*(?:"|$)', ""))
    placed = placed.withColumn("opens", F.length("_code") - F.length(F.replace("_code", F.lit("{"))))
    closes = F.when(F.col("_so_far") % 2 == 0, 1).otherwise(0)
    placed = running_sum(placed.withColumn("_net", F.col("opens") - closes), F.col("_net"), _FILE, _SPLIT, _ORDER, "after")
    placed = placed.withColumn("depth", F.col("after") - F.col("_net"))
    ends = (F.col("after") == 0) & (closes == 1)
    placed = running_sum(placed.withColumn("_ends", ends), F.col("_ends").cast("int"), _FILE, _SPLIT, _ORDER, "_ended")
    return placed.select(
        "path", "block", "piece_id", "size", "value", "opens", "depth", "after",
        (F.col("_ended") - F.col("_ends").cast("int")).alias("record"),
        (F.col("_so_far") % 2).alias("open_string"),
        F.regexp_extract("value", r"(?s)^([^{]*)\{", 1).alias("head"),
    )


def file_faults(placed: DataFrame) -> DataFrame:
    """(path, fault) of files that are not one record or one array of records, whole.

    The last piece is what follows the last brace; a file that ends in a brace has none. Whether
    it does is told by its size, less a byte order mark that the reader takes away.
    """
    at = F.struct("block", "piece_id")
    starts = (F.col("depth") == 0) & (F.col("opens") > 0)
    wrong = starts & ~F.when(F.col("record") == 0, F.col("head").rlike(r"^\s*\[?\s*$")).otherwise(F.col("head").rlike(r"^\s*,\s*$"))
    files = placed.groupBy("path").agg(
        F.max("size").alias("size"),
        F.sum(F.octet_length("value") + 1).alias("read"),
        F.min_by("value", at).alias("first"),
        F.max_by(F.struct("value", "opens", "depth", "open_string"), at).alias("last"),
        F.count_if(wrong).alias("wrong"),
        F.count_if(F.col("after") < 0).alias("below"),
    )
    array = F.col("first").rlike(r"^\s*\[")
    by = F.col("read") - F.col("size")
    braced = by.isin(0, -3)
    # After the last brace: nothing but the end of the array. That piece counts one brace too many.
    closed = (F.col("last.depth") == 0) & (F.col("last.opens") == 0) & (F.col("last.open_string") == 0)
    closed = closed & F.when(array, F.col("last.value").rlike(r"^\s*(?:\[\s*)?\]\s*$")).otherwise(F.trim(F.regexp_replace("last.value", r"\s", "")) == "")
    whole = F.when(braced, ~array & (F.col("below") == 0) & (F.col("last.depth") + F.col("last.opens") == 1)).otherwise(closed & (F.col("below") == 1))
    return files.filter(~(whole & (F.col("wrong") == 0))).select("path", F.lit("not a whole JSON file").alias("fault"))


def json_records(placed: DataFrame) -> DataFrame:
    """(path, record, text): each record's text."""
    one = (F.col("depth") == 0) & (F.col("after") == 0) & (F.col("opens") > 0)
    text = lambda c: F.concat(F.regexp_replace(c, r"(?s)^[^{]*\{", "{"), F.lit("}"))
    flat = placed.filter(one).select("path", "record", text("value").alias("text"))
    parts = placed.filter(~one & ((F.col("depth") > 0) | (F.col("opens") > 0)))
    sorted_parts = F.sort_array(F.collect_list(F.struct("block", "piece_id", "value")))
    nested = parts.groupBy("path", "record").agg(F.transform(sorted_parts, lambda p: p["value"]).alias("_parts"))
    return flat.unionByName(nested.select("path", "record", text(F.array_join("_parts", "}")).alias("text")))
