"""Finding, fingerprinting and routing export files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.text import clean_line
from daybook.sources.chat_lines import LINE_BREAKS, is_chat_line

# Glob per kind of export.
MUSIC_ACCOUNT_GLOB = "StreamingHistory*.json"
MUSIC_EXTENDED_GLOB = "Streaming_History_Audio_*.json"
SEARCH_GLOB = "MyActivity.json"
WATCH_GLOB = "watch-history.json"
DAILY_GLOB = "Daily activity metrics.csv"
CALENDAR_GLOB = "*.ics"

# Product of a takeout tree -> regex of the paths that belong to it.
TAKEOUT_PRODUCTS = {
    "Search history": r"/My Activity/Search/MyActivity\.json$",
    "YouTube history": r"/YouTube and YouTube Music/history/watch-history\.json$",
    "Google Fit": r"/Fit/(?:Daily activity metrics/Daily activity metrics\.csv|All Sessions/[^/]+\.json)$",
    "Calendar": r"/Calendar/[^/]+\.ics$",
}


def path_pattern(product: str) -> str:
    """The paths of a takeout product, as readers write them: a space may be ``%20``."""
    return TAKEOUT_PRODUCTS[product].replace(" ", "(?: |%20)")


def find_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Files below ``root`` (or the file itself) with their metadata, contents left unread."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        "length",
        F.col("modificationTime").alias("modified_at"),
    )


def fingerprint_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(file_sha256, path, file_name) of every file, hashed inside the scan.

    ``path`` is written as the readers of this package write it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).select(F.col("_metadata.file_path").alias("file"), "content")
    return fingerprint(files, "content").select(
        "file_sha256", F.col("file").alias("path"), F.element_at(F.split("file", "/"), -1).alias("file_name")
    )


def fingerprint(df: DataFrame, content: str) -> DataFrame:
    """Add ``file_sha256`` of a content column."""
    return df.withColumn("file_sha256", F.sha2(F.col(content), 256))


def first_line(head: Column) -> Column:
    """First line of a text that is not blank, cleaned of invisible marks."""
    inner = LINE_BREAKS[1:-1]
    line = F.regexp_extract(
        F.coalesce(head, F.lit("")), rf"(?:^|[{inner}])([^{inner}]*[^\s{inner}][^{inner}]*)", 1
    )
    return clean_line(line)


def matching_sources(path: Column, head: Column) -> Column:
    """Array of every source that recognises a file by its path or its first line."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    is_music = name.rlike(r"^(?:StreamingHistory.*|Streaming_History_Audio_.*)\.json$")
    is_takeout = path.rlike(r"(?:^|/)Takeout/") | F.lower(name).rlike(r"^takeout-.*\.zip$")
    is_chat = F.lower(name).endswith(".txt") & (
        name.startswith("WhatsApp Chat with ")
        | stem.endswith("_chat")
        | is_chat_line(first_line(head))
    )
    is_bank = F.lower(name).rlike(r"\.(?:csv|xls|xlsx)$")
    return F.array_compact(
        F.array(
            F.when(is_music, "spotify"),
            F.when(is_chat, "whatsapp"),
            F.when(is_takeout, "takeout"),
            F.when(is_bank, "bank"),
        )
    )


def route_files(files: DataFrame, path: str = "path", head: str = "head") -> DataFrame:
    """Add the source of each file and a status: ``ok``, ``none`` or ``ambiguous``.

    Bank statements are the catch-all and give way to any other match.
    """
    matches = matching_sources(F.col(path), F.col(head))
    return (
        files.withColumn("_all", matches)
        .withColumn(
            "_m",
            F.when(F.size("_all") > 1, F.array_remove("_all", "bank")).otherwise(F.col("_all")),
        )
        .withColumn("candidates", F.array_join("_m", "|"))
        .withColumn(
            "status",
            F.when(F.size("_m") == 0, "none").when(F.size("_m") == 1, "ok").otherwise("ambiguous"),
        )
        .withColumn("source", F.when(F.size("_m") == 1, F.get("_m", F.lit(0))))
        .drop("_all", "_m")
    )


def missing_products(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per expected takeout product: how many files there are, and if it is missing."""
    spark = files.sparkSession
    product = F.lit(None).cast("string")
    for label, regex in TAKEOUT_PRODUCTS.items():
        product = F.when(F.col(path).rlike(regex), label).otherwise(product)
    found = files.groupBy(product.alias("product")).agg(F.count(F.lit(1)).alias("files"))
    expected = spark.createDataFrame([(p,) for p in TAKEOUT_PRODUCTS], "product string")
    return expected.join(found, "product", "left").select(
        "product",
        F.coalesce("files", F.lit(0)).cast("bigint").alias("files"),
        F.col("files").isNull().alias("missing"),
    )
