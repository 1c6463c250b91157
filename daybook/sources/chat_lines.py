"""Chat export lines: the line format and an ordered line scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.text import BLANK

# Line breaks inside a text; a text scan splits on \n, \r\n and \r only.
LINE_BREAKS = r"[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"

# One message line of either style: "12/03/24, 9:14 pm - A: hi" or "[12/03/24, 9:14:33 PM] A: hi".
# Groups: bracket, date parts 1-3, hour, minute, second, am/pm letter, closing, rest.
CHAT_LINE = (
    rf"^(\[?)(\d{{1,2}})/(\d{{1,2}})/(\d{{2,4}}),{BLANK}"
    rf"(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?(?:{BLANK}?([apAP])[mM])?"
    rf"(\]|{BLANK}-){BLANK}(.*)$"
)


def is_chat_line(line: Column) -> Column:
    """Is this a message line: a bracket on both ends, or a dash and no bracket?"""
    bracketed = line.startswith("[")
    closing = F.regexp_extract(line, CHAT_LINE, 9)
    return (bracketed & (closing == "]")) | (~bracketed & closing.endswith("-"))


def text_lines(spark: SparkSession, root: str | list[str], glob: str = "*.txt") -> DataFrame:
    """Lines of text files with an order that survives file splits.

    A line is placed by (path, block, line_id, pos): ``block`` is the byte offset of the file
    split it came from, ``line_id`` grows within a split, and ``pos`` counts the pieces of
    one scanned line. No file has to fit into one task.
    """
    scan = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line_id"),
            "value",
        )
    )
    return scan.select(
        "path", "block", "line_id", F.posexplode(F.split("value", LINE_BREAKS)).alias("pos", "line")
    )


def chat_name(path: Column) -> Column:
    """``WhatsApp Chat with Tove.txt`` -> ``Tove``; ``Allotment_chat.txt`` -> ``Allotment``."""
    file_name = F.url_decode(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\+", "%2B"))
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    name = F.regexp_replace(stem, "(?i)^whatsapp chat with ", "")
    name = F.trim(F.regexp_replace(name, "_chat$", ""))
    return F.when(name == "", stem).otherwise(name)
