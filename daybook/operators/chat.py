"""Chat export lines to messages.

A message starts at a line of the export's own style and runs over the lines after it. Lines
are numbered per *chunk* of a file (a file split), never per file: each chunk counts its own
message starts, and a small chunk table carries the counts of the earlier chunks. So a single
huge export spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.fixed_values import ATTACHMENT_PREFIX, MEDIA_MARKERS
from daybook.functions.dates import local_to_instant
from daybook.functions.keys import with_message_key
from daybook.functions.text import BLANK, clean_line, word_count
from daybook.sources.chat_lines import CHAT_LINE

_CUT = "\u0001"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def _read_line(lines: DataFrame) -> DataFrame:
    """Add the fields of a message line; ``style`` is NULL on any other line."""
    groups = _CUT.join(f"${i}" for i in range(1, 11))
    part = lambda i: F.get("_p", F.lit(i))
    number = lambda i: part(i).try_cast("int")
    year = number(3)
    full_year = (
        F.when(year >= 100, year).when(year >= 69, year + 1900).otherwise(year + 2000)
    )
    half = F.lower(part(7))
    hour = (
        F.when(half == "", number(4))
        .when(number(4) > 12, F.lit(None).cast("int"))
        .when(half == "p", number(4) % 12 + 12)
        .otherwise(number(4) % 12)
    )
    second = F.coalesce(number(6), F.lit(0))

    def stamp(day: Column, month: Column) -> Column:
        return F.try_make_timestamp_ntz(full_year, month, day, hour, number(5), second)

    day_first, month_first = stamp(number(1), number(2)), stamp(number(2), number(1))
    rest = part(9)
    sender = F.substring_index(rest, ": ", 1)
    return (
        lines.withColumn("line", clean_line(F.col("line")))
        .withColumn("_p", F.split(F.regexp_replace("line", CHAT_LINE, groups), _CUT, 10))
        .withColumn(
            "_ok", (F.size("_p") == 10) & ((part(0) == "[") == (part(8) == "]"))
        )
        .withColumn("style", F.when(F.col("_ok"), F.when(part(0) == "[", "ios").otherwise("android")))
        .withColumn("_a", F.when(F.col("_ok"), number(1)))
        .withColumn("_b", F.when(F.col("_ok"), number(2)))
        .withColumn("_ts_dm", F.when(F.col("_ok"), F.coalesce(day_first, month_first)))
        .withColumn("_ts_md", F.when(F.col("_ok"), F.coalesce(month_first, day_first)))
        .withColumn("_has_body", F.col("_ok") & rest.contains(": "))
        .withColumn("sender", F.when(F.col("_has_body"), _strip(sender)))
        .withColumn("body", F.when(F.col("_has_body"), F.expr("substring(_p[9], length(substring_index(_p[9], ': ', 1)) + 3)")))
        .withColumn("_kept", F.col("_has_body") & F.col("_ts_dm").isNotNull())
        .drop("_p", "_ok")
    )


def _decides(a: Column, b: Column) -> Column:
    """True/False where a line settles the day/month order, NULL where it does not."""
    return F.when(a > 12, F.lit(True)).when(b > 12, F.lit(False))


def detect_date_order(
    lines: DataFrame, file: Sequence[str] = ("path",), order: Sequence[str] = ("block", "line_id", "pos")
) -> DataFrame:
    """Per file: day before month? The first line with a part above 12 decides."""
    parsed = _read_line(lines)
    at = F.struct(*order)
    flag = _decides(F.col("_a"), F.col("_b"))
    return (
        parsed.groupBy(*file)
        .agg(F.min(F.when(flag.isNotNull(), F.struct(at.alias("at"), flag.alias("flag")))).alias("_d"))
        .select(
            *file,
            F.coalesce(F.col("_d.flag"), F.lit(True)).alias("dayfirst"),
            F.col("_d").isNull().alias("ambiguous"),
        )
    )


def _chunk_table(
    parsed: DataFrame, file: Sequence[str], chunk: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """One row per chunk: the file's style and date order, and the starts before the chunk."""
    at = F.struct(*chunk, *order)
    flag = _decides(F.col("_a"), F.col("_b"))
    per_chunk = parsed.groupBy(*file, *chunk).agg(
        F.min(F.when(F.col("style").isNotNull(), F.struct(at.alias("at"), "style"))).alias("_s"),
        F.min(F.when(flag.isNotNull(), F.struct(at.alias("at"), flag.alias("flag")))).alias("_d"),
        F.count_if(F.col("_kept") & (F.col("style") == "android")).alias("_n_android"),
        F.count_if(F.col("_kept") & (F.col("style") == "ios")).alias("_n_ios"),
    )
    whole = Window.partitionBy(*file)
    before = whole.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_chunk.withColumn("locked", F.min("_s").over(whole)["style"])
        .withColumn("dayfirst", F.coalesce(F.min("_d").over(whole)["flag"], F.lit(True)))
        .withColumn("_n", F.when(F.col("locked") == "ios", F.col("_n_ios")).otherwise(F.col("_n_android")))
        .withColumn("before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*file, *chunk, "locked", "dayfirst", "before")
    )


def parse_chat(
    lines: DataFrame,
    file: Sequence[str] = ("path",),
    chunk: Sequence[str] = ("block",),
    order: Sequence[str] = ("line_id", "pos"),
) -> DataFrame:
    """Messages of each export: (file..., message_no, wall_ts, sender, text, is_media).

    System lines and lines whose date does not exist start no message and join none.
    """
    file, chunk, order = list(file), list(chunk), list(order)
    parsed = _read_line(lines)
    chunks = _chunk_table(parsed, file, chunk, order)
    in_chunk = (
        Window.partitionBy(*file, *chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    styled = F.coalesce(F.col("style") == F.col("locked"), F.lit(False))
    media = F.lower(_strip(F.col("body")))
    numbered = (
        parsed.join(chunks, [*file, *chunk])
        .withColumn("_start", styled & F.col("_kept"))
        .withColumn("message_no", F.col("before") + F.sum(F.col("_start").cast("int")).over(in_chunk))
        .filter(F.col("_start") | (~styled & F.col("line").rlike(BLANK.replace("[", "[^", 1))))
        .filter("message_no > 0")
        .withColumn("_wall", F.when(F.col("dayfirst"), F.col("_ts_dm")).otherwise(F.col("_ts_md")))
        .withColumn("_media", media.isin(MEDIA_MARKERS) | media.startswith(ATTACHMENT_PREFIX))
    )
    head = F.max(F.when(F.col("_start"), F.struct(F.col("_wall"), "sender", "body", "_media")))
    tail = F.collect_list(F.when(~F.col("_start"), F.struct(*chunk, *order, "line")))
    text = F.when(~F.col("h._media"), F.col("h.body"))
    more = F.array_join(F.transform(F.sort_array("t"), lambda x: x["line"]), "\n")
    return (
        numbered.groupBy(*file, "message_no")
        .agg(head.alias("h"), tail.alias("t"))
        .select(
            *file,
            "message_no",
            F.col("h._wall").alias("wall_ts"),
            F.col("h.sender").alias("sender"),
            F.when(F.size("t") > 0, F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), more))
            .otherwise(text)
            .alias("text"),
            F.col("h._media").alias("is_media"),
        )
    )


def chat_warnings(lines: DataFrame, file: Sequence[str] = ("path",)) -> DataFrame:
    """Per file: is the date order ambiguous, was no message recognised, how many bad dates."""
    flag = _decides(F.col("_a"), F.col("_b"))
    bad = F.col("_has_body") & F.col("_ts_dm").isNull()
    return _read_line(lines).groupBy(*file).agg(
        (F.count(flag) == 0).alias("ambiguous_dates"),
        (F.count("style") == 0).alias("unrecognized"),
        F.count_if(bad).alias("unparseable"),
    )


def to_messages(parsed: DataFrame, chat: Column, me: str, tz: str) -> DataFrame:
    """Curated messages: instant, ownership by name, word count and key."""
    rows = parsed.select(
        local_to_instant(F.col("wall_ts"), tz).alias("ts"),
        chat.alias("chat"),
        "sender",
        is_me(F.col("sender"), me).alias("is_me"),
        "text",
        "is_media",
        word_count(F.col("text")).alias("word_count"),
        F.lit("whatsapp").alias("source"),
        *[c for c in ("path", "message_no") if c in parsed.columns],
    )
    return with_message_key(rows)


def is_me(sender: Column, me: str) -> Column:
    return F.lower(F.trim(sender)) == me.strip().lower()
