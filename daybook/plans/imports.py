"""Import jobs: files to curated tables, idempotent by file content and by row key.

A job hashes the files, drops those the ledger knows, parses the rest into a staging table,
appends the rows whose key is new, and records each file. Staging and loads are written
tables, so every later step reads what was written and nothing is parsed twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.fixed_values import HEADER_SCAN_LINES
from daybook.operators import chat
from daybook.operators.merge import collapse, insert_dedupe, new_files
from daybook.operators.statement import normalize_statement
from daybook.plans.warehouse import (
    WARNINGS_TABLE,
    append_ledger,
    append_load,
    append_warnings,
    read_ledger,
    read_table,
)
from daybook.schemas import BankProfile, CategoryRule, required
from daybook.sources import exports, files
from daybook.sources.chat_lines import chat_name, text_lines
from daybook.sources.statements import find_headers, profile_table, statement_cells, whole_rows

UNREADABLE = "unreadable file"
NO_DATE = "no date column recognized"
NO_MESSAGES = "no message lines recognized"
NO_PROFILE = "no profile matches the header"
# A file with one of these warnings gave nothing; it is not booked as imported.
NOT_IMPORTED = (UNREADABLE, NO_DATE, NO_MESSAGES, NO_PROFILE)

METRICS = (
    "source string, table string, rows_inserted bigint, rows_skipped bigint, "
    "files_imported bigint, files_skipped bigint, load string"
)


@dataclass(frozen=True)
class Job:
    """How the files of one export kind become rows of one table."""

    source: str
    table: str
    glob: str
    read: Callable[[SparkSession, str | list[str]], DataFrame]
    normalize: Callable[[DataFrame], DataFrame]
    order: tuple[str, ...] = ("path",)
    raw_table: str | None = None
    only: str = ""
    # Time column that rows of equal key agree on; None if keys are not bound to a time.
    within: str | None = "ts"
    # Raw rows to (path, warning) rows.
    warn: Callable[[DataFrame], DataFrame] | None = None


def warn_unreadable(raw: DataFrame) -> DataFrame:
    """Files that could not be read; they are not booked, so the next run tries them again."""
    if exports.CORRUPT not in raw.columns:
        return raw.select("path", F.lit("").alias("warning")).limit(0)
    return raw.filter(F.col(exports.CORRUPT).isNotNull()).select("path", F.lit(UNREADABLE).alias("warning")).distinct()


def warn_music(raw: DataFrame) -> DataFrame:
    text = F.concat(F.lit("skipped "), F.col("trackless").cast("string"), F.lit(" rows with no track name"))
    return exports.trackless_counts(raw).select("path", text.alias("warning")).unionByName(warn_unreadable(raw))


def warn_unknown_headers(raw: DataFrame) -> DataFrame:
    """One warning per file and header that no metric claims."""
    heads = raw.groupBy("path").agg(F.first("header").alias("header"))
    targets = heads.withColumn("_t", exports.header_targets(F.col("header")))
    unknown = F.filter(F.arrays_zip("header", F.col("_t").alias("t")), lambda x: x["t"] == "")
    texts = F.transform(unknown, lambda x: F.concat(F.lit("ignoring unknown column '"), x["header"], F.lit("'")))
    no_day = F.when(F.array_contains("_t", "day"), F.array().cast("array<string>")).otherwise(F.array(F.lit(NO_DATE)))
    return targets.select("path", F.explode(F.concat(texts, no_day)).alias("warning"))


def warn_chat(lines: DataFrame) -> DataFrame:
    bad = F.concat(F.col("unparseable").cast("string"), F.lit(" unparseable timestamps"))
    found = F.array_compact(
        F.array(
            F.when(F.col("unrecognized"), NO_MESSAGES),
            F.when(F.col("ambiguous_dates") & ~F.col("unrecognized"), "date order ambiguous; day first assumed"),
            F.when(F.col("unparseable") > 0, bad),
        )
    )
    return chat.chat_warnings(lines).select("path", F.explode(found).alias("warning"))


def warn_no_header(profiles: Sequence[BankProfile], scan_lines: int | None = HEADER_SCAN_LINES) -> Callable[[DataFrame], DataFrame]:
    """Statements none of the profiles fits in their first ``scan_lines`` rows."""

    def warn(lines: DataFrame) -> DataFrame:
        known = find_headers(whole_rows(lines), profile_table(lines, profiles), scan_lines=scan_lines)
        unknown = lines.select("path").distinct().join(known.select("path"), "path", "left_anti")
        return unknown.select("path", F.lit(NO_PROFILE).alias("warning"))

    return warn


def music_jobs() -> list[Job]:
    return [
        Job("spotify", "listens", files.MUSIC_ACCOUNT_GLOB, exports.read_account_listens,
            exports.normalize_account_listens, ("path", "ts", "track", "album"), "raw_listens_account", warn=warn_unreadable),
        Job("spotify", "listens", files.MUSIC_EXTENDED_GLOB, exports.read_extended_listens,
            exports.normalize_extended_listens, ("path", "ts", "album", "skipped"), "raw_listens_extended", warn=warn_music),
    ]


def takeout_jobs(tz: str) -> list[Job]:
    calendar_lines = lambda spark, root: text_lines(spark, root, files.CALENDAR_GLOB)
    return [
        Job("takeout", "searches", files.SEARCH_GLOB, exports.read_searches,
            exports.normalize_searches, ("path", "ts"), "raw_searches", files.path_pattern("Search history"),
            warn=warn_unreadable),
        Job("takeout", "youtube_watches", files.WATCH_GLOB, exports.read_watches,
            exports.normalize_watches, ("path", "ts", "channel"), "raw_watches", files.path_pattern("YouTube history"),
            warn=warn_unreadable),
        Job("takeout", "daily_metrics", files.DAILY_GLOB, exports.read_dailies,
            exports.normalize_dailies, ("path", "day", "row_no"), "raw_dailies", r"/Daily(?: |%20)activity(?: |%20)metrics/[^/]+$", within="day",
            warn=warn_unknown_headers),
        Job("takeout", "activities", "*.json", exports.read_sessions,
            lambda raw: exports.normalize_sessions(raw, tz), ("path", "ts_start"), "raw_sessions",
            "/All(?: |%20)Sessions/[^/]+$", within="ts_start",
            warn=warn_unreadable),
        Job("takeout", "calendar_events", files.CALENDAR_GLOB, calendar_lines,
            lambda raw: exports.normalize_calendar(exports.calendar_blocks(raw), tz), ("path", "event_no"), "raw_calendar",
            files.path_pattern("Calendar"), within=None),
    ]


def chat_job(me: str, tz: str) -> Job:
    return Job(
        "whatsapp", "messages", "*.txt", text_lines,
        lambda lines: chat.to_messages(chat.parse_chat(lines), chat_name(F.col("path")), me, tz),
        ("path", "message_no"), "raw_chat_lines", warn=warn_chat,
    )


def bank_job(
    profiles: Sequence[BankProfile], rules: Sequence[CategoryRule], tz: str,
    currency: str = "INR", account: str | None = None, scan_lines: int | None = HEADER_SCAN_LINES,
) -> Job:
    """Statements of the banks of ``profiles``; a header is looked for in the first ``scan_lines`` rows (None: in all)."""
    return Job(
        "bank", "transactions", "*.csv", lambda spark, root: text_lines(spark, root, "*.csv"),
        lambda lines: normalize_statement(
            statement_cells(lines, profiles, scan_lines=scan_lines), profiles, rules, tz, currency, account
        ),
        ("path", "block", "line_id", "pos"), "raw_statement_lines",
        warn=warn_no_header(profiles, scan_lines),
    )


def run_job(spark: SparkSession, job: Job, folder: str, warehouse: str, force: bool = False) -> DataFrame:
    """Run one job; returns one row of counts, with the name of the load."""
    found = files.fingerprint_files(spark, folder, job.glob)
    if job.only:
        found = found.filter(F.col("path").rlike(job.only))
    ledger = read_ledger(spark, warehouse)
    fresh = new_files(found, ledger, force)
    if not force:
        fresh = collapse(fresh, ["path"], "file_sha256")
    fresh = fresh.withColumn("_fresh", F.lit(True))
    # The load is named by what it reads, so a retry after a failure writes the same folders again.
    marked = found.join(fresh.select("path", "_fresh"), "path", "left")
    digest = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("path", "file_sha256"))), "|"), 256)
    name = marked.filter("_fresh").agg(F.count(F.lit(1)).alias("n"), digest.alias("d")).first()
    load = f"{job.raw_table}-{name['d'][:32]}" + (f"-{uuid.uuid4().hex[:8]}" if force else "")
    listing = f"{warehouse}/_runs/{load}/files"
    marked.write.mode("overwrite").parquet(listing)
    listed = spark.read.parquet(listing)
    todo = listed.filter("_fresh").select("path")

    # Raw rows are staged as they were read and parsed from there.
    raw_path = f"{warehouse}/{job.raw_table}/load={load}"
    # Names of the new files alone; Spark's own listing holds those of all files.
    names = [unquote(r["path"]) for r in todo.collect()]
    if not names:
        return _metrics(spark, job, load, listed, None, None)
    job.read(spark, names).write.mode("overwrite").parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    staged = job.normalize(raw)
    batch_path = f"{warehouse}/_runs/{load}/rows"
    staged.write.mode("overwrite").parquet(batch_path)
    everything = spark.read.parquet(batch_path)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required(job.table) if c in everything.columns])
    lacking = everything.filter(~whole).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("dropped "), F.col("n").cast("string"), F.lit(" rows without a required value"))
    noticed = lacking.select("path", text.alias("warning"))
    if job.warn:
        noticed = noticed.unionByName(job.warn(raw))
    append_warnings(noticed.withColumn("source", F.lit(job.source)), warehouse, load)
    warned = spark.read.parquet(f"{warehouse}/{WARNINGS_TABLE}/load={load}")
    batch = everything.filter(whole)
    target = read_table(spark, warehouse, job.table)
    written = append_load(insert_dedupe(batch, target, job.order, within=job.within), warehouse, job.table, load)

    per_file = written.groupBy(F.col("_path").alias("path")).agg(F.count(F.lit(1)).alias("rows_inserted"))
    lost = warned.filter(F.col("warning").isin(*NOT_IMPORTED)).select("path").distinct()
    entries = listed.filter("_fresh").join(lost, "path", "left_anti").join(per_file, "path", "left").select(
        "file_sha256",
        "path",
        F.lit(job.source).alias("source"),
        F.current_timestamp().alias("imported_at"),
        F.coalesce("rows_inserted", F.lit(0)).alias("rows_inserted"),
    )
    append_ledger(entries, warehouse)
    return _metrics(spark, job, load, listed, batch, written)


def _metrics(
    spark: SparkSession, job: Job, load: str, listed: DataFrame, batch: DataFrame | None, written: DataFrame | None
) -> DataFrame:
    total = batch.count() if batch is not None else 0
    inserted = written.count() if written is not None else 0
    n = listed.agg(F.count_if(F.col("_fresh")).alias("f"), F.count(F.lit(1)).alias("n")).first()
    row = (job.source, job.table, inserted, total - inserted, n["f"], n["n"] - n["f"], load)
    return spark.createDataFrame([row], METRICS)


def run_jobs(
    spark: SparkSession, jobs: Sequence[Job], folder: str, warehouse: str, force: bool = False
) -> DataFrame:
    """Run several jobs on one folder; the counts of each."""
    return reduce(
        DataFrame.unionByName, [run_job(spark, j, folder, warehouse, force) for j in jobs]
    )
