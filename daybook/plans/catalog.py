"""Every registered query: name -> function of (session, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daybook.functions import amounts, dates, keys, text
from daybook.operators import chat, enrich, merge, profiling, ranking, rules, spine, statement
from daybook.operators.columns import computed_once
from daybook.plans import analytics, recommend
from daybook.schemas import VOCABULARY_COLUMNS
from daybook.session import materialize, scratch_path
from daybook.sources import exports, files, statements
from daybook.sources import tables as t
from daybook.streaming import loads, weeks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF, SINCE = "1998-12-31", "1997-01-01"
LISTEN_AS_OF = "2024-02-10"
FLAG_TYPES = ["signup"]
HISTORY_END = "1998-01-01"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def zoneless(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich.enrich(t.transactions(spark, d), t.RULES)


def day_facts(spark: SparkSession, d: str) -> list[tuple[DataFrame, str]]:
    """The three facts that set the start of the spine, reduced to their time column."""
    return [
        (t.table(spark, d, "lineitem"), "l_shipdate"),
        (t.table(spark, d, "events"), "ts"),
        (t.messages(spark, d), "ts"),
    ]


def days(spark: SparkSession, d: str, as_of: str = AS_OF) -> DataFrame:
    return spine.day_spine(day_facts(spark, d), as_of)


def flagged_weeks(spark: SparkSession, d: str) -> DataFrame:
    return spine.flag_weeks(spine.week_spine(days(spark, d)), t.activities(spark, d), FLAG_TYPES)


# ---- spine and named questions ----


@query
def spend_in_skipped_weeks(spark, d):
    return analytics.spend_in_unflagged_weeks(
        enriched(spark, d), flagged_weeks(spark, d), "bolt", AS_OF, SINCE
    )


@query
def top_artists_by_hours(spark, d):
    return analytics.top_artists(t.listens(spark, d), LISTEN_AS_OF)


@query
def days_without_messages(spark, d):
    return analytics.days_without_my_messages(days(spark, d), t.messages(spark, d), AS_OF, SINCE)


@query
def spine_days(spark, d):
    return days(spark, d)


@query
def weeks_flag(spark, d):
    return flagged_weeks(spark, d)


@query
def weeks_flag_summary(spark, d):
    return flagged_weeks(spark, d).agg(
        F.bool_or("went_to_gym").alias("any_flagged"),
        F.bool_and("went_to_gym").alias("all_flagged"),
        F.count_if("went_to_gym").alias("flagged"),
        F.count(F.lit(1)).alias("weeks"),
    )


@query
def weekly_spend(spark, d):
    return analytics.weekly_spend(t.transactions(spark, d)).withColumn(
        "spend", F.col("spend").cast("decimal(18,2)")
    )


@query
def spend_by_week_inner(spark, d):
    return analytics.spend_by_week(flagged_weeks(spark, d), t.transactions(spark, d)).withColumn(
        "spend", F.col("spend").cast("decimal(18,2)")
    )


@query
def user_weeks_flag(spark, d):
    users = t.table(spark, d, "events").select("user_id").distinct()
    activities = t.activities(spark, d)
    weeks = spine.calendar_weeks(users, *spine.first_and_last(activities, "ts_start"))
    return spine.flag_weeks(weeks, activities, FLAG_TYPES, ["user_id"])


@query
def user_days_without_event(spark, d):
    return spine.gap_days(t.table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("day")), ["user_id"])


@query
def user_gap_intervals(spark, d):
    return spine.gap_intervals(t.table(spark, d, "events"), ["user_id"], "ts").filter("days > 1")


@query
def user_spine_days(spark, d):
    events = t.table(spark, d, "events").select("user_id", "ts")
    return spine.day_spine([(events, "ts")], spine.first_and_last(events, "ts")[1], ["user_id"], lookback_days=0)


@query
def sql_over_views(spark, d):
    return analytics.run_sql(
        spark,
        {"transactions": enriched(spark, d), "listens": t.listens(spark, d)},
        """
        SELECT category, account, count(*) AS n, CAST(sum(-amount) AS DECIMAL(18,2)) AS spend
        FROM transactions WHERE amount < 0 GROUP BY category, account HAVING count(*) > 10
        """,
    )


# ---- profiles ----


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "transactions": t.transactions(spark, d),
        "messages": t.messages(spark, d),
        "listens": t.listens(spark, d),
        "activities": t.activities(spark, d),
    }


@query
def table_status(spark, d):
    return analytics.status_report(_tables(spark, d), t.document_files(spark, d))


@query
def categorical_vocabulary(spark, d):
    tables = {"transactions": enriched(spark, d), "activities": t.activities(spark, d)}
    return profiling.vocabulary(tables, VOCABULARY_COLUMNS)


@query
def categorized_counts(spark, d):
    return profiling.category_counts(enriched(spark, d))


@query
def numeric_summary(spark, d):
    report = analytics.spend_by_week(flagged_weeks(spark, d), t.transactions(spark, d))
    return profiling.numeric_summary(report).withColumns(
        {"total": F.round("total", 2), "average": F.round("average", 4)}
    )


@query
def capped_result(spark, d):
    rows = t.transactions(spark, d).select("ts", "amount", "narration")
    return profiling.capped(rows, order=("ts", "amount", "narration"))


@query
def import_summary(spark, d):
    tx = t.transactions(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    heard = t.listens(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    found = exports.normalize_searches(t.raw_searches(spark, d))
    seen = exports.normalize_watches(t.raw_watches(spark, d))
    return profiling.merge_metrics(
        [
            profiling.load_metrics("bank", "transactions", tx, tx.filter(F.col("ts") < F.lit(HISTORY_END).cast("timestamp")), "ts"),
            profiling.load_metrics("spotify", "listens", heard, heard.filter(F.col("ts") < F.lit("2024-01-10").cast("timestamp")), "ts"),
            profiling.load_metrics("takeout", "searches", found, found.limit(0), "ts"),
            profiling.load_metrics("takeout", "youtube_watches", seen, seen.limit(0), "ts"),
        ]
    )


@query
def load_stats(spark, d):
    tx = t.transactions(spark, d)
    return profiling.load_metrics("bank", "transactions", tx, tx.filter(F.col("ts") < F.to_date(F.lit(HISTORY_END))), "ts")


# ---- loads ----

ROW_ORDER = ("ts", "amount", "narration")


@query
def insert_dedupe(spark, d):
    batch = t.transactions(spark, d)
    target = batch.filter(F.col("ts") < F.to_date(F.lit(HISTORY_END)))
    return merge.insert_dedupe(batch, target, ROW_ORDER)


@query
def insert_dedupe_stats(spark, d):
    batch = t.transactions(spark, d)
    target = batch.filter(F.col("ts") < F.to_date(F.lit(HISTORY_END)))
    return merge.insert_counts(batch, target)


@query
def upsert_latest(spark, d):
    batch = t.transactions(spark, d)
    target = merge.collapse(batch.filter(F.col("ts") < F.to_date(F.lit(HISTORY_END))), ROW_ORDER)
    fresh = batch.filter(F.col("ts") >= F.to_date(F.lit(HISTORY_END)))
    return merge.upsert_latest(fresh, target, ROW_ORDER)


@query
def raw_append_by_name(spark, d):
    events = t.table(spark, d, "events")
    account = events.select("event_id", "ts", F.col("event_type").alias("track"))
    extended = events.select("ts", "event_id", (F.col("value") < 10).alias("skipped"), F.col("props").alias("album"))
    return merge.append_by_name(account, extended)


def _ledger_entries(spark: SparkSession, d: str, first: str) -> DataFrame:
    at = F.lit(first).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))
    return t.document_files(spark, d).select(
        "file_sha256",
        "path",
        F.col("lang").alias("source"),
        at.alias("imported_at"),
        F.col("n_chars").alias("rows_inserted"),
        "doc_id",
    )


@query
def ledger_new_files(spark, d):
    labelled = t.table(spark, d, "labels").select("doc_id").distinct()
    ledger = t.document_files(spark, d).join(labelled, "doc_id", "left_semi")
    return merge.new_files(t.document_files(spark, d).select("file_sha256", "path"), ledger)


@query
def ledger_upsert(spark, d):
    labelled = t.table(spark, d, "labels").select("doc_id").distinct()
    ledger = _ledger_entries(spark, d, "2024-01-01").join(labelled, "doc_id", "left_semi").drop("doc_id")
    return merge.upsert_ledger(ledger, _ledger_entries(spark, d, "2034-01-01").drop("doc_id"))


@query
def content_fingerprint(spark, d):
    docs = t.table(spark, d, "documents")
    return files.fingerprint(docs.withColumn("content", F.col("text").cast("binary")), "content").select("doc_id", "file_sha256")


@query
def manual_log_append(spark, d):
    events = t.table(spark, d, "events")
    spoken = F.when(F.col("event_type") == "signup", "Gym").when(F.col("event_type") == "view", "Evening walk at home").otherwise(F.col("event_type"))
    log = events.select(spoken.alias("activity"), F.col("ts").cast("date").alias("day"), F.col("value").alias("minutes"))
    done = log.filter(F.col("day") < F.to_date(F.lit("2024-01-10"))).select("day", merge.activity_label(F.col("activity")).alias("activity_type"))
    target = keys.with_manual_key(done, F.col("day"))
    rows = merge.manual_activities(log, target)
    return zoneless(rows.select("ts_start", "activity_type", "duration_min", "source", "dedupe_key"), "ts_start")


@query
def missing_products(spark, d):
    return files.missing_products(t.routed_files(spark, d))


@query
def file_routing(spark, d):
    return files.route_files(t.routed_files(spark, d)).select("page_id", "path", "candidates", "status", "source")


@query
def listens_union_flavours(spark, d):
    account = exports.normalize_account_listens(t.raw_account_listens(spark, d))
    extended = exports.normalize_extended_listens(t.raw_extended_listens(spark, d))
    return zoneless(merge.append_by_name(account, extended), "ts")


# ---- sources ----


@query
def listens_account_load(spark, d):
    return zoneless(exports.normalize_account_listens(t.raw_account_listens(spark, d)), "ts")


@query
def listens_extended_load(spark, d):
    return zoneless(exports.normalize_extended_listens(t.raw_extended_listens(spark, d)), "ts")


@query
def search_history_load(spark, d):
    return zoneless(exports.normalize_searches(t.raw_searches(spark, d)), "ts")


@query
def watch_history_load(spark, d):
    return zoneless(exports.normalize_watches(t.raw_watches(spark, d)), "ts")


@query
def session_normalize(spark, d):
    rows = exports.normalize_sessions(t.raw_sessions(spark, d)).drop("steps")
    return zoneless(rows, "ts_start", "ts_end").withColumn("duration_min", F.round("duration_min", 6))


@query
def fuzzy_header_project(spark, d):
    return exports.normalize_dailies(t.raw_dailies(spark, d))


@query
def calendar_normalize(spark, d):
    blocks = exports.calendar_blocks(t.calendar_lines(spark, d))
    return zoneless(exports.normalize_calendar(blocks).drop("event_no", "ts_end"), "ts_start")


@query
def header_signature_match(spark, d):
    lines = t.statement_lines(spark, d)
    return statements.find_headers(lines, statements.profile_table(lines, t.PROFILES)).select("path", "profile", "header_row")


@query
def statement_file_load(spark, d):
    lines = materialize(t.statement_lines(spark, d), "statement-lines")  # read several times, as staged raw rows are
    cells = statements.statement_cells(lines, t.PROFILES)
    rows = statement.normalize_statement(cells, t.PROFILES, t.RULES)
    return zoneless(rows.select("path", "ts", "amount", "narration", "merchant", "category", "account", "dedupe_key"), "ts")


@query
def statement_normalize(spark, d):
    rows = statement.normalize_statement(t.statement_rows(spark, d), t.PROFILES, t.RULES)
    return zoneless(rows.drop("currency", "source"), "ts")


@query
def amount_normalize(spark, d):
    rows = t.statement_rows(spark, d)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        amounts.parse_amount(F.col("amount_text")).alias("single"),
        amounts.debit_credit(F.col("debit_text"), F.col("credit_text")).alias("pair"),
        amounts.parse_amount(F.concat(F.col("debit_text"), F.lit(" Dr."))).alias("dotted"),
        amounts.parse_amount(F.concat(F.col("debit_text"), F.lit(" Dr.")), strict=True).alias("strict"),
    )


# ---- chat ----


@query
def chat_parse(spark, d):
    return chat.parse_chat(t.chat_lines(spark, d)).select(F.col("path").alias("chat"), "message_no", F.col("wall_ts").alias("ts"), "sender", "text", "is_media")


@query
def chat_warnings(spark, d):
    return chat.chat_warnings(t.chat_lines(spark, d))


@query
def date_order_detect(spark, d):
    return chat.detect_date_order(t.dated_lines(spark, d), ["path"], ["line_id"])


@query
def message_enrich(spark, d):
    rows = t.messages(spark, d).withColumn("sender", F.concat(F.lit(" "), F.initcap("sender")))
    mine = rows.withColumn("is_me", chat.is_me(F.col("sender"), "User ")).withColumn("word_count", text.word_count(F.col("text")))
    return keys.with_message_key(mine)


# ---- enrichment ----


@query
def merchant_extract(spark, d):
    return t.transactions(spark, d).select("dedupe_key", "narration", enrich.merchant(F.col("narration")).alias("merchant"))


@query
def categorize(spark, d):
    return enriched(spark, d).select("dedupe_key", "ts", "amount", "merchant", "category")


def _product_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule table out of the parts: one rule per second word and per whole name."""
    names = t.table(spark, d, "part").groupBy("p_name").agg(F.min("p_brand").alias("category"), F.min("p_partkey").alias("first"))
    whole = names.select(F.col("first").alias("rule_no"), F.concat("p_name", F.lit("|"), F.reverse("p_name")).alias("match"), "category")
    words = (
        names.groupBy(F.element_at(F.split("p_name", " "), 2).alias("match"))
        .agg(F.max("first").alias("rule_no"), F.max("category").alias("category"))
        .select("rule_no", "match", "category")
    )
    return whole.unionByName(words.withColumn("rule_no", F.col("rule_no") + 1000000))


@query
def categorize_rule_table(spark, d):
    rows = enrich.enrich(t.transactions(spark, d), enrich.listed_rules(_product_rules(spark, d)))
    return rows.select("dedupe_key", "ts", "amount", "merchant", "category")


@query
def categorize_rule_join(spark, d):
    rows = enrich.enrich_by_table(t.transactions(spark, d), _product_rules(spark, d))
    return rows.select("dedupe_key", "ts", "amount", "merchant", "category")


@query
def recategorize(spark, d):
    stored = computed_once(enrich.enrich(t.transactions(spark, d), t.OLD_RULES))
    return enrich.recategorize(stored, t.RULES).drop("currency", "source")


@query
def recategorize_delta(spark, d):
    stored = computed_once(enrich.enrich(t.transactions(spark, d), t.OLD_RULES))
    return enrich.recategorize_delta(stored, t.RULES).drop("currency", "source")


@query
def natural_keys(spark, d):
    rows = t.table(spark, d, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("timestamp").alias("ts_start"),
        F.col("event_type").alias("track"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("artist"),
        t.played_ms().alias("ms_played"),
        F.col("props").alias("query"),
        F.col("props").alias("title"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("activity_type"),
        F.col("ts").cast("date").alias("day"),
        F.col("event_type").alias("chat"),
        F.col("event_type").alias("sender"),
        F.when(F.col("event_type") != "click", F.col("props")).alias("text"),
        F.when(F.col("event_type") != "view", F.col("event_id").cast("string")).alias("uid"),
        F.lit("acc").alias("account"),
        F.col("value").cast("decimal(12,2)").alias("amount"),
        F.col("event_type").alias("narration"),
    )
    makers = {
        "listen_key": keys.with_listen_key,
        "search_key": keys.with_search_key,
        "watch_key": keys.with_watch_key,
        "message_key": keys.with_message_key,
        "session_key": keys.with_session_key,
        "daily_key": keys.with_daily_key,
        "event_key": keys.with_event_key,
        "transaction_key": lambda df: keys.with_transaction_key(df, "Asia/Kolkata"),
        "manual_key": lambda df: keys.with_manual_key(df, F.col("day")),
    }
    for name, make in makers.items():
        rows = make(rows).withColumnRenamed("dedupe_key", name)
    return rows.select("event_id", *makers)


# ---- scalar functions ----


@query
def scalar_dates(spark, d):
    ts = F.col("o_orderdate")
    instant = ts.cast("timestamp")
    return t.table(spark, d, "orders").select(
        "o_orderkey",
        dates.week_start(ts).alias("week_start"),
        dates.month_start(ts).alias("month_start"),
        F.trunc(ts, "year").alias("year_start"),
        dates.utc_text(instant).alias("utc_text"),
        dates.local_day(instant + F.expr("interval 20 hours"), "Asia/Kolkata").alias("local_day"),
        dates.local_to_instant(ts.cast("date"), "Asia/Kolkata").cast("timestamp_ntz").alias("local_midnight"),
        dates.parse_date(F.date_format(ts, "d/M/yyyy")).alias("parsed_dmy"),
        dates.parse_date(F.date_format(ts, "dd-MMM-yyyy")).alias("parsed_mon"),
        dates.parse_date(F.date_format(ts, "MM/dd/yy"), ["%m/%d/%y"]).alias("parsed_own"),
        dates.parse_date(F.col("o_orderpriority")).alias("parsed_bad"),
        F.size(F.sequence(dates.week_start(ts), ts.cast("date"))).alias("weekday_no"),
        F.date_sub(ts.cast("date"), 365).alias("year_back"),
    )


@query
def scalar_regex(spark, d):
    name = F.col("p_name")
    return t.table(spark, d, "part").select(
        "p_partkey",
        F.regexp_extract(name, "^([a-z]+) (b[a-z]+)$", 2).alias("second"),
        name.rlike("bolt|rod").alias("is_hardware"),
        F.regexp_replace("p_brand", "[^0-9]", "").alias("brand_no"),
        F.nullif(F.upper(F.trim(F.regexp_extract(name, "^([a-h]+) ", 1))), F.lit("")).alias("first"),
        F.coalesce(F.nullif(F.regexp_extract(name, "(ring|gear)", 1), F.lit("")), F.lower("p_type")).alias("label"),
        name.ilike("%RoD%").alias("ilike_rod"),
        name.startswith("red").alias("starts_red"),
    )


@query
def scalar_keys(spark, d):
    return t.table(spark, d, "orders").select(
        "o_orderkey",
        keys.row_key("a", F.col("o_custkey"), F.nullif("o_orderstatus", F.lit("P")), F.col("o_orderpriority")).alias("row_key"),
        F.sha2(F.concat_ws("|", F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority"), 256).alias("skipping_key"),
    )


@query
def scalar_numeric(spark, d):
    value = F.col("value")
    return t.table(spark, d, "events").select(
        "event_id",
        text.safe_int(value.cast("string")).alias("safe_int"),
        text.safe_int(F.col("event_type")).alias("bad_int"),
        F.col("props").try_cast("double").alias("bad_double"),
        value.cast("string").try_cast("decimal(12,2)").alias("money"),
        F.abs(-value).alias("magnitude"),
        F.round(value, 1).alias("rounded"),
        F.least(F.when(value > 50, value), F.lit(100.0)).alias("least_known"),
    )


@query
def scalar_nested(spark, d):
    raw = t.raw_sessions(spark, d)
    return raw.select(
        F.col("row_no").alias("event_id"),
        exports.first_calories(F.col("aggregate")).alias("calories"),
        F.get("aggregate", F.lit(0))["metricName"].alias("first_metric"),
        F.get("aggregate", F.lit(5))["metricName"].alias("no_metric"),
        F.size(F.filter("aggregate", lambda m: m["floatValue"] > 50)).alias("large_metrics"),
    )


@query
def scalar_text(spark, d):
    body = F.col("text")
    return t.documents(spark, d).select(
        "doc_id",
        F.length(body).alias("n"),
        F.substring(body, 4, 2147483647).alias("rest"),
        text.word_count(body).alias("words"),
        text.snake_case(F.concat("lang", F.lit(" & "), "source")).alias("label"),
        text.duration_minutes(F.concat(F.col("n_chars").cast("string"), F.lit(".5 S"))).alias("minutes"),
        text.duration_minutes(F.col("lang")).alias("no_minutes"),
        text.clean_line(F.concat(F.lit("‎x "), F.col("lang"))).alias("cleaned"),
        text.token_count(body).alias("tokens"),
    )


# ---- ranking and rules ----


@query
def term_frequencies(spark, d):
    return ranking.term_frequencies(t.documents(spark, d))


@query
def corpus_statistics(spark, d):
    stats = ranking.corpus_stats(t.documents(spark, d), corpus="lang")
    return stats.withColumn("avgdl", F.round("avgdl", 6))


@query
def bm25_idf(spark, d):
    return ranking.term_idf(t.documents(spark, d)).withColumn("idf", F.round("idf", 6))


@query
def bm25_topk(spark, d):
    return ranking.bm25_topk(t.documents(spark, d), t.search_queries(spark, d)).drop("corpus").withColumn("score", F.round("score", 6))


@query
def multi_corpus_topk(spark, d):
    docs = t.documents(spark, d).withColumn("corpus", F.col("lang"))
    hits = ranking.bm25_topk(docs, t.search_queries(spark, d), {"en": 3, "fr": 2, "es": 2, "de": 1})
    return hits.withColumn("score", F.round("score", 6))


@query
def topic_detect(spark, d):
    return t.documents(spark, d).select("doc_id", rules.topic(F.col("text")).alias("topic"))


@query
def page_type_classify(spark, d):
    return t.table(spark, d, "pages").select(
        "page_id",
        rules.page_type(F.concat("url", F.lit(" "), "html")).alias("by_page"),
        rules.page_type(F.col("url"), F.col("html")).alias("by_url"),
    )


@query
def tiered_rule_lookup(spark, d):
    parts = t.table(spark, d, "part").select("p_partkey", "p_name")
    return rules.tiered_lookup(parts, "p_name", t.lookup_rules(spark, d))


@query
def rule_apply(spark, d):
    parts = t.table(spark, d, "part").select("p_partkey", "p_name")
    found = rules.tiered_lookup(parts, "p_name", t.lookup_rules(spark, d))
    return rules.apply_rule(found, t.lookup_rules(spark, d)).withColumns(
        {
            "style_priority": F.array_join("style_priority", "|"),
            "must_have": F.col("decision_rules")["must_have"],
            "decision_rules": F.size("decision_rules"),
        }
    )


@query
def priority_rerank(spark, d):
    docs = t.documents(spark, d)
    hits = ranking.bm25_topk(docs, t.search_queries(spark, d))
    number = (F.col("query_id") % 20).cast("string")
    candidates = hits.join(docs, "doc_id").select(
        "query_id",
        "rank",
        "doc_id",
        F.col("source").alias("name"),
        F.col("lang").alias("keywords"),
        F.col("text").alias("everything"),
        F.array(F.concat(F.lit(" SRC"), number, F.lit("x")), F.lit("Es"), F.lit("the")).alias("priorities"),
    )
    return ranking.rerank(candidates).select("query_id", "doc_id", "rank", "match_score")


@query
def recommend_batch(spark, d):
    found = recommend.recommend(t.search_queries(spark, d), t.corpus_documents(spark, d), t.source_rules(spark, d))
    return found.withColumn("region", F.col("decision_rules")["region"]).drop("decision_rules")


@query
def page_overrides(spark, d):
    corpora = {"en": "style", "fr": "ux", "es": "landing", "de": "ux"}
    found = recommend.page_overrides(t.search_queries(spark, d), t.corpus_documents(spark, d, corpora))
    return found.withColumns({c: F.array_join(c, "|") for c in ("recommendations", "components")})


# ---- streams ----


def _item_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = t.table(spark, d, "lineitem").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(d)


@query
def stream_insert_dedupe(spark, d):
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    stream = _item_stream(spark, d).select(
        F.col("l_shipdate").alias("ts"),
        price.alias("amount"),
        F.col("l_linestatus").alias("account"),
        keys.row_key("bank", F.col("l_orderkey"), F.col("l_linenumber")).alias("dedupe_key"),
    )
    out, checkpoint = scratch_path(spark, "stream-rows"), scratch_path(spark, "stream-log")
    loads.run_to_end(loads.stream_insert_dedupe(stream, out, checkpoint, ("ts", "amount", "account")))
    return spark.read.parquet(out).drop("batch")


def _in_arrivals(spark: SparkSession, d: str, load: Callable[[DataFrame], StreamingQuery], deliveries: int = 1) -> None:
    """Run a load after each arrival: the items received in one year, delivered so often."""
    items = t.received_items(spark, d)
    span = items.agg(F.min("received").alias("a"), F.max("received").alias("b")).first()
    folder = scratch_path(spark, "arrivals")
    stream = spark.readStream.schema(items.schema).option("recursiveFileLookup", True).parquet(f"{folder}/*")
    for year in range(span["a"], span["b"] + 1):
        for delivery in range(deliveries):
            items.filter(F.col("received") == year).write.parquet(f"{folder}/{year}-{delivery}")
            loads.run_to_end(load(stream))


@query
def stream_weekly_spend(spark, d):
    """Weekly spend of items in the order of their receipt; weeks close 14 days after their end."""
    out, checkpoint = scratch_path(spark, "stream-weeks"), scratch_path(spark, "stream-log")

    def load(stream: DataFrame) -> StreamingQuery:
        rows = stream.filter("l_returnflag <> 'R'").select("ts", F.col("price").alias("spend"), F.lit(1).alias("n"))
        return weeks.close_weeks(rows, out, checkpoint, "ts", "14 days", {"spend": "decimal(18,2)", "n": "bigint"})

    _in_arrivals(spark, d, load)
    week = F.date_trunc("week", "ts").cast("date").alias("week_start")
    late = weeks.late_rows(spark, out).groupBy(week).agg(F.count(F.lit(1)).alias("late"))
    found = weeks.closed_weeks(spark, out).unionByName(weeks.open_weeks(spark, out))
    return found.join(late, "week_start", "full").select(
        "week_start", "spend", F.coalesce("n", F.lit(0)).alias("n"), "is_open", F.coalesce("late", F.lit(0)).alias("late")
    )


@query
def stream_dedupe_bounded(spark, d):
    """Every delivery comes twice; repeats are dropped by state that a watermark of 60 days frees.

    Keys are moved and kept as 32 bytes and spelled out, 64 letters, in what is read.
    """
    out, checkpoint = scratch_path(spark, "stream-rows"), scratch_path(spark, "stream-log")
    columns = ["l_orderkey", "l_linenumber", "price", "l_returnflag"]

    def load(stream: DataFrame) -> StreamingQuery:
        day = F.col("ts").cast("date").cast("string")
        keyed = stream.withColumn("dedupe_key", keys.row_key("bank", day, *[F.col(c).cast("string") for c in columns]))
        keyed = keyed.select("ts", *columns, F.unhex("dedupe_key").alias("dedupe_key"))
        rows = loads.dedupe_in_stream(keyed, "ts", "60 days")
        return loads.append_stream(rows, out, checkpoint)

    _in_arrivals(spark, d, load, deliveries=2)
    return zoneless(spark.read.parquet(out), "ts").withColumn("dedupe_key", F.lower(F.hex("dedupe_key")))
