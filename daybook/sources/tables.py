"""The given star-schema and text tables in the shapes of this package's raw and curated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.keys import row_key
from daybook.operators.columns import computed_once
from daybook.schemas import BankProfile, CategoryRule

RULES = [
    CategoryRule("bolt|rod", "hardware"),
    CategoryRule("ring", "jewellery"),
    CategoryRule("widget|gizmo", "gadgets"),
    CategoryRule("atm|cash wdl", "cash"),
]
OLD_RULES = [RULES[0], CategoryRule("ring|gear", "parts"), RULES[3]]

PROFILES = [
    BankProfile(
        "open", ("Date", "Narration", "Amount", "Balance"), "Date", "Narration",
        amount_style="signed", amount_col="Amount", date_format="%d/%m/%Y",
    ),
    BankProfile(
        "filed", ("Date", "Narration", "Withdrawal Amt.", "Deposit Amt.", "Closing Balance"),
        "Date", "Narration", amount_style="debit_credit",
        debit_col="Withdrawal Amt.", credit_col="Deposit Amt.",
    ),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def received_items(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their year of receipt, which is up to 30 days after their shipping."""
    days = ((F.col("l_orderkey") + 5 * F.col("l_linenumber")) % 31).cast("int")
    return table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("ts"), "l_orderkey", "l_linenumber",
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), "l_returnflag",
        F.year(F.date_add(F.col("l_shipdate").cast("date"), days)).alias("received"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def narration() -> Column:
    product = F.upper("p_name")
    order, supplier = F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")
    kind = F.col("l_linenumber") % 5
    return (
        F.when(kind == 0, F.concat(F.lit("UPI/DR/"), order, F.lit("/"), product, F.lit("/UTIB/x@axis")))
        .when(kind == 1, F.concat(F.lit("UPI-"), product, F.lit("-x@icici-"), order))
        .when(kind == 2, F.concat(F.lit("POS "), supplier, F.lit(" "), product))
        .when(kind == 3, F.concat(F.lit("NEFT-BANK"), supplier, F.lit("-"), product))
        .otherwise(F.concat(F.lit("ATM CASH WDL S1"), order))
    )


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the name of their part."""
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    items = table(spark, folder, "lineitem")
    return items.join(part, items["l_partkey"] == part["p_partkey"])


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Curated shape without merchant and category; a returned item is money in."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return sales(spark, folder).select(
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_returnflag") == "R", price).otherwise(-price).cast("decimal(12,2)").alias("amount"),
        F.lit("INR").alias("currency"),
        narration().alias("narration"),
        F.col("l_linestatus").alias("account"),
        F.lit("bank").alias("source"),
        row_key("bank", F.col("l_orderkey"), F.col("l_linenumber")).alias("dedupe_key"),
    )


def statement_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Raw statement cells with three date spellings, balance lines, blanks and garbage."""
    kind, number = F.col("l_linenumber") % 3, F.col("l_linenumber")
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    date_text = (
        F.when((number == 6) & (flag == "A"), "n/a")
        .when(kind == 0, F.date_format("l_shipdate", "dd/MM/yyyy"))
        .when(kind == 1, F.concat(F.lit(" "), F.date_format("l_shipdate", "d-M-yy")))
        .otherwise(F.date_format("l_shipdate", "dd MMM yyyy"))
    )
    text = (
        F.when((number == 7) & (flag == "N"), "Closing Balance")
        .when((number == 5) & (flag == "A"), "  ")
        .otherwise(F.concat(F.lit(" "), narration(), F.lit(" ")))
    )
    suffix = F.when(flag == "R", " Cr").otherwise(" Dr")
    rows = sales(spark, folder).select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linestatus") == "O", "open").otherwise("filed").alias("profile"),
        F.when(F.col("l_linestatus") == "O", "signed").otherwise("debit_credit").alias("amount_style"),
        date_text.alias("date_text"),
        text.alias("narration_text"),
        F.concat(F.lit("₹ "), price, suffix).alias("amount_text"),
        F.when(flag != "R", price).alias("debit_text"),
        F.when(flag == "R", F.concat(F.lit("INR "), price)).alias("credit_text"),
    )
    return computed_once(rows)


def statement_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Statement files as lines, one file per supplier: preamble, header, sales of the supplier."""
    supplier = table(spark, folder, "supplier")
    open_style = F.col("s_nationkey") % 2 == 0
    header = (
        F.when(F.col("s_nationkey") == 7, "When,What,How much")
        .when(open_style, "Date, Narration ,Amount,Balance")
        .otherwise("Narration,Date,Withdrawal Amt.,Deposit Amt.,Closing Balance")
    )
    path = F.concat(F.lit("statement_"), F.col("s_suppkey").cast("string"), F.lit(".csv"))
    top = supplier.select(
        path.alias("path"),
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(
            F.concat(
                F.slice(F.array(F.col("s_name"), F.lit("Account No,XX"), F.lit(",,")), F.lit(1), (F.col("s_suppkey") % 4).cast("int")),
                F.array(header),
            )
        ).alias("pos", "line"),
    ).withColumn("line_id", F.lit(0).cast("bigint"))
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    day = F.date_format("l_shipdate", "dd/MM/yyyy")
    text = F.concat(F.lit('"'), narration(), F.lit('"'))
    returned = F.col("l_returnflag") == "R"
    signed = F.concat_ws(",", day, text, F.concat(F.when(~returned, "-").otherwise(""), price), F.lit(""))
    empty = F.lit("")
    pair = F.concat_ws(
        ",", text, day, F.when(returned, empty).otherwise(price), F.when(returned, price).otherwise(empty), empty
    )
    owner = supplier.select("s_suppkey", "s_nationkey")
    body = sales(spark, folder).join(owner, F.col("l_suppkey") == F.col("s_suppkey")).select(
        path.alias("path"),
        F.lit(1).cast("bigint").alias("block"),
        F.lit(0).alias("pos"),
        F.when(open_style, signed).otherwise(pair).alias("line"),
        F.col("l_orderkey").alias("line_id"),
    )
    return top.unionByName(body)


def activities(spark: SparkSession, folder: str) -> DataFrame:
    """Events moved to 1997-98; a signup is only ever in an even week."""
    weeks = F.when(F.col("event_type") == "signup", (F.col("user_id") % 50) * 2).otherwise(F.col("user_id") % 104)
    day = F.date_add(F.to_date(F.lit("1997-01-06")), (weeks * 7).cast("int"))
    midnight = F.col("ts").cast("date").cast("timestamp_ntz")
    return table(spark, folder, "events").select(
        "user_id",
        (day.cast("timestamp_ntz") + (F.col("ts") - midnight)).alias("ts_start"),
        F.col("event_type").alias("activity_type"),
        F.col("value").alias("duration_min"),
    )


def played_ms() -> Column:
    return F.floor(F.col("value") * 1000).cast("int")


def listens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "ts",
        F.col("event_type").alias("track"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("artist"),
        played_ms().alias("ms_played"),
        F.lit("spotify").alias("source"),
        row_key("spotify", F.substring(F.col("ts").cast("string"), 1, 19), F.col("event_type"), F.col("user_id"), played_ms()).alias("dedupe_key"),
    )


def _iso(ts: Column, end: str = "Z") -> Column:
    return F.concat(F.translate(F.substring(ts.cast("string"), 1, 19), " ", "T"), F.lit(end))


def raw_extended_listens(spark: SparkSession, folder: str) -> DataFrame:
    music = F.col("event_type") != "error"
    return table(spark, folder, "events").select(
        _iso(F.col("ts")).alias("ts"),
        played_ms().cast("bigint").alias("ms_played"),
        F.when(music, F.col("event_type")).alias("master_metadata_track_name"),
        F.when(music, F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("master_metadata_album_artist_name"),
        F.when(music, F.col("props")).alias("master_metadata_album_album_name"),
        (F.col("value") < 10).alias("skipped"),
    )


def raw_account_listens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.substring(F.col("ts").cast("string"), 1, 16).alias("endTime"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("artistName"),
        F.col("event_type").alias("trackName"),
        played_ms().cast("bigint").alias("msPlayed"),
    )


def _minute_of_2024(number: Column) -> Column:
    """A zoneless minute counted from 2024-01-01."""
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(mins=number.cast("int"))


def raw_searches(spark: SparkSession, folder: str) -> DataFrame:
    verb = F.when(F.col("lang") == "en", "Searched for ").otherwise("Visited ")
    return table(spark, folder, "documents").select(
        F.concat(verb, "text").alias("title"),
        _iso(_minute_of_2024(F.col("doc_id")), ".250Z").alias("time"),
    )


def raw_watches(spark: SparkSession, folder: str) -> DataFrame:
    verb = F.when(F.col("lang") == "en", "Visited ").otherwise("Watched ")
    channel = F.struct(F.col("source").alias("name"), F.lit("https://example.org/").alias("url"))
    note = F.struct(F.when(F.col("source") == "src5", "From Google Ads").otherwise("other").alias("name"))
    return table(spark, folder, "documents").select(
        F.concat(verb, "text").alias("title"),
        _iso(_minute_of_2024(F.col("doc_id"))).alias("time"),
        F.when(F.col("source") != "src3", F.array(channel)).alias("subtitles"),
        F.when(F.col("source") != "src4", F.array(note)).alias("details"),
    )


def raw_sessions(spark: SparkSession, folder: str) -> DataFrame:
    k = F.from_json("props", "k double")["k"]
    metric = lambda name, value: F.struct(F.lit(name).alias("metricName"), value.alias("floatValue"))
    end = F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)"))
    timed = F.col("event_type").isin("click", "purchase")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("row_no"),
        F.initcap(F.concat("event_type", F.lit(" session!"))).alias("fitnessActivity"),
        _iso(F.col("ts"), ".000+05:30").alias("startTime"),
        F.when(F.col("event_type") != "view", _iso(end, "")).alias("endTime"),
        F.when(timed, F.concat(F.col("value").cast("string"), F.lit("s"))).alias("duration"),
        F.array(metric("com.google.heart_minutes", F.col("value")), metric("com.google.Calories.expended", k)).alias("aggregate"),
    )


def raw_dailies(spark: SparkSession, folder: str) -> DataFrame:
    text = lambda c: c.cast("string")
    value = F.col("value")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("row_no"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(text(F.col("ts").cast("date"))).alias("Date"),
        text(value).alias("Step count"),
        F.when(F.col("event_type") == "view", "-").otherwise(text(value)).alias("Distance (m)"),
        text(F.col("user_id")).alias("Move Minutes count"),
        F.lit("1").alias("Heart Points"),
    )


def chat_day(conv: Column) -> Column:
    """Day of a conversation: every third day from 1997-01-20, over sixteen years."""
    return F.date_add(F.to_date(F.lit("1997-01-20")), ((conv % 2000) * 3).cast("int"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as curated messages."""
    minute = F.make_dt_interval(mins=F.col("turn").cast("int"))
    return table(spark, folder, "conversations").select(
        (chat_day(F.col("conv_id")).cast("timestamp_ntz") + minute).alias("ts"),
        F.col("conv_id").cast("string").alias("chat"),
        F.col("role").alias("sender"),
        (F.col("role") == "user").alias("is_me"),
        "text",
    )


def chat_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations rendered as chat export lines; a text of many lines gives continuations."""
    rendered = F.concat(
        F.date_format("ts", "dd/MM/yy, HH:mm"), F.lit(" - "), F.col("sender"), F.lit(": "), F.col("text")
    )
    turn = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("path"),
        F.floor(F.col("turn") / 1024).alias("block"),
        F.col("turn").alias("line_id"),
        (chat_day(F.col("conv_id")).cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("ts"),
        F.col("role").alias("sender"),
        "text",
    )
    return turn.select("path", "block", "line_id", F.posexplode(F.split(rendered, "\n")).alias("pos", "line"))


def dated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One chat file per customer with a line per order; odd customers write month first."""
    pattern = F.when(F.col("o_custkey") % 2 == 1, F.date_format("o_orderdate", "MM/dd/yy")).otherwise(
        F.date_format("o_orderdate", "dd/MM/yy")
    )
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("path"),
        F.col("o_orderkey").alias("line_id"),
        F.concat(pattern, F.lit(", 09:30 - "), F.col("o_orderpriority"), F.lit(": paid")).alias("line"),
    )


def calendar_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One calendar per user in chunks of a thousand events, summaries folded over two lines."""
    stamp = F.regexp_replace(F.substring(F.col("ts").cast("string"), 1, 19), "[-:]", "")
    timed = F.concat(F.lit(":"), F.translate(stamp, " ", "T"), F.lit("Z"))
    dated = F.concat(F.lit(";VALUE=DATE:"), F.substring(stamp, 1, 8))
    uid = F.when(F.col("event_type") != "view", F.concat(F.lit("UID:e"), F.col("event_id").cast("string"), F.lit("@x")))
    text = F.concat_ws(
        "\n",
        F.lit("BEGIN:VCALENDAR"),
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("DTSTART"), F.when(F.col("event_type") == "signup", dated).otherwise(timed)),
        F.concat(F.lit("SUMMARY:"), F.col("event_type"), F.lit(" of\\, us")),
        F.concat(F.lit(" er "), F.col("user_id").cast("string")),
        uid,
        F.lit("END:VEVENT"),
        F.lit("END:VCALENDAR"),
    )
    return table(spark, folder, "events").select(
        F.col("user_id").alias("path"),
        F.floor(F.col("event_id") / 1000).alias("block"),
        F.col("event_id").alias("line_id"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    )


def routed_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as files: the form of the URL decides the kind of file."""
    number = F.col("page_id").cast("string")
    path = (
        F.when(F.col("url").contains("?utm_source"), F.concat(F.lit("/in/Streaming_History_Audio_"), number, F.lit(".json")))
        .when(F.col("url").endswith("#top"), F.concat(F.lit("/in/"), number, F.lit("_chat.txt")))
        .when(F.col("url").endswith(".html"), F.concat(F.lit("/in/"), number, F.lit(".csv")))
        .when(F.col("url").contains("?page="), F.concat(F.lit("/in/Takeout/Calendar/"), number, F.lit("_chat.txt")))
        .when(F.col("url").endswith("/"), F.concat(F.lit("/in/Takeout/Calendar/"), number, F.lit(".ics")))
        .otherwise(F.col("url"))
    )
    return table(spark, folder, "pages").select("page_id", path.alias("path"), F.col("html").alias("head"))


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files with a content hash and a path."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("file_sha256"),
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
        "lang",
        "n_chars",
    )


def search_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items, whole, as queries."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


# Language of a document -> corpus it stands for. The style corpus stays empty.
LANGUAGE_CORPUS = {"en": "product", "fr": "color", "es": "landing", "de": "typography"}


def corpus_documents(spark: SparkSession, folder: str, corpora: dict[str, str] | None = None) -> DataFrame:
    """Documents in the corpora of a recommendation."""
    corpus = F.lit(None).cast("string")
    for lang, name in (corpora or LANGUAGE_CORPUS).items():
        corpus = F.when(F.col("lang") == lang, F.lit(name)).otherwise(corpus)
    said = {
        "Product Type": F.col("source"),
        "Pattern Name": F.col("source"),
        "Style Category": F.col("source"),
        "Category": F.col("source"),
        "Primary (Hex)": F.col("source"),
        "Heading Font": F.col("source"),
        "Keywords": F.col("lang"),
        "Color Strategy": F.col("lang"),
        "Mood/Style Keywords": F.col("lang"),
        "Notes": F.concat(F.lit("doc "), F.col("doc_id").cast("string")),
        "Section Order": F.concat(F.lit("doc "), F.col("doc_id").cast("string")),
        "Don't": F.concat(F.lit("doc "), F.col("doc_id").cast("string")),
    }
    long = F.when(F.col("n_chars") > 3000, F.concat(F.lit("long "), F.col("source"))).otherwise("")
    said |= {c: long for c in ("Do", "Effects & Animation", "Primary CTA Placement")}
    record = F.create_map(*[x for name, value in said.items() for x in (F.lit(name), value)])
    return documents(spark, folder).filter(corpus.isNotNull()).select(
        corpus.alias("corpus"), "doc_id", "text", record.alias("record")
    )


def lookup_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered rules out of the parts: one per brand, labelled in three ways."""
    number = F.regexp_extract("p_brand", r"\d+", 0).cast("int")
    per_brand = table(spark, folder, "part").groupBy(number.alias("rule_no")).agg(
        F.min("p_name").alias("lo"), F.max("p_name").alias("hi"), F.min("p_type").alias("kind")
    )
    kind = F.col("rule_no") % 3
    return per_brand.select(
        "rule_no",
        F.when(kind == 0, F.initcap("lo"))
        .when(kind == 1, F.element_at(F.split("hi", " "), 2))
        .otherwise(F.concat(F.element_at(F.split("lo", " "), 1), F.lit("/ware-"), F.element_at(F.split("hi", " "), 1)))
        .alias("label"),
        F.col("hi").alias("pattern"),
        F.concat(F.col("lo"), F.lit(" + "), F.col("kind")).alias("style_priority"),
        F.col("kind").alias("color_mood"),
        F.col("lo").alias("typography_mood"),
        F.lit("fade").alias("key_effects"),
        F.col("kind").alias("anti_patterns"),
        F.when(kind == 2, "{bad").otherwise(F.concat(F.lit('{"must_have": "'), F.col("lo"), F.lit('"}'))).alias("decision_rules"),
        F.lit("HIGH").alias("severity"),
    )


def source_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered rules on document sources, one per nation."""
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("rule_no"),
        F.concat(F.lit("SRC"), (F.col("n_nationkey") * 2).cast("string")).alias("label"),
        F.col("n_name").alias("pattern"),
        F.concat(F.lit("src"), F.col("n_nationkey").cast("string"), F.lit(" + en")).alias("style_priority"),
        F.lit("Calm").alias("color_mood"),
        F.lit("Plain").alias("typography_mood"),
        F.lit("fade").alias("key_effects"),
        F.col("n_name").alias("anti_patterns"),
        F.concat(F.lit('{"region": "'), F.col("n_regionkey").cast("string"), F.lit('"}')).alias("decision_rules"),
        F.lit("HIGH").alias("severity"),
    )
