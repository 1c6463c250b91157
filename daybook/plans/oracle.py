"""DuckDB SQL for the registered queries, over the given tables as views."""

from __future__ import annotations

from daybook.fixed_values import PAGE_TYPES, TOPIC_KEYWORDS

NARRATION = """CASE l_linenumber % 5
  WHEN 0 THEN 'UPI/DR/' || l_orderkey || '/' || upper(p_name) || '/UTIB/x@axis'
  WHEN 1 THEN 'UPI-' || upper(p_name) || '-x@icici-' || l_orderkey
  WHEN 2 THEN 'POS ' || l_suppkey || ' ' || upper(p_name)
  WHEN 3 THEN 'NEFT-BANK' || l_suppkey || '-' || upper(p_name)
  ELSE 'ATM CASH WDL S1' || l_orderkey END"""

PRICE = "CAST(l_extendedprice AS DECIMAL(12,2))"

SALES = "lineitem JOIN part ON l_partkey = p_partkey"

TX = f"""tx AS (SELECT l_shipdate AS ts,
  CAST(CASE WHEN l_returnflag = 'R' THEN {PRICE} ELSE -{PRICE} END AS DECIMAL(12,2)) AS amount,
  'INR' AS currency, {NARRATION} AS narration, l_linestatus AS account, 'bank' AS source,
  sha256('bank|' || l_orderkey || '|' || l_linenumber) AS dedupe_key FROM {SALES})"""


# Four ways to find a merchant in a narration: what stands after the reference of a UPI transfer,
# between the marks of another UPI transfer, after a card terminal, after a bank transfer.
MERCHANT = """list_filter([upper(trim(m)) FOR m IN [
  regexp_extract(narration, 'UPI/(?:DR|CR)/\\d+/([A-Za-z0-9 .&_]+?)/', 1),
  regexp_extract(narration, 'UPI[-/]([A-Za-z0-9 .&_]+?)[-/]', 1),
  regexp_extract(narration, 'POS[ /]\\d*[ /]?([A-Za-z0-9 .&*_]+)', 1),
  regexp_extract(narration, '(?:NEFT|IMPS|RTGS)[-/ ][A-Z0-9]*[-/ ]?([A-Za-z0-9 .&_]+)', 1)]], lambda m: m <> '')[1]"""


def first_label(rules: list[tuple[str, str]]) -> str:
    """The label of the first rule one of whose words occurs in the merchant or else the narration."""
    text = "lower(coalesce(merchant, narration, ''))"
    found = ", ".join(
        f"if({' OR '.join(f'contains({text}, {w!r})' for w in words.split('|'))}, {label!r}, NULL)" for words, label in rules
    )
    return f"list_filter([{found}], lambda label: label IS NOT NULL)[1]"


RULES = [("bolt|rod", "hardware"), ("ring", "jewellery"), ("widget|gizmo", "gadgets"), ("atm|cash wdl", "cash")]
OLD_RULES = [("bolt|rod", "hardware"), ("ring|gear", "parts"), ("atm|cash wdl", "cash")]

ENRICHED = f"""{TX}, with_merchant AS (SELECT *, {MERCHANT} AS merchant FROM tx),
enriched AS (SELECT *, {first_label(RULES)} AS category FROM with_merchant)"""

ACTIVITIES = """activities AS (SELECT user_id, event_type AS activity_type, value AS duration_min,
  CAST(DATE '1997-01-06' + CAST(7 * CASE WHEN event_type = 'signup' THEN (user_id % 50) * 2
    ELSE user_id % 104 END AS INTEGER) AS TIMESTAMP) + (ts - date_trunc('day', ts)) AS ts_start
  FROM events)"""

GAP_DAYS = """gap_days AS (
  SELECT user_id, CAST(d AS DATE) AS day FROM (SELECT DISTINCT user_id FROM events),
    (SELECT unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, max(ts), INTERVAL 1 DAY)) AS d FROM events)
  EXCEPT SELECT user_id, CAST(ts AS DATE) FROM events)"""

MS = "CAST(floor(value * 1000) AS INTEGER)"

LISTENS = f"""listens AS (SELECT ts, event_type AS track, 'user_' || user_id AS artist,
  {MS} AS ms_played, 'spotify' AS source,
  sha256('spotify|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || event_type || '|' || user_id || '|' || {MS})
  AS dedupe_key FROM events)"""

CHAT_DAY = "CAST(DATE '1997-01-20' + CAST((conv_id % 2000) * 3 AS INTEGER) AS TIMESTAMP)"

MESSAGES = f"""messages AS (SELECT {CHAT_DAY} + to_minutes(CAST(turn AS INTEGER)) AS ts,
  CAST(conv_id AS VARCHAR) AS chat, role AS sender, role = 'user' AS is_me, text FROM conversations)"""


def days(as_of: str = "1998-12-31") -> str:
    return f"""first_day AS (SELECT least(
    (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem), (SELECT CAST(min(ts) AS DATE) FROM events),
    (SELECT CAST(min(ts) AS DATE) FROM messages), DATE '{as_of}' - 365) AS lo),
  days AS (SELECT CAST(d AS DATE) AS day, CAST(date_trunc('week', d) AS DATE) AS week_start,
    CAST(date_trunc('month', d) AS DATE) AS month_start
    FROM first_day, generate_series(CAST(lo AS TIMESTAMP), TIMESTAMP '{as_of}', INTERVAL 1 DAY) s(d))"""


DAYS = f"{MESSAGES}, {days()}"
WEEKS = f"""{DAYS}, {ACTIVITIES}, weeks AS (SELECT week_start, EXISTS (SELECT 1 FROM activities a
  WHERE CAST(date_trunc('week', a.ts_start) AS DATE) = w.week_start AND a.activity_type IN ('signup'))
  AS went_to_gym FROM (SELECT DISTINCT week_start FROM days) w)"""

WEEKLY = """weekly AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start,
  CAST(sum(-amount) AS DECIMAL(18,2)) AS spend FROM tx WHERE amount < 0 GROUP BY 1)"""

COLLAPSED = """(SELECT * FROM {0} QUALIFY row_number() OVER
  (PARTITION BY dedupe_key ORDER BY ts, amount, narration) = 1)"""

DOC_FILES = """doc_files AS (SELECT doc_id, sha256(text) AS file_sha256, 'docs/' || doc_id AS path,
  lang, n_chars FROM documents)"""

TOKEN = r"[\p{L}\p{N}_]{3,}"


def tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}')"


DAY_TEXT = """CASE WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN NULL ELSE CAST(l_shipdate AS DATE) END"""

STATEMENT = f"""rows AS (SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'filed' END AS account,
  {DAY_TEXT} AS day,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'N' THEN 'Closing Balance'
       WHEN l_linenumber = 5 AND l_returnflag = 'A' THEN '' ELSE {NARRATION} END AS narration,
  CASE WHEN l_returnflag = 'R' THEN {PRICE} ELSE -{PRICE} END AS amount FROM {SALES}),
kept AS (SELECT *, {MERCHANT} AS merchant FROM rows
  WHERE day IS NOT NULL AND narration <> '' AND narration <> 'Closing Balance')"""

FILE_PATH = """CASE WHEN contains(url, '?utm_source') THEN '/in/Streaming_History_Audio_' || page_id || '.json'
  WHEN url LIKE '%#top' THEN '/in/' || page_id || '_chat.txt'
  WHEN url LIKE '%.html' THEN '/in/' || page_id || '.csv'
  WHEN contains(url, '?page=') THEN '/in/Takeout/Calendar/' || page_id || '_chat.txt'
  WHEN url LIKE '%/' THEN '/in/Takeout/Calendar/' || page_id || '.ics' ELSE url END"""

STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"

TF = f"""toks AS (SELECT doc_id, lang, unnest({tokens('text')}) AS term FROM documents),
tf AS (SELECT doc_id, any_value(lang) AS lang, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
dl AS (SELECT doc_id, lang, source, text, n_chars, len({tokens('text')}) AS dl FROM documents)"""

QT = f"""qt AS (SELECT item_id AS query_id, term, count(*) AS mult FROM
  (SELECT item_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY 1, 2)"""


def bm25(corpus: str, k: str, queries: str = QT, where: str = "true") -> str:
    """CTEs up to ``hits``; ``corpus`` is an expression over a document row, ``k`` over a hit."""
    return f"""{TF}, {queries},
  docs AS (SELECT *, {corpus} AS corpus FROM dl WHERE {where}),
  stats AS (SELECT corpus, count(*) AS n, sum(dl) / count(*) AS avgdl FROM docs GROUP BY corpus),
  post AS (SELECT docs.corpus, docs.doc_id, dl, term, tf FROM tf JOIN docs USING (doc_id)),
  dfs AS (SELECT corpus, term, count(*) AS df FROM post GROUP BY corpus, term),
  gains AS (SELECT corpus, query_id, doc_id, mult * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5
      / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS gain
    FROM post JOIN dfs USING (corpus, term) JOIN qt USING (term) JOIN stats USING (corpus)),
  scores AS (SELECT corpus, query_id, doc_id, sum(gain) AS score, sum(CAST(gain AS DECIMAL(28,12))) AS fine
    FROM gains GROUP BY 1, 2, 3),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus, query_id ORDER BY fine DESC, doc_id) AS rank
    FROM scores WHERE score > 0),
  hits AS (SELECT corpus, query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= {k})"""


def topic() -> str:
    counts = {
        name: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)
        for name, words in TOPIC_KEYWORDS.items()
    }
    rows = ", ".join(f"({i}, '{n}', {c})" for i, (n, c) in enumerate(counts.items()))
    return f"""SELECT doc_id, CASE WHEN best.n > 0 THEN best.t ELSE 'style' END AS topic FROM
      (SELECT doc_id, (SELECT struct_pack(n := n, t := t) FROM (VALUES {rows}) v(p, t, n)
        ORDER BY n DESC, p LIMIT 1) AS best FROM documents)"""


def page_type(context: str, fallback: str) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({context}), '{w}')" for w in words) + f" THEN '{label}'"
        for words, label in PAGE_TYPES
    )
    return f"CASE {whens} ELSE {fallback} END"


HINT = """CASE WHEN contains(lower(html), 'dashboard') OR contains(lower(html), 'data') THEN 'Dashboard / Data View'
  WHEN contains(lower(html), 'landing') OR contains(lower(html), 'marketing') THEN 'Landing / Marketing' ELSE 'General' END"""

LOOKUP_RULES = """rules AS (SELECT *, CASE rule_no % 3 WHEN 0 THEN lo WHEN 1 THEN split_part(hi, ' ', 2)
    ELSE split_part(lo, ' ', 1) || '/ware-' || split_part(hi, ' ', 1) END AS label
  FROM (SELECT CAST(regexp_extract(p_brand, '\\d+') AS INTEGER) AS rule_no, min(p_name) AS lo, max(p_name) AS hi,
    min(p_type) AS kind FROM part GROUP BY 1))"""


def tiers(items: str, item: str, rules: str = "rules") -> str:
    return f"""best AS (SELECT item, min(struct_pack(tier := tier, rule_no := rule_no)) AS b FROM (
    SELECT i.item, rule_no, CASE WHEN lower(label) = i.item THEN 1
      WHEN contains(i.item, lower(label)) OR contains(lower(label), i.item) THEN 2
      WHEN len([w FOR w IN string_split_regex(lower(label), '[/\\s-]+') IF w <> '' AND contains(i.item, w)]) > 0 THEN 3
      END AS tier FROM (SELECT DISTINCT lower({item}) AS item FROM {items}) i CROSS JOIN {rules})
    WHERE tier IS NOT NULL GROUP BY item)"""


SRC_RULES = "rules AS (SELECT n_nationkey AS rule_no, 'src' || n_nationkey * 2 AS label, n_name, n_regionkey FROM nation)"

CORPUS = "CASE lang WHEN 'en' THEN 'product' WHEN 'fr' THEN 'color' WHEN 'es' THEN 'landing' WHEN 'de' THEN 'typography' END"

KEY_OF_EVENTS = """SELECT event_id,
  sha256('spotify|' || {s} || '|' || event_type || '|' || coalesce(p, '') || '|' || ms) AS listen_key,
  sha256('google_search|' || {s} || '|' || props) AS search_key,
  sha256('youtube|' || {s} || '|' || props) AS watch_key,
  sha256('whatsapp|' || event_type || '|' || {s} || '|' || event_type || '|' || coalesce(c, '')) AS message_key,
  sha256('google_fit|' || {s} || '|' || coalesce(v, '')) AS session_key,
  sha256('google_fit|' || CAST(ts AS DATE)) AS daily_key,
  CASE WHEN event_type <> 'view' THEN sha256('calendar|' || event_id)
    ELSE sha256('calendar|' || {s} || '|' || props) END AS event_key,
  sha256('bank|acc|' || CAST(ts + INTERVAL 330 MINUTE AS DATE) || '|' || CAST(value AS DECIMAL(12,2)) || '|' || event_type)
    AS transaction_key,
  sha256('manual|' || CAST(ts AS DATE) || '|' || coalesce(v, '')) AS manual_key
FROM (SELECT *, CASE WHEN event_type <> 'error' THEN props END AS p, CASE WHEN event_type <> 'click' THEN props END AS c,
  CASE WHEN event_type <> 'view' THEN event_type END AS v, {ms} AS ms FROM events)"""

# Items arrive up to 30 days after their shipping.
RECEIVED = "year(CAST(l_shipdate AS DATE) + CAST((l_orderkey + 5 * l_linenumber) % 31 AS INTEGER))"

METRICS = """SELECT '{source}' AS source, '{table}' AS "table",
  count(*) FILTER (WHERE only_new) AS rows_inserted, CAST(sum(n) AS BIGINT) - count(*) FILTER (WHERE only_new) AS rows_skipped,
  CAST(min(lo) AS DATE) AS first_day, CAST(max(hi) AS DATE) AS last_day
  FROM (SELECT dedupe_key, count(*) AS n, bool_and({is_new}) AS only_new, min(ts) AS lo, max(ts) AS hi FROM {rows} GROUP BY 1)"""

SEARCHES = """SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) + INTERVAL 250 MILLISECOND AS ts,
  text AS query, 'google_search' AS source,
  sha256('google_search|' || strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') || '|' || text)
  AS dedupe_key FROM documents WHERE lang = 'en' AND text <> ''"""

WATCHES = """SELECT TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS ts, text AS title,
  CASE WHEN source <> 'src3' THEN source END AS channel, 'takeout' AS source,
  sha256('youtube|' || strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') || '|' || text)
  AS dedupe_key FROM documents WHERE lang <> 'en' AND source <> 'src5'"""

EXTENDED = f"""SELECT date_trunc('second', ts) AS ts, event_type AS track, 'user_' || user_id AS artist, props AS album,
  {MS} AS ms_played, value < 10 AS skipped, 'spotify' AS source,
  sha256('spotify|' || {STAMP} || '|' || event_type || '|user_' || user_id || '|' || {MS}) AS dedupe_key
  FROM events WHERE event_type <> 'error'"""

ACCOUNT = f"""SELECT date_trunc('minute', ts) AS ts, event_type AS track, 'user_' || user_id AS artist,
  CAST(NULL AS VARCHAR) AS album, {MS} AS ms_played, CAST(NULL AS BOOLEAN) AS skipped, 'spotify' AS source,
  sha256('spotify|' || strftime(ts, '%Y-%m-%d %H:%M:00') || '|' || event_type || '|user_' || user_id || '|' || {MS}) AS dedupe_key
  FROM events"""

LABEL = "CASE event_type WHEN 'signup' THEN 'strength_training' WHEN 'view' THEN 'evening_walk_at_home' ELSE event_type END"

PRODUCT_RULES = """names AS (SELECT p_name, min(p_brand) AS category, min(p_partkey) AS first FROM part GROUP BY p_name),
rules AS (SELECT first AS rule_no, p_name || '|' || reverse(p_name) AS match, category FROM names
  UNION ALL SELECT max(first) + 1000000, split_part(p_name, ' ', 2), max(category) FROM names GROUP BY split_part(p_name, ' ', 2))"""

BY_TABLE = f"""WITH {TX}, {PRODUCT_RULES}, m AS (SELECT *, {MERCHANT} AS merchant FROM tx),
  texts AS (SELECT DISTINCT lower(coalesce(merchant, narration, '')) AS t FROM m),
  found AS (SELECT t, arg_min(category, rule_no) AS category FROM texts JOIN rules ON regexp_matches(t, match) GROUP BY t)
  SELECT dedupe_key, ts, amount, merchant, category FROM m LEFT JOIN found ON t = lower(coalesce(merchant, narration, ''))"""

FILE_LINES = f"""owned AS (SELECT *, CASE WHEN s_nationkey = 7 THEN NULL WHEN s_nationkey % 2 = 0 THEN 'open' ELSE 'filed' END AS profile,
  'statement_' || s_suppkey || '.csv' AS path FROM supplier)"""

RERANK_SCORE = """(CASE WHEN contains(source, p) THEN 10 WHEN contains(lang, p) THEN 3 WHEN contains(lower(text), p) THEN 1 ELSE 0 END)"""

ORACLE: dict[str, str] = {
    "spend_in_skipped_weeks": f"""WITH {ENRICHED}, {WEEKS}, bought AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start,
        sum(-amount) AS s FROM enriched WHERE amount < 0 AND (merchant ILIKE '%bolt%' OR narration ILIKE '%bolt%')
        AND ts >= DATE '1997-01-01' GROUP BY 1)
      SELECT week_start, round(coalesce(s, 0)) AS spend FROM weeks LEFT JOIN bought USING (week_start)
      WHERE NOT went_to_gym AND week_start >= DATE '1997-01-01' AND week_start <= DATE '1998-12-31'""",
    "top_artists_by_hours": f"""WITH {LISTENS} SELECT artist, round(sum(ms_played) / 3600000.0, 1) AS hours FROM listens
      WHERE ms_played >= 30000 AND ts >= DATE '2024-01-01' AND ts < DATE '2024-02-01' GROUP BY artist
      ORDER BY hours DESC, artist LIMIT 5""",
    "days_without_messages": f"""WITH {DAYS} SELECT d.day FROM days d LEFT JOIN
      (SELECT DISTINCT CAST(ts AS DATE) AS day FROM messages WHERE is_me) m USING (day)
      WHERE m.day IS NULL AND d.day >= DATE '1997-01-01' AND d.day <= DATE '1998-12-31'""",
    "spine_days": f"WITH {DAYS} SELECT * FROM days",
    "weeks_flag": f"WITH {WEEKS} SELECT * FROM weeks",
    "weeks_flag_summary": f"""WITH {WEEKS} SELECT bool_or(went_to_gym) AS any_flagged, bool_and(went_to_gym) AS all_flagged,
      count(*) FILTER (WHERE went_to_gym) AS flagged, count(*) AS weeks FROM weeks""",
    "weekly_spend": f"WITH {TX}, {WEEKLY} SELECT * FROM weekly",
    "spend_by_week_inner": f"WITH {TX}, {WEEKLY}, {WEEKS} SELECT week_start, went_to_gym, spend FROM weeks JOIN weekly USING (week_start)",
    "user_weeks_flag": f"""WITH {ACTIVITIES}, cal AS (SELECT user_id, CAST(w AS DATE) AS week_start FROM (SELECT DISTINCT user_id FROM events),
        (SELECT unnest(generate_series(date_trunc('week', min(ts_start))::TIMESTAMP, max(ts_start), INTERVAL 7 DAY)) AS w FROM activities))
      SELECT user_id, week_start, (user_id, week_start) IN (SELECT (user_id, CAST(date_trunc('week', ts_start) AS DATE))
        FROM activities WHERE activity_type = 'signup') AS went_to_gym FROM cal""",
    "user_days_without_event": f"WITH {GAP_DAYS} SELECT user_id, day FROM gap_days",
    "user_gap_intervals": f"""WITH {GAP_DAYS}, runs AS (
      SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run FROM gap_days)
      SELECT user_id, min(day) AS gap_start, max(day) AS gap_end, CAST(count(*) AS INTEGER) AS days FROM runs
      GROUP BY user_id, run HAVING count(*) > 1""",
    "user_spine_days": """SELECT user_id, CAST(d AS DATE) AS day, CAST(date_trunc('week', d) AS DATE) AS week_start,
        CAST(date_trunc('month', d) AS DATE) AS month_start FROM
      (SELECT user_id, unnest(generate_series(date_trunc('day', min(ts))::TIMESTAMP, (SELECT max(ts) FROM events), INTERVAL 1 DAY)) AS d
       FROM events GROUP BY user_id)""",
    "sql_over_views": f"""WITH {ENRICHED} SELECT category, account, count(*) AS n, CAST(sum(-amount) AS DECIMAL(18,2)) AS spend
      FROM enriched WHERE amount < 0 GROUP BY category, account HAVING count(*) > 10""",
    "table_status": f"""WITH {TX}, {MESSAGES}, {LISTENS}, {ACTIVITIES}
      SELECT 'transactions' AS "table", count(*) AS rows, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM tx
      UNION ALL SELECT 'messages', count(*), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM messages
      UNION ALL SELECT 'listens', count(*), CAST(min(ts) AS DATE), CAST(max(ts) AS DATE) FROM listens
      UNION ALL SELECT 'activities', count(*), CAST(min(ts_start) AS DATE), CAST(max(ts_start) AS DATE) FROM activities
      UNION ALL SELECT '_imports', count(*), NULL, NULL FROM documents""",
    "categorical_vocabulary": f"""WITH {ENRICHED} SELECT "table", "column", value FROM (
      SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY value) AS n FROM (
        SELECT DISTINCT 'transactions' AS "table", 'category' AS "column", category AS value FROM enriched
        UNION ALL SELECT DISTINCT 'transactions', 'account', account FROM enriched
        UNION ALL SELECT DISTINCT 'activities', 'activity_type', event_type FROM events) WHERE value IS NOT NULL) WHERE n <= 50""",
    "categorized_counts": f"""WITH {ENRICHED} SELECT count(category) AS categorized, count(*) AS total,
      count(*) FILTER (WHERE category IS NULL) AS uncategorized FROM enriched""",
    "numeric_summary": f"""WITH {TX}, {WEEKLY}, {WEEKS} SELECT 'spend' AS "column", round(CAST(sum(spend) AS DOUBLE), 2) AS total,
      round(CAST(sum(spend) AS DOUBLE) / count(*), 4) AS average FROM weeks JOIN weekly USING (week_start)""",
    "capped_result": f"WITH {TX} SELECT ts, amount, narration FROM tx ORDER BY ts, amount, narration LIMIT 500",
    "import_summary": f"""WITH {TX}, {LISTENS}, s AS ({SEARCHES}), w AS ({WATCHES}), m AS (
      {METRICS.format(source='bank', table='transactions', is_new="ts >= DATE '1998-01-01'", rows='tx')}
      UNION ALL {METRICS.format(source='spotify', table='listens', is_new="ts >= DATE '2024-01-10'", rows='listens')}
      UNION ALL {METRICS.format(source='takeout', table='searches', is_new='true', rows='s')}
      UNION ALL {METRICS.format(source='takeout', table='youtube_watches', is_new='true', rows='w')})
      SELECT source, CAST(sum(rows_inserted) AS BIGINT) AS rows_inserted, CAST(sum(rows_skipped) AS BIGINT) AS rows_skipped,
        string_agg("table", '|' ORDER BY "table") AS tables, min(first_day) AS first_day, max(last_day) AS last_day FROM m GROUP BY source""",
    "load_stats": f"WITH {TX} {METRICS.format(source='bank', table='transactions', is_new="ts >= DATE '1998-01-01'", rows='tx')}",
    "insert_dedupe": f"""WITH {TX} SELECT * FROM {COLLAPSED.format('tx')}
      WHERE dedupe_key NOT IN (SELECT dedupe_key FROM tx WHERE ts < DATE '1998-01-01')""",
    "insert_dedupe_stats": f"""WITH {TX}, fresh AS (SELECT DISTINCT dedupe_key FROM tx
        WHERE dedupe_key NOT IN (SELECT dedupe_key FROM tx WHERE ts < DATE '1998-01-01'))
      SELECT (SELECT count(*) FROM fresh) AS rows_inserted, (SELECT count(*) FROM tx) - (SELECT count(*) FROM fresh) AS rows_skipped""",
    "upsert_latest": f"""WITH {TX}, old AS (SELECT * FROM tx WHERE ts < DATE '1998-01-01'),
      fresh AS (SELECT * FROM tx WHERE ts >= DATE '1998-01-01' QUALIFY row_number() OVER
        (PARTITION BY dedupe_key ORDER BY ts DESC, amount DESC, narration DESC) = 1)
      SELECT * FROM fresh UNION ALL SELECT * FROM {COLLAPSED.format('old')} WHERE dedupe_key NOT IN (SELECT dedupe_key FROM fresh)""",
    "raw_append_by_name": """SELECT event_id, ts, event_type AS track, CAST(NULL AS BOOLEAN) AS skipped, CAST(NULL AS VARCHAR) AS album FROM events
      UNION ALL BY NAME SELECT ts, event_id, value < 10 AS skipped, props AS album FROM events""",
    "ledger_new_files": f"""WITH {DOC_FILES} SELECT file_sha256, path FROM doc_files WHERE file_sha256 NOT IN
      (SELECT file_sha256 FROM doc_files WHERE doc_id IN (SELECT doc_id FROM labels))""",
    "ledger_upsert": f"""WITH {DOC_FILES}, entries AS (
        SELECT *, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS seen FROM doc_files WHERE doc_id IN (SELECT doc_id FROM labels)
        UNION ALL SELECT *, TIMESTAMP '2034-01-01' + to_minutes(CAST(doc_id AS INTEGER)) FROM doc_files)
      SELECT file_sha256, arg_max(path, seen) AS path, arg_min(lang, seen) AS source, max(seen) AS imported_at,
        arg_max(n_chars, seen) AS rows_inserted FROM entries GROUP BY file_sha256""",
    "content_fingerprint": "SELECT doc_id, sha256(text) AS file_sha256 FROM documents",
    "manual_log_append": f"""SELECT CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR AS ts_start, label AS activity_type, min(value) AS duration_min,
        'manual' AS source, sha256('manual|' || day || '|' || label) AS dedupe_key
      FROM (SELECT CAST(ts AS DATE) AS day, {LABEL} AS label, value FROM events) WHERE day >= DATE '2024-01-10' GROUP BY day, label""",
    "missing_products": f"""SELECT p.product, coalesce(n, 0) AS files, n IS NULL AS missing FROM
      (VALUES ('Search history'), ('YouTube history'), ('Google Fit'), ('Calendar')) p(product) LEFT JOIN
      (SELECT 'Calendar' AS product, count(*) AS n FROM pages WHERE {FILE_PATH} LIKE '%/Calendar/%.ics' HAVING count(*) > 0) f USING (product)""",
    "file_routing": f"""SELECT page_id, path, coalesce(candidates, '') AS candidates,
        CASE WHEN candidates IS NULL THEN 'none' WHEN contains(candidates, '|') THEN 'ambiguous' ELSE 'ok' END AS status,
        CASE WHEN NOT contains(candidates, '|') THEN candidates END AS source
      FROM (SELECT page_id, path, CASE WHEN path LIKE '%/Streaming%.json' THEN 'spotify'
          WHEN path LIKE '/in/Takeout/%_chat.txt' THEN 'whatsapp|takeout' WHEN path LIKE '/in/Takeout/%' THEN 'takeout'
          WHEN path LIKE '%_chat.txt' THEN 'whatsapp' WHEN path LIKE '%.csv' THEN 'bank' END AS candidates
        FROM (SELECT page_id, {FILE_PATH} AS path FROM pages))""",
    "listens_union_flavours": f"{ACCOUNT} UNION ALL {EXTENDED}",
    "listens_account_load": ACCOUNT,
    "listens_extended_load": EXTENDED,
    "search_history_load": SEARCHES,
    "watch_history_load": WATCHES,
    "session_normalize": """SELECT event_id AS row_no, start AS ts_start,
        CASE WHEN event_type <> 'view' THEN date_trunc('second', ts + to_seconds(CAST(floor(value) AS INTEGER))) END AS ts_end,
        event_type || '_session' AS activity_type, round(CASE WHEN event_type IN ('click', 'purchase') THEN value / 60.0
          WHEN event_type <> 'view' THEN epoch_us(date_trunc('second', ts + to_seconds(CAST(floor(value) AS INTEGER)))) / 60000000.0 - epoch_us(start) / 60000000.0 END, 6) AS duration_min,
        CAST(json_extract(props, '$.k') AS DOUBLE) AS calories, 'google_fit' AS source,
        sha256('google_fit|' || strftime(start, '%Y-%m-%d %H:%M:%S') || '|' || event_type || '_session') AS dedupe_key
      FROM (SELECT *, date_trunc('second', ts) - INTERVAL 330 MINUTE AS start FROM events)""",
    "fuzzy_header_project": """SELECT event_id AS row_no, CAST(ts AS DATE) AS day, CAST(round(value) AS INTEGER) AS steps,
        CASE WHEN event_type <> 'view' THEN value END AS distance_m, CAST(NULL AS DOUBLE) AS calories,
        CAST(user_id AS DOUBLE) AS active_min, 'google_fit' AS source, sha256('google_fit|' || CAST(ts AS DATE)) AS dedupe_key
      FROM events WHERE event_type <> 'error'""",
    "calendar_normalize": """SELECT user_id AS path, s AS ts_start, event_type || ' of, user ' || user_id AS title, event_type = 'signup' AS all_day,
        'google_calendar' AS source, CASE WHEN event_type <> 'view' THEN sha256('calendar|e' || event_id || '@x')
          ELSE sha256('calendar|' || strftime(s, '%Y-%m-%d %H:%M:%S') || '|' || event_type || ' of, user ' || user_id) END AS dedupe_key
      FROM (SELECT *, CASE WHEN event_type = 'signup' THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('second', ts) END AS s FROM events)""",
    "header_signature_match": f"""WITH {FILE_LINES} SELECT path, profile, CAST(s_suppkey % 4 AS INTEGER) AS header_row FROM owned WHERE profile IS NOT NULL""",
    "statement_file_load": f"""WITH {FILE_LINES}, rows AS (SELECT path, l_shipdate AS ts, CAST(CASE WHEN l_returnflag = 'R' THEN {PRICE} ELSE -{PRICE} END AS DECIMAL(12,2)) AS amount,
        {NARRATION} AS narration, profile AS account FROM {SALES} JOIN owned ON l_suppkey = s_suppkey WHERE profile IS NOT NULL),
      m AS (SELECT *, {MERCHANT} AS merchant FROM rows)
      SELECT *, {first_label(RULES)} AS category,
        sha256('bank|' || account || '|' || CAST(ts AS DATE) || '|' || amount || '|' || narration) AS dedupe_key FROM m""",
    "statement_normalize": f"""WITH {STATEMENT} SELECT CAST(day AS TIMESTAMP) AS ts, amount, narration, account, merchant,
        {first_label(RULES)} AS category, sha256('bank|' || account || '|' || day || '|' || amount || '|' || narration) AS dedupe_key FROM kept""",
    "amount_normalize": f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN {PRICE} ELSE -{PRICE} END AS single,
        CASE WHEN l_returnflag = 'R' THEN {PRICE} ELSE -{PRICE} END AS pair, CAST(NULL AS DECIMAL(12,2)) AS dotted,
        CASE WHEN l_returnflag <> 'R' THEN -{PRICE} END AS strict FROM {SALES}""",
    "chat_parse": f"""SELECT CAST(conv_id AS VARCHAR) AS chat, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS message_no,
        {CHAT_DAY} + to_minutes(CAST(turn AS INTEGER)) AS ts, role AS sender, text, false AS is_media FROM conversations""",
    "chat_warnings": """SELECT CAST(conv_id AS VARCHAR) AS path, day(DATE '1997-01-20' + CAST((conv_id % 2000) * 3 AS INTEGER)) <= 12 AS ambiguous_dates,
        false AS unrecognized, 0 AS unparseable FROM conversations GROUP BY conv_id""",
    "date_order_detect": """SELECT path, coalesce(arg_min(a > 12, o) FILTER (WHERE a > 12 OR b > 12), true) AS dayfirst,
        count(*) FILTER (WHERE a > 12 OR b > 12) = 0 AS ambiguous
      FROM (SELECT o_custkey AS path, o_orderkey AS o, CASE WHEN o_custkey % 2 = 1 THEN month(o_orderdate) ELSE day(o_orderdate) END AS a,
        CASE WHEN o_custkey % 2 = 1 THEN day(o_orderdate) ELSE month(o_orderdate) END AS b FROM orders) GROUP BY path""",
    "message_enrich": f"""WITH {MESSAGES} SELECT ts, chat, ' ' || upper(sender[1]) || sender[2:] AS sender, sender = 'user' AS is_me, text,
        CAST(len([w FOR w IN string_split_regex(text, '\\s+') IF w <> '']) AS INTEGER) AS word_count,
        sha256('whatsapp|' || chat || '|' || {STAMP} || '| ' || upper(sender[1]) || sender[2:] || '|' || text) AS dedupe_key FROM messages""",
    "merchant_extract": f"WITH {TX} SELECT dedupe_key, narration, {MERCHANT} AS merchant FROM tx",
    "categorize": f"WITH {ENRICHED} SELECT dedupe_key, ts, amount, merchant, category FROM enriched",
    "categorize_rule_table": BY_TABLE,
    "categorize_rule_join": BY_TABLE,
    "recategorize": f"WITH {ENRICHED} SELECT ts, amount, narration, account, dedupe_key, merchant, category FROM enriched",
    "recategorize_delta": f"""WITH {ENRICHED} SELECT ts, amount, narration, account, dedupe_key, merchant, category FROM enriched
      WHERE category IS DISTINCT FROM {first_label(OLD_RULES)}""",
    "natural_keys": KEY_OF_EVENTS.format(s=STAMP, ms=MS),
    "scalar_dates": """SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
        CAST(date_trunc('year', o_orderdate) AS DATE) AS year_start, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS utc_text,
        CAST(o_orderdate + INTERVAL 1530 MINUTE AS DATE) AS local_day, o_orderdate - INTERVAL 330 MINUTE AS local_midnight,
        CAST(o_orderdate AS DATE) AS parsed_dmy, CAST(strptime(strftime(o_orderdate, '%d-%b-%Y'), '%d-%b-%Y') AS DATE) AS parsed_mon,
        CAST(o_orderdate AS DATE) AS parsed_own, CAST(NULL AS DATE) AS parsed_bad, CAST(isodow(o_orderdate) AS INTEGER) AS weekday_no,
        CAST(o_orderdate AS DATE) - 365 AS year_back FROM orders""",
    "scalar_regex": """SELECT p_partkey, regexp_extract(p_name, '^([a-z]+) (b[a-z]+)$', 2) AS second, regexp_matches(p_name, 'bolt|rod') AS is_hardware,
        regexp_replace(p_brand, '[^0-9]', '', 'g') AS brand_no, nullif(upper(trim(regexp_extract(p_name, '^([a-h]+) ', 1))), '') AS first,
        coalesce(nullif(regexp_extract(p_name, '(ring|gear)', 1), ''), lower(p_type)) AS label, p_name ILIKE '%rod%' AS ilike_rod,
        p_name LIKE 'red%' AS starts_red FROM part""",
    "scalar_keys": """SELECT o_orderkey, sha256('a|' || o_custkey || '|' || coalesce(nullif(o_orderstatus, 'P'), '') || '|' || o_orderpriority) AS row_key,
        sha256(concat_ws('|', nullif(o_orderstatus, 'P'), o_orderpriority)) AS skipping_key FROM orders""",
    "scalar_numeric": """SELECT event_id, CAST(round(value) AS INTEGER) AS safe_int, TRY_CAST(event_type AS INTEGER) AS bad_int,
        TRY_CAST(props AS DOUBLE) AS bad_double, TRY_CAST(CAST(value AS VARCHAR) AS DECIMAL(12,2)) AS money, abs(-value) AS magnitude,
        round(value, 1) AS rounded, least(CASE WHEN value > 50 THEN value END, 100.0) AS least_known FROM events""",
    "scalar_nested": """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS calories, l[1].n AS first_metric, l[6].n AS no_metric,
        CAST(len([m FOR m IN l IF m.v > 50]) AS INTEGER) AS large_metrics
      FROM (SELECT *, [{'n': 'com.google.heart_minutes', 'v': value},
        {'n': 'com.google.Calories.expended', 'v': CAST(json_extract(props, '$.k') AS DOUBLE)}] AS l FROM events)""",
    "scalar_text": f"""SELECT doc_id, CAST(len(text) AS INTEGER) AS n, substr(text, 4) AS rest,
        CAST(len([w FOR w IN string_split_regex(text, '\\s+') IF w <> '']) AS INTEGER) AS words, lang || '_' || source AS label,
        (n_chars + 0.5) / 60.0 AS minutes, CAST(NULL AS DOUBLE) AS no_minutes, 'x ' || lang AS cleaned,
        CAST(len({tokens('text')}) AS INTEGER) AS tokens FROM documents""",
    "term_frequencies": f"WITH {TF} SELECT doc_id, term, CAST(tf AS INTEGER) AS tf, CAST(dl AS INTEGER) AS doc_len FROM tf JOIN dl USING (doc_id)",
    "corpus_statistics": f"WITH {TF} SELECT lang, count(*) AS n_docs, round(sum(dl) / count(*), 6) AS avgdl FROM dl GROUP BY lang",
    "bm25_idf": f"""WITH {TF} SELECT term, df, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 6) AS idf
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term)""",
    "bm25_topk": f"WITH {bm25(repr('all'), '3')} SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM hits",
    "multi_corpus_topk": f"WITH {bm25('lang', 'CASE corpus ' + ' '.join(f'WHEN {c!r} THEN {n}' for c, n in dict(en=3, fr=2, es=2, de=1).items()) + ' END')} SELECT * FROM hits",
    "topic_detect": topic(),
    "page_type_classify": f"""SELECT page_id, {page_type("(url || ' ' || html)", "'General'")} AS by_page, {page_type('url', HINT)} AS by_url FROM pages""",
    "tiered_rule_lookup": f"WITH {LOOKUP_RULES}, {tiers('part', 'p_name')} SELECT p_partkey, p_name, b.tier AS tier, b.rule_no AS rule_no FROM part LEFT JOIN best ON item = p_name",
    "rule_apply": f"""WITH {LOOKUP_RULES}, {tiers('part', 'p_name')}, f AS (SELECT p_partkey, p_name, b.tier AS tier, b.rule_no AS rule_no FROM part LEFT JOIN best ON item = p_name)
      SELECT f.*, coalesce(hi, 'Hero + Features + CTA') AS pattern, coalesce(lo || '|' || kind, 'Minimalism|Flat Design') AS style_priority,
        coalesce(kind, 'Professional') AS color_mood, coalesce(lo, 'Clean') AS typography_mood,
        CASE WHEN lo IS NULL THEN 'Subtle hover transitions' ELSE 'fade' END AS key_effects, coalesce(kind, '') AS anti_patterns,
        CASE WHEN lo IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CASE WHEN rule_no % 3 <> 2 THEN lo END AS must_have,
        CASE WHEN rule_no % 3 <> 2 THEN 1 ELSE 0 END AS decision_rules FROM f LEFT JOIN rules USING (rule_no)""",
    "priority_rerank": f"""WITH {bm25(repr('all'), '3')}, cand AS (SELECT query_id, rank, doc_id, source, lang, text,
        ['src' || (query_id % 20) || 'x', 'es', 'the'] AS ps FROM hits JOIN dl USING (doc_id)),
      scored AS (SELECT *, list_position([contains(source, p) OR contains(p, source) FOR p IN ps], true) AS m,
        list_sum([{RERANK_SCORE} FOR p IN ps]) AS s FROM cand)
      SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, CAST(s AS INTEGER) AS match_score FROM scored
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(nullif(m, 0), 1000000), s DESC, rank) = 1""",
    "recommend_batch": f"""WITH {bm25(CORPUS, '1')}, {SRC_RULES}, q AS (SELECT b.item_id AS query_id, b.text AS query_text, coalesce(d.source, 'General') AS category
        FROM benchmark b LEFT JOIN hits h ON h.query_id = b.item_id AND h.corpus = 'product' LEFT JOIN dl d ON d.doc_id = h.doc_id),
      {tiers('q', 'category')}, ruled AS (SELECT q.*, r.* FROM q LEFT JOIN best ON item = lower(category) LEFT JOIN rules r ON r.rule_no = b.rule_no)
      SELECT r.query_id, upper(replace(query_text, 'ß', 'ss')) AS project_name, category, coalesce(l.source, r.n_name, 'Hero + Features + CTA') AS pattern_name,
        coalesce('doc ' || l.doc_id, 'Hero > Features > CTA') AS pattern_sections,
        CASE WHEN l.doc_id IS NULL THEN 'Above fold' WHEN l.n_chars > 3000 THEN 'long ' || l.source ELSE '' END AS pattern_cta_placement,
        coalesce(l.lang, '') AS pattern_color_strategy, '' AS pattern_conversion,
        'Minimalism' AS style_name, 'General' AS style_type, '' AS style_effects, '' AS style_keywords, '' AS style_best_for,
        '' AS style_performance, '' AS style_accessibility, coalesce(c.source, '#2563EB') AS color_primary, '#3B82F6' AS color_secondary,
        '#F97316' AS color_cta, '#F8FAFC' AS color_background, '#1E293B' AS color_text, coalesce('doc ' || c.doc_id, '') AS color_notes,
        coalesce(t.source, 'Inter') AS font_heading, 'Inter' AS font_body,
        coalesce(t.lang, CASE WHEN rule_no IS NULL THEN 'Clean' ELSE 'Plain' END) AS font_mood, '' AS font_best_for, '' AS font_url, '' AS font_css,
        CASE WHEN rule_no IS NULL THEN 'Subtle hover transitions' ELSE 'fade' END AS key_effects, coalesce(n_name, '') AS anti_patterns,
        CASE WHEN rule_no IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS severity, CAST(n_regionkey AS VARCHAR) AS region
      FROM ruled r LEFT JOIN (SELECT h.query_id, d.* FROM hits h JOIN dl d USING (doc_id) WHERE corpus = 'landing') l ON l.query_id = r.query_id
      LEFT JOIN (SELECT h.query_id, d.* FROM hits h JOIN dl d USING (doc_id) WHERE corpus = 'color') c ON c.query_id = r.query_id
      LEFT JOIN (SELECT h.query_id, d.* FROM hits h JOIN dl d USING (doc_id) WHERE corpus = 'typography') t ON t.query_id = r.query_id""",
    "page_overrides": f"""WITH {bm25("CASE lang WHEN 'en' THEN 'style' WHEN 'es' THEN 'landing' ELSE 'ux' END", "CASE corpus WHEN 'ux' THEN 3 ELSE 1 END")},
      found AS (SELECT h.query_id, h.corpus, h.rank, d.source, d.doc_id,
        CASE WHEN n_chars > 3000 THEN 'long ' || d.source END AS effects FROM hits h JOIN dl d USING (doc_id)),
      ux AS (SELECT query_id, string_agg(CASE WHEN effects IS NOT NULL THEN source || ': ' || effects END, '|' ORDER BY rank) AS dos,
        string_agg('Avoid: doc ' || doc_id, '|' ORDER BY rank) AS avoid FROM found WHERE corpus = 'ux' GROUP BY query_id)
      SELECT b.item_id AS query_id, {page_type('b.text', "'General'")} AS page_type,
        CASE WHEN s.query_id IS NOT NULL THEN '1200px (standard)' WHEN l.query_id IS NULL THEN '1200px' END AS max_width,
        CASE WHEN s.query_id IS NOT NULL THEN 'Full-width sections, centered content' WHEN l.query_id IS NULL THEN 'Responsive grid' END AS layout,
        CAST(NULL AS VARCHAR) AS density, 'doc ' || l.doc_id AS sections, CASE WHEN l.query_id IS NOT NULL THEN 'es' END AS color_strategy,
        coalesce(nullif(concat_ws('|', 'Effects: ' || s.effects, dos, 'CTA Placement: ' || l.effects), ''),
          'Refer to MASTER.md for all design rules|Add specific overrides as needed for this page') AS recommendations,
        coalesce(avoid, '') AS components
      FROM benchmark b LEFT JOIN found s ON s.query_id = b.item_id AND s.corpus = 'style'
      LEFT JOIN found l ON l.query_id = b.item_id AND l.corpus = 'landing' LEFT JOIN ux ON ux.query_id = b.item_id""",
    "stream_insert_dedupe": f"""SELECT l_shipdate AS ts, {PRICE} AS amount, l_linestatus AS account,
        sha256('bank|' || l_orderkey || '|' || l_linenumber) AS dedupe_key FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_extendedprice, l_linestatus) = 1""",
    "stream_weekly_spend": f"""WITH r AS (SELECT l_shipdate AS ts, date_trunc('week', l_shipdate) AS w, {PRICE} AS price, {RECEIVED} AS y
        FROM lineitem WHERE l_returnflag <> 'R'),
      b AS (SELECT y, max(max(ts)) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        max(max(ts)) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS high FROM r GROUP BY y),
      k AS (SELECT *, coalesce(w + INTERVAL 7 DAY <= before - INTERVAL 14 DAY, false) AS late FROM r JOIN b USING (y))
      SELECT CAST(w AS DATE) AS week_start, CAST(sum(price) FILTER (NOT late) AS DECIMAL(18,2)) AS spend, count(*) FILTER (NOT late) AS n,
        CASE WHEN count(*) FILTER (NOT late) > 0 THEN w + INTERVAL 7 DAY > max(high) - INTERVAL 14 DAY END AS is_open,
        count(*) FILTER (late) AS late FROM k GROUP BY w""",
    "stream_dedupe_bounded": f"""SELECT DISTINCT l_shipdate AS ts, l_orderkey, l_linenumber, {PRICE} AS price, l_returnflag,
        sha256('bank|' || CAST(l_shipdate AS DATE) || '|' || l_orderkey || '|' || l_linenumber || '|' || {PRICE} || '|' || l_returnflag) AS dedupe_key
      FROM lineitem""",
}
