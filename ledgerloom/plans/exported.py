"""Queries of exports, imports and sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.classify import CSV_TYPES, OFX_CHECK, OFX_TYPES
from ledgerloom.operators import upsert
from ledgerloom.plans.registry import query
from ledgerloom.sinks import exports
from ledgerloom.sinks.exports import OFX_MEMO, OFX_NAME
from ledgerloom.sources.tables import table
from ledgerloom.streaming import sync


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "ledger_transactions").withColumn("direction", F.lower(F.trim("direction"))).withColumn("merchant", F.get_json_object("merchant", "$.name"))
    a = table(spark, folder, "accounts").select(F.col("id").alias("account_id"), "account_type", "account_number_masked")
    return t.join(a, "account_id")


def _statements(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "accounts").select(F.col("id").alias("account_id"), "institution", "account_type", "account_number_masked", "currency")
    return table(spark, folder, "statements").join(a, "account_id")


_TYPES = "".join("WHEN " + " OR ".join(f"contains(upper(description), '{w}')" for w in words) + f" THEN '{n}'\n" for n, words in CSV_TYPES)
_CELL = lambda c: f"""CASE WHEN contains(coalesce({c}, ''), ',') OR contains(coalesce({c}, ''), '"') OR regexp_matches(coalesce({c}, ''), '[\\r\\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE coalesce({c}, '') END"""


@query(f"""WITH r AS (SELECT t.*, lower(trim(t.direction)) AS d, json_extract_string(t.merchant, '$.name') AS m, a.account_type, a.account_number_masked FROM ledger_transactions t JOIN accounts a ON a.id = t.account_id)
SELECT id, concat_ws(',', strftime(date, '%Y-%m-%d'), coalesce(strftime(posted_date, '%Y-%m-%d'), ''), {_CELL('description')}, {_CELL('m')}, CAST(CASE WHEN d = 'credit' OR amount = 0 THEN abs(amount) ELSE -abs(amount) END AS VARCHAR), d,
CASE WHEN contains(upper(description), 'CHECK') AND regexp_matches(description, '[0-9]') THEN 'Check' {_TYPES} WHEN d = 'credit' THEN 'Credit' ELSE 'Debit' END, account_type, account_number_masked, {_CELL('category')}, {_CELL('subcategory')}, coalesce(CAST(CAST(floor(confidence * 100 + 0.5::DOUBLE) / 100 AS DECIMAL(6,2)) AS VARCHAR), '')) AS line FROM r""")
def csv_lines(spark: SparkSession, folder: str) -> DataFrame:
    return exports.csv_lines(_rows(spark, folder)).select("id", "line")


_OFX_WORDS = "".join("WHEN " + " OR ".join(f"contains(u, '{w}')" for w in words) + f" THEN '{n}'\n" for n, words in OFX_TYPES)
_XML = lambda c, n: f"""substr(regexp_replace(replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;'), '[^\\x20-\\x7E]', '?', 'g'), 1, {n})"""


@query(f"""WITH l AS (SELECT t.*, upper(t.description) AS u, lower(trim(t.direction)) AS d, json_extract_string(t.merchant, '$.name') AS m FROM ledger_transactions t JOIN accounts a ON a.id = t.account_id WHERE t.statement_db_id IS NOT NULL),
k AS (SELECT *, coalesce(nullif(regexp_extract(u, '{OFX_CHECK}', 1), ''), nullif(regexp_extract(u, '{OFX_CHECK}', 2), '')) AS num FROM l),
y AS (SELECT *, CASE WHEN num IS NOT NULL THEN 'CHECK' {_OFX_WORDS} WHEN d = 'credit' THEN 'CREDIT' ELSE 'DEBIT' END AS kind FROM k),
x AS (SELECT statement_db_id, date, id, '<STMTTRN>' || chr(10) || '<TRNTYPE>' || CASE WHEN kind = 'FEE' AND d <> 'debit' THEN 'CREDIT' ELSE kind END || '</TRNTYPE>' || chr(10) || '<DTPOSTED>' || strftime(coalesce(posted_date, date), '%Y%m%d') || '</DTPOSTED>' || chr(10)
  || '<TRNAMT>' || CAST(CASE WHEN d = 'credit' OR amount = 0 THEN abs(amount) ELSE -abs(amount) END AS VARCHAR) || '</TRNAMT>' || chr(10) || '<FITID>' || id || '</FITID>' || chr(10) || coalesce('<CHECKNUM>' || num || '</CHECKNUM>' || chr(10), '')
  || '<NAME>' || {_XML("CASE WHEN coalesce(m, '') <> '' THEN m ELSE description END", OFX_NAME)} || '</NAME>' || chr(10) || '<MEMO>' || {_XML('description', OFX_MEMO)} || '</MEMO>' || chr(10) || '</STMTTRN>' AS t FROM y),
b AS (SELECT statement_db_id, string_agg(t, chr(10) ORDER BY date, id) AS list FROM x GROUP BY 1)
SELECT s.account_id, s.id AS statement_id, s.period_end, '<STMTRS>' || chr(10) || '<CURDEF>' || coalesce(a.currency, 'USD') || '</CURDEF>' || chr(10) || '<BANKACCTFROM><ACCTID>' || replace(a.account_number_masked, '*', '0') || '</ACCTID><ACCTTYPE>'
  || CASE lower(a.account_type) WHEN 'savings' THEN 'SAVINGS' WHEN 'credit' THEN 'CREDITLINE' ELSE 'CHECKING' END || '</ACCTTYPE></BANKACCTFROM>' || chr(10) || '<BANKTRANLIST><DTSTART>' || strftime(s.period_start, '%Y%m%d') || '</DTSTART><DTEND>' || strftime(s.period_end, '%Y%m%d') || '</DTEND>' || chr(10)
  || b.list || chr(10) || '</BANKTRANLIST>' || chr(10) || '<LEDGERBAL><BALAMT>' || CAST(coalesce(s.ending_balance, 0)::DECIMAL(14,2) AS VARCHAR) || '</BALAMT><DTASOF>' || strftime(s.period_end, '%Y%m%d') || '</DTASOF></LEDGERBAL>' || chr(10) || '</STMTRS>' AS block
FROM statements s JOIN accounts a ON a.id = s.account_id JOIN b ON b.statement_db_id = s.id""")
def ofx_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return exports.ofx_blocks(_rows(spark, folder), _statements(spark, folder))


_OBJECT = lambda pairs: "'{' || array_to_string(list_filter([" + ", ".join(f"""CASE WHEN {v} IS NOT NULL THEN '"{k}":' || {t} END""" for k, v, t in pairs) + "], lambda x: x IS NOT NULL), ',') || '}'"
_TEXT = lambda k, v: (k, v, f"CAST(to_json({v}) AS VARCHAR)")
_PLAIN = lambda k, v: (k, v, f"CAST({v} AS VARCHAR)")
_V1_ROW = _OBJECT([_TEXT("date", "CAST(t.date AS VARCHAR)"), _TEXT("id", "t.id"), _TEXT("posted_date", "CAST(t.posted_date AS VARCHAR)"), _TEXT("description", "t.description"), _TEXT("merchant", "json_extract_string(t.merchant, '$.name')"), _PLAIN("amount", "t.amount"),
                   _TEXT("direction", "lower(trim(t.direction))"), _TEXT("category", "t.category"), _TEXT("subcategory", "t.subcategory"), ("confidence", "t.confidence", """CASE WHEN isnan(t.confidence) THEN '"NaN"' ELSE CAST(to_json(t.confidence) AS VARCHAR) END""")])
_V1 = _OBJECT([("schemaVersion", "'v1'", """'"v1"'"""), ("account", "a.id", _OBJECT([_TEXT(c, f"a.{c}") for c in ("institution", "account_type", "account_number_masked", "currency")])), ("period", "s.id", _OBJECT([_TEXT(c, f"CAST(s.{c} AS VARCHAR)") for c in ("period_start", "period_end")])),
               ("summary", "s.id", _OBJECT([_PLAIN(c, f"s.{c}") for c in ("starting_balance", "ending_balance", "total_credits", "total_debits")])), ("transactions", "s.id", "'[' || coalesce(r.list, '') || ']'")])


@query(f"""WITH r AS (SELECT t.statement_db_id, string_agg({_V1_ROW}, ',' ORDER BY t.date, t.id) AS list FROM ledger_transactions t JOIN accounts b ON b.id = t.account_id WHERE t.statement_db_id IS NOT NULL GROUP BY 1)
SELECT s.id AS key, {_V1} AS document FROM statements s JOIN accounts a ON a.id = s.account_id LEFT JOIN r ON r.statement_db_id = s.id""")
def json_statements_v1(spark: SparkSession, folder: str) -> DataFrame:
    return exports.nested(_statements(spark, folder), _rows(spark, folder), "v1")


_JSON = lambda pairs: "'{' || " + " || ',' || ".join(f"""'"{k}":' || coalesce(CAST(to_json({v}) AS VARCHAR), 'null')""" for k, v in pairs) + " || '}'"
_HEAD = [("schemaVersion", "'v2'"), *[(c, c) for c in ("institution", "account_type", "account_number_masked", "currency")], ("start", "CAST(period_a AS VARCHAR)"), ("end", "CAST(period_b AS VARCHAR)"), *[(c, c) for c in ("startingBalance", "endingBalance", "totalCredits", "totalDebits", "totalStatements", "totalTransactions")]]
_ITEM = [("transactionId", "id"), ("statementId", "statement_db_id"), ("date", "CAST(date AS VARCHAR)"), ("postedDate", "CAST(posted_date AS VARCHAR)"), ("description", "description"), ("merchant", "json_extract_string(merchant, '$.name')"), ("amount", "CAST(amount AS DOUBLE)"),
         ("direction", "lower(trim(direction))"), ("category", "category"), ("subcategory", "subcategory"), ("confidence", "CASE WHEN isnan(confidence) THEN NULL ELSE confidence END")]


@query(f"""WITH n AS (SELECT account_id, count(*) AS totalTransactions FROM ledger_transactions GROUP BY 1),
s AS (SELECT account_id, min(period_start) AS period_a, max(period_end) AS period_b, CAST(arg_min_null(starting_balance, (period_start, id)) AS DOUBLE) AS startingBalance, CAST(arg_max_null(ending_balance, (period_start, id)) AS DOUBLE) AS endingBalance,
  CAST(sum(total_credits) AS DOUBLE) AS totalCredits, CAST(sum(total_debits) AS DOUBLE) AS totalDebits, count(*) AS totalStatements FROM statements GROUP BY 1),
x AS (SELECT coalesce(s.account_id, n.account_id) AS account_id, CASE WHEN s.account_id IS NOT NULL THEN a.institution END AS institution, CASE WHEN s.account_id IS NOT NULL THEN a.account_type END AS account_type, CASE WHEN s.account_id IS NOT NULL THEN a.account_number_masked END AS account_number_masked,
  CASE WHEN s.account_id IS NOT NULL THEN a.currency END AS currency, period_a, period_b, startingBalance, endingBalance, totalCredits, totalDebits, coalesce(totalStatements, 0) AS totalStatements, coalesce(totalTransactions, 0) AS totalTransactions
  FROM s FULL JOIN n ON n.account_id = s.account_id LEFT JOIN accounts a ON a.id = coalesce(s.account_id, n.account_id))
SELECT account_id, NULL::DATE AS date, NULL AS id, {_JSON(_HEAD)} AS line FROM x UNION ALL SELECT account_id, date, id, {_JSON(_ITEM)} FROM ledger_transactions""")
def json_accounts_v2(spark: SparkSession, folder: str) -> DataFrame:
    """Every account as JSON lines: what it is, then its rows, those without a statement too."""
    return exports.account_lines(_statements(spark, folder), _rows(spark, folder))


@query("""WITH late AS (SELECT * FROM plaid_transactions WHERE synced_at >= TIMESTAMP '2025-01-01'), early AS (SELECT DISTINCT transaction_id FROM plaid_transactions WHERE synced_at < TIMESTAMP '2025-01-01')
SELECT feed_seq, transaction_id FROM late WHERE transaction_id NOT IN (SELECT transaction_id FROM early)""")
def upsert_new_rows_anti(spark: SparkSession, folder: str) -> DataFrame:
    """Feed rows delivered from 2025 on whose id was not delivered before."""
    feed = table(spark, folder, "plaid_transactions")
    cut = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return upsert.new_rows(feed.where(F.col("synced_at") >= cut), feed.where(F.col("synced_at") < cut), ["transaction_id"]).select("feed_seq", "transaction_id")


@query("""SELECT transaction_id, max(feed_seq) AS feed_seq, arg_max(pending, feed_seq) AS pending, transaction_id IN (SELECT pending_transaction_id FROM plaid_transactions WHERE pending_transaction_id IS NOT NULL) AS superseded FROM plaid_transactions GROUP BY 1""")
def sync_final_state(spark: SparkSession, folder: str) -> DataFrame:
    """Each feed id as it was delivered last, and whether a posted row has taken its place."""
    feed = table(spark, folder, "plaid_transactions")
    last = feed.groupBy("transaction_id").agg(F.max("feed_seq").alias("feed_seq"), F.max_by("pending", "feed_seq").alias("pending"))
    named = feed.where("pending_transaction_id is not null").select(F.col("pending_transaction_id").alias("transaction_id")).distinct().withColumn("superseded", F.lit(True))
    return last.join(named, "transaction_id", "left").fillna(False, ["superseded"])


@query("""SELECT user_id AS item_id, arg_max(CASE event_type WHEN 'error' THEN 'error' ELSE 'active' END, (ts, event_type)) AS status, max(ts) AS since FROM events GROUP BY 1""")
def item_status_fold(spark: SparkSession, folder: str) -> DataFrame:
    """The last known state of each item from the event stream's table."""
    kind = F.when(F.col("event_type") == "error", "error").otherwise("sync_updates")
    e = table(spark, folder, "events").select(F.col("user_id").alias("item_id"), kind.alias("kind"), F.col("ts").alias("at"), "event_type")
    states = sync.item_states(e.select("item_id", "kind", "at"))
    return states


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("ts", F.col("event_type").alias("kind"), "value", F.col("ts").alias("at"))
    w = sync.windowed_counts(e)
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "kind", "events", F.round("total", 6).alias("total"))
