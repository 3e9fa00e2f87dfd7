"""Queries of normalization, rules and combined reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import classify
from ledgerloom.functions.category_rules import RULES, entries
from ledgerloom.operators import analytics, normalize
from ledgerloom.plans import reports
from ledgerloom.plans.classified import EVEN, _channel_sql, _older_sql, _q, _rules_sql
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import table


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows as a statement prints them: its section and whether it is a card's."""
    t = table(spark, folder, "ledger_transactions").withColumn("section", F.get_json_object("raw", "$.section"))
    cards = table(spark, folder, "accounts").select(F.col("id").alias("account_id"), (F.lower("account_type") == "credit").alias("credit_card"))
    return t.join(cards, "account_id").select("id", F.col("statement_db_id").alias("statement"), "date", "amount", "description", "section", "credit_card")


_ROWS = "b AS (SELECT t.id, t.statement_db_id AS statement, t.date, t.amount, t.description, json_extract_string(t.raw, '$.section') AS section, lower(a.account_type) = 'credit' AS card FROM ledger_transactions t JOIN accounts a ON a.id = t.account_id)"
_TIDY_ROW = r"regexp_replace(regexp_replace(regexp_replace(description, '[\s\p{Z}]+\d{17,25}$', ''), '[\s\p{Z}]{2,}', ' ', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_SUBSCRIBED = f"regexp_matches(description, {_q('(?i)' + '|'.join(normalize.SUBSCRIPTIONS))})"
_KNOWN = "CASE section " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in normalize.SECTIONS.items()) + " END"


def _channels_with_sections() -> str:
    cases = "".join(f"WHEN regexp_matches(t, {_q('(?i)' + p)})" + (f" OR section = '{s}'" if s else "") + f" THEN {_q(kind)}\n" for kind, _, p, s in classify.CHANNELS)
    return f"(SELECT id, CASE {cases} ELSE 'OTHER' END AS channel FROM (SELECT id, section, trim({EVEN}) AS t FROM b))"


def _gated_sql(text: str, source: str) -> str:
    """The rules with each line's channel; source has id, description and channel."""
    rules = sorted(entries(RULES, 8), key=lambda r: int(r[1]))
    only = lambda r: f" AND channel IN ({', '.join(map(_q, r[7].split()))})" if r[7] else ""
    cases = "".join(f"WHEN regexp_matches(t, {_q(r[5])})" + (f" AND NOT regexp_matches(t, {_q(r[6])})" if r[6] else "") + only(r) + f" THEN {i}\n" for i, r in enumerate(rules))
    rows = ", ".join(f"({i}, {_q(r[2])}, {_q(r[3])}, {float(r[4])}, {_q(r[0])})" for i, r in enumerate(rules))
    return f"""(SELECT p.id, coalesce(r.category, 'Uncategorized') AS category, r.subcategory, coalesce(CAST(r.confidence AS DOUBLE), 0.5::DOUBLE) AS confidence, r.rule_id
FROM (SELECT id, CASE {cases} END AS i FROM (SELECT id, channel, lower(trim({text})) AS t FROM {source})) p LEFT JOIN (VALUES {rows}) r(i, category, subcategory, confidence, rule_id) ON r.i = p.i)"""


_STRIPPED = r"regexp_replace(trim(regexp_replace(description, '[\s\p{Z}]+\d{17,25}$', '')), '[\p{Z}\t]', ' ', 'g')"


@query(f"""WITH {_ROWS}, c AS {_channels_with_sections()}, x AS (SELECT b.*, c.channel FROM b JOIN c ON c.id = b.id), g AS {_gated_sql(_STRIPPED, 'x')},
d AS (SELECT *, CASE WHEN card THEN CASE WHEN amount >= 0 THEN 'debit' ELSE 'credit' END WHEN section IN ('atm_debit', 'other_subtractions', 'checks', 'service_fees') THEN 'debit' WHEN section = 'deposits' THEN 'credit' WHEN amount >= 0 THEN 'credit' ELSE 'debit' END AS direction, {_TIDY_ROW} AS tidy FROM x),
e AS (SELECT *, CASE WHEN direction = 'debit' THEN -abs(amount) ELSE abs(amount) END AS signed FROM d)
SELECT e.id, e.date, CAST(signed AS DOUBLE) AS amount, direction, tidy AS description, {_KNOWN} AS section,
substr(sha256(coalesce(statement, '') || '|' || date || '|' || regexp_replace(regexp_replace(CAST(signed AS VARCHAR), '0+$', ''), '\\.$', '') || '|' || tidy), 1, 32) AS row_key, channel, g.category, g.subcategory, g.confidence, g.rule_id,
CASE WHEN g.rule_id IS NULL THEN 'No matching rule found' ELSE 'Matched rule: ' || g.rule_id END AS rationale, channel IN ('ZELLE', 'ONLINE_BANKING_TRANSFER') AS is_transfer, channel = 'ATM_WITHDRAWAL' AS is_cash_withdrawal,
channel IN ('ATM_DEPOSIT', 'FINANCIAL_CENTER_DEPOSIT') AS is_cash_deposit, {_SUBSCRIBED} AS is_subscription, {_SUBSCRIBED} AS is_recurring FROM e JOIN g ON g.id = e.id""")
def normalized_rows(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.normalized(_rows(spark, folder))


@query(f"""WITH {_ROWS}, c AS ({_older_sql()}) SELECT b.id, b.date, CAST(CASE WHEN (amount >= 0) = card THEN -abs(amount) ELSE abs(amount) END AS DOUBLE) AS amount, CASE WHEN (amount >= 0) = card THEN 'debit' ELSE 'credit' END AS direction, b.description,
CASE WHEN section = 'fees' THEN 'Fees' ELSE c.category END AS category, CASE WHEN section = 'fees' THEN 'Bank' ELSE c.subcategory END AS subcategory, CASE WHEN section = 'fees' THEN 0.95::DOUBLE ELSE c.confidence END AS confidence FROM b JOIN c ON c.id = b.id""")
def normalized_flat(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.flat(_rows(spark, folder))


@query(f"""WITH c AS ({_channel_sql()}) SELECT t.id, c.channel IN ('ZELLE', 'ONLINE_BANKING_TRANSFER') AS is_transfer, c.channel = 'ATM_WITHDRAWAL' AS is_cash_withdrawal, c.channel IN ('ATM_DEPOSIT', 'FINANCIAL_CENTER_DEPOSIT') AS is_cash_deposit,
{_SUBSCRIBED} AS is_subscription, {_SUBSCRIBED} AS is_recurring FROM ledger_transactions t JOIN c ON c.id = t.id""")
def transaction_flags(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "ledger_transactions").select("id", "description", classify.channel(F.col("description"))["type"].alias("channel"))
    return t.select("id", *[v.alias(k) for k, v in normalize.flags(F.col("channel"), F.col("description")).items()])


_PLAIN = lambda x: f"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(14,2)) AS VARCHAR), '0+$', ''), '\\.$', '')"


@query(f"""WITH s AS (SELECT t.*, a.account_number_masked AS m, coalesce(starting_balance, 0) AS sb, coalesce(ending_balance, 0) AS eb, coalesce(starting_balance, 0) + coalesce(total_credits, 0) - abs(coalesce(total_debits, 0)) AS k FROM statements t JOIN accounts a ON a.id = t.account_id)
SELECT id, 'STRICT: Account number could not be verified' AS warning FROM s WHERE m = '****0000' UNION ALL SELECT id, 'STRICT: Both starting and ending balances are zero' FROM s WHERE sb = 0 AND eb = 0
UNION ALL SELECT id, 'STRICT: No transactions were parsed' FROM s WHERE coalesce(transaction_count, 0) = 0 UNION ALL SELECT id, 'STRICT: Balance mismatch - calculated ' || {_PLAIN('k')} || ', reported ' || {_PLAIN('eb')} FROM s WHERE abs(k - eb) > 0.01""")
def strict_warnings(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "accounts").select(F.col("id").alias("account_id"), "account_number_masked")
    return normalize.strict_warnings(table(spark, folder, "statements").join(a, "account_id"))


_TYPES = "".join("WHEN " + " OR ".join([*(f"contains(u, '{w}')" for w in words), *([r"regexp_matches(u, 'check\s+\d+')"] if n == "Check" else [])]) + f" THEN '{n}' " for n, words in normalize.DETAIL_WORDS)


@query(f"""WITH k AS (SELECT id, amount, CASE {_TYPES} ELSE 'Other' END AS detail_type FROM (SELECT id, amount, lower(description) AS u FROM ledger_transactions))
SELECT id, detail_type, CASE WHEN detail_type = 'Bank Charge' THEN 'fees' WHEN detail_type = 'Check' THEN 'checks' WHEN detail_type = 'Deposit' OR detail_type = 'Transfer' AND amount >= 0 THEN 'deposits' WHEN amount < 0 THEN 'withdrawals' ELSE 'other' END AS section FROM k""")
def details_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Kind and section of each line as of an activity list that names neither."""
    t = table(spark, folder, "ledger_transactions").select("id", "amount", normalize.detail_type(F.col("description")).alias("detail_type"))
    return t.select("id", "detail_type", normalize.detail_section(F.col("detail_type"), F.col("amount")).alias("section"))


_RULES_TABLE = ", ".join(f"({_q(r[0])}, {int(r[1])}, {_q(r[2])}, {_q(r[3])}, {float(r[4])}, {_q(r[5])}, {_q(r[6]) if r[6] else 'NULL'}, {_q(r[7]) if r[7] else 'NULL'})" for r in entries(RULES, 8))


@query(f"SELECT rule_id, CAST(priority AS INT) AS priority, category, subcategory, CAST(confidence AS DOUBLE) AS confidence, pattern, exclusion, channels FROM (VALUES {_RULES_TABLE}) r(rule_id, priority, category, subcategory, confidence, pattern, exclusion, channels)")
def category_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The rules as a table, to look one up by its id or all of a category."""
    return classify.rules_table(spark)


@query(f"WITH c AS ({_rules_sql()}) SELECT id, category, rule_id, CASE WHEN rule_id IS NULL THEN 'No matching rule found' ELSE 'Matched rule: ' || rule_id END AS rationale FROM c")
def categorize_rationale(spark: SparkSession, folder: str) -> DataFrame:
    c = classify.with_category(table(spark, folder, "ledger_transactions").select("id", "description"), "description")
    return c.select("id", "category", "rule_id", normalize.rationale(F.col("rule_id")).alias("rationale"))


@query(f"""WITH c AS ({_channel_sql()}), x AS (SELECT l.id, l.description, c.channel FROM ledger_transactions l JOIN c ON c.id = l.id) SELECT g.*, x.channel AS channel_type FROM {_gated_sql(EVEN, 'x')} g JOIN x ON x.id = g.id""")
def categorize_by_channel(spark: SparkSession, folder: str) -> DataFrame:
    """The rules with each line's channel, which then restricts them."""
    t = table(spark, folder, "ledger_transactions").withColumn("channel_type", classify.channel(F.col("description"))["type"])
    return classify.with_category(t.select("id", "description", "channel_type"), "description", "channel_type").drop("description")


@query("""SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY date, id) AS place FROM ledger_transactions""")
def transactions_by_category(spark: SparkSession, folder: str) -> DataFrame:
    """Every row under its category, with its place there by day and id; no category's rows are gathered.

    Days are counted first and each day ordered by itself, so no task orders a category.
    """
    return analytics.places(table(spark, folder, "ledger_transactions").select("id", "category", "date"), "category", "date", "id")


@query(f"""WITH {reports.FLOWS}, {reports.STREAK},
q AS (SELECT owner, 'quarterly_cash_flow' AS report, year(date) || '-Q' || quarter(date) AS item, CAST(sum(income) - sum(expense) AS DOUBLE) AS value FROM f WHERE NOT transfer GROUP BY 1, 2, 3),
i AS (SELECT owner, 'income_vs_expenses' AS report, item, value FROM (SELECT owner, unnest([{{'item': 'total_income', 'value': CAST(sum(income) AS DOUBLE)}}, {{'item': 'total_expenses', 'value': CAST(sum(expense) AS DOUBLE)}}, {{'item': 'net_income', 'value': CAST(sum(income) - sum(expense) AS DOUBLE)}}], recursive := true) FROM f GROUP BY 1))
SELECT * FROM q UNION ALL SELECT owner, report, item, value FROM i UNION ALL SELECT owner, 'lender_summary', 'consecutive_months', CAST(months AS DOUBLE) FROM streak""".replace(f"{reports.STREAK},", reports.STREAK.replace("\ni AS", "\nisl AS").replace("FROM i GROUP", "FROM isl GROUP") + ","))
def all_analytics(spark: SparkSession, folder: str) -> DataFrame:
    """The reports of each owner side by side: (owner, report, item, value)."""
    return analytics.combined(reports.owned(spark, folder))
