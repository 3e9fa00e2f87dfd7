"""The seven ledger views and the filtered queries over them.

Readers take a user where tenants matter; Catalyst inlines the views and pushes the predicates down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import table

MISSING_CATEGORIES = ("", "n/a", "unknown", "uncategorized")
REVIEW_BELOW = 0.7
DEFAULT_PAGE = 100


# ---- views ----


def overrides_of(ledger: DataFrame) -> DataFrame:
    """One override for each row whose category is missing and whose rule is known; stands in for a table of human overrides."""
    missing = F.col("category").isNull() | F.lower(F.trim("category")).isin(*MISSING_CATEGORIES)
    return ledger.where(missing & F.col("rule_id").isNotNull()).select(
        F.col("id").alias("transaction_db_id"),
        F.initcap(F.split_part("rule_id", F.lit("-"), F.lit(1))).alias("category"),
        F.lit(None).cast("string").alias("subcategory"),
        F.lit(None).cast("string").alias("merchant_normalized_name"),
        F.lit("rule").alias("source"),
        F.col("rule_id").alias("notes"),
    )


def effective(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """Ledger rows with overrides laid over them; a null field of an override lets the row's own value through."""
    o = overrides.select(
        "transaction_db_id",
        F.col("category").alias("o_category"),
        F.col("subcategory").alias("o_subcategory"),
        F.col("merchant_normalized_name").alias("o_merchant"),
        F.col("source").alias("override_source"),
        F.col("notes").alias("override_notes"),
    )
    return (
        ledger.join(o, ledger["id"] == o["transaction_db_id"], "left")
        .withColumn("effective_category", F.coalesce("o_category", "category"))
        .withColumn("effective_subcategory", F.coalesce("o_subcategory", "subcategory"))
        .withColumn("effective_merchant", F.coalesce("o_merchant", F.get_json_object("merchant", "$.normalizedName")))
        .drop("transaction_db_id", "o_category", "o_subcategory", "o_merchant")
    )


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ledger_transactions")


def _effective(spark: SparkSession, folder: str) -> DataFrame:
    t = _ledger(spark, folder)
    return effective(t, overrides_of(t))


def monthly_totals(eff: DataFrame) -> DataFrame:
    a = F.col("amount")
    return eff.groupBy("user_id", F.trunc("date", "month").alias("month"), "effective_category").agg(
        F.sum(F.when(a < 0, a).otherwise(F.lit(0))).cast("double").alias("total_debits"),
        F.sum(F.when(a > 0, a).otherwise(F.lit(0))).cast("double").alias("total_credits"),
        F.sum(a).cast("double").alias("net_amount"),
        F.count("*").alias("transaction_count"),
    )


def merchant_totals(eff: DataFrame) -> DataFrame:
    spent = F.when(F.col("amount") < 0, F.abs("amount"))
    return (
        eff.where("effective_merchant is not null")
        .groupBy("user_id", "effective_merchant", "effective_category")
        .agg(
            F.count("*").alias("transaction_count"),
            F.coalesce(F.sum(spent), F.lit(0)).cast("double").alias("total_spent"),
            F.round(F.sum(spent).cast("double") / F.count(spent), 6).alias("avg_transaction"),
            F.min("date").alias("first_seen"),
            F.max("date").alias("last_seen"),
        )
    )


def summaries(accounts: DataFrame, statements: DataFrame, ledger: DataFrame) -> DataFrame:
    """A row per account; both sides are aggregated before they are joined, so nothing fans out."""
    s = statements.groupBy("account_id").agg(
        F.count("*").alias("statement_count"),
        F.min("period_start").alias("earliest_period"),
        F.max("period_end").alias("latest_period"),
        F.max_by("ending_balance", F.struct("period_end", "id")).cast("double").alias("latest_balance"),
    )
    t = ledger.groupBy("account_id").agg(F.count("*").alias("transaction_count"))
    out = accounts.withColumnRenamed("id", "account_id").join(s, "account_id", "left").join(t, "account_id", "left")
    return out.fillna(0, ["statement_count", "transaction_count"]).select(
        "account_id", "user_id", "institution", "account_type", "account_number_masked", "currency",
        "statement_count", "transaction_count", "earliest_period", "latest_period", "latest_balance",
    )


def running_balances(ledger: DataFrame) -> DataFrame:
    """Daily net and running balance; days are summed before the window, which then holds a row per day."""
    days = ledger.groupBy("user_id", "account_id", "date").agg(F.sum("amount").alias("net"), F.count("*").alias("transaction_count"))
    w = Window.partitionBy("user_id", "account_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("running_balance", F.sum("net").over(w).cast("double")).withColumn("daily_net", F.col("net").cast("double")).drop("net")


EFFECTIVE = """
o AS (SELECT id AS tid, upper(substr(split_part(rule_id, '-', 1), 1, 1)) || lower(substr(split_part(rule_id, '-', 1), 2)) AS o_category, rule_id FROM ledger_transactions
  WHERE rule_id IS NOT NULL AND (category IS NULL OR lower(trim(category)) IN ('', 'n/a', 'unknown', 'uncategorized'))),
eff AS (SELECT t.*, coalesce(o.o_category, t.category) AS effective_category, t.subcategory AS effective_subcategory,
  json_extract_string(t.merchant, '$.normalizedName') AS effective_merchant, CASE WHEN o.tid IS NOT NULL THEN 'rule' END AS override_source, o.rule_id AS override_notes
  FROM ledger_transactions t LEFT JOIN o ON o.tid = t.id)
"""
_EFF_COLUMNS = "id, user_id, account_id, date, CAST(amount AS DOUBLE) AS amount, confidence, effective_category, effective_subcategory, effective_merchant, override_source, override_notes"


def _plain(eff: DataFrame) -> DataFrame:
    return eff.select("id", "user_id", "account_id", "date", F.col("amount").cast("double").alias("amount"), "confidence", "effective_category", "effective_subcategory", "effective_merchant", "override_source", "override_notes")


@query(f"WITH {EFFECTIVE} SELECT {_EFF_COLUMNS} FROM eff")
def transactions_effective(spark: SparkSession, folder: str) -> DataFrame:
    return _plain(_effective(spark, folder))


@query(f"""WITH {EFFECTIVE} SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, effective_category,
CAST(sum(CASE WHEN amount < 0 THEN amount ELSE 0 END) AS DOUBLE) AS total_debits, CAST(sum(CASE WHEN amount > 0 THEN amount ELSE 0 END) AS DOUBLE) AS total_credits,
CAST(sum(amount) AS DOUBLE) AS net_amount, count(*) AS transaction_count FROM eff GROUP BY 1, 2, 3""")
def monthly_category_totals(spark: SparkSession, folder: str) -> DataFrame:
    return monthly_totals(_effective(spark, folder))


@query("""SELECT a.id AS account_id, a.user_id, a.institution, a.account_type, a.account_number_masked, a.currency,
coalesce(s.n, 0) AS statement_count, coalesce(t.n, 0) AS transaction_count, s.a AS earliest_period, s.b AS latest_period, s.bal AS latest_balance FROM accounts a
LEFT JOIN (SELECT account_id, count(*) AS n, min(period_start) AS a, max(period_end) AS b, CAST(arg_max_null(ending_balance, (period_end, id)) AS DOUBLE) AS bal FROM statements GROUP BY 1) s ON s.account_id = a.id
LEFT JOIN (SELECT account_id, count(*) AS n FROM ledger_transactions GROUP BY 1) t ON t.account_id = a.id""")
def account_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summaries(table(spark, folder, "accounts"), table(spark, folder, "statements"), _ledger(spark, folder))


@query(f"""WITH {EFFECTIVE} SELECT user_id, effective_merchant, effective_category, count(*) AS transaction_count,
CAST(sum(CASE WHEN amount < 0 THEN abs(amount) ELSE 0 END) AS DOUBLE) AS total_spent,
round(CAST(sum(CASE WHEN amount < 0 THEN abs(amount) END) AS DOUBLE) / count(CASE WHEN amount < 0 THEN 1 END), 6) AS avg_transaction,
min(date) AS first_seen, max(date) AS last_seen FROM eff WHERE effective_merchant IS NOT NULL GROUP BY 1, 2, 3""")
def merchant_spending(spark: SparkSession, folder: str) -> DataFrame:
    return merchant_totals(_effective(spark, folder))


@query("""SELECT user_id, account_id, date, CAST(sum(amount) AS DOUBLE) AS daily_net,
CAST(sum(sum(amount)) OVER (PARTITION BY user_id, account_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_balance, count(*) AS transaction_count
FROM ledger_transactions GROUP BY 1, 2, 3""")
def daily_balance(spark: SparkSession, folder: str) -> DataFrame:
    return running_balances(_ledger(spark, folder)).select("user_id", "account_id", "date", "daily_net", "running_balance", "transaction_count")


@query("""SELECT pr.id AS parse_run_id, pr.user_id, pr.parser_version, pr.schema_version, pr.status, s.file_name, s.provider,
CAST(json_array_length(pr.warnings) AS INTEGER) AS warning_count, coalesce(n.n, 0) AS runs_of_source FROM parse_runs pr LEFT JOIN sources s ON s.id = pr.source_id
LEFT JOIN (SELECT source_id, count(*) AS n FROM parse_runs GROUP BY 1) n ON n.source_id = pr.source_id""")
def parse_run_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Runs with their file, warnings and, for want of a table of linked statements, the runs of the same source."""
    runs, sources = table(spark, folder, "parse_runs"), table(spark, folder, "sources")
    counts = runs.groupBy("source_id").agg(F.count("*").alias("runs_of_source"))
    s = sources.select(F.col("id").alias("source_id"), "file_name", "provider")
    out = runs.join(s, "source_id", "left").join(counts, "source_id", "left").fillna(0, ["runs_of_source"])
    return out.select(F.col("id").alias("parse_run_id"), "user_id", "parser_version", "schema_version", "status", "file_name", "provider", F.json_array_length("warnings").alias("warning_count"), "runs_of_source")


@query(f"WITH {EFFECTIVE} SELECT {_EFF_COLUMNS} FROM eff WHERE effective_category IS NULL OR effective_category = 'Uncategorized' OR confidence < 0.7::DOUBLE")
def transactions_needing_review(spark: SparkSession, folder: str) -> DataFrame:
    eff = _effective(spark, folder)
    return _plain(eff.where(F.col("effective_category").isNull() | (F.col("effective_category") == "Uncategorized") | (F.col("confidence") < REVIEW_BELOW)))


# ---- filtered queries ----


def filtered(ledger: DataFrame, user: str | None = None, *, start: str = "", end: str = "", account: str = "", category: str = "", subcategory: str = "", least: float | None = None, most: float | None = None, direction: str = "", limit: int = 0, offset: int = 0) -> DataFrame:
    """Rows that meet all given conditions, newest first, ties by id.

    An empty string, a limit of 0 and an offset of 0 mean that nothing was asked; an offset without a
    limit gives a page of 100. Conditions apply to the stored category, not the effective one.
    """
    out = ledger
    for value, condition in (
        (user, F.col("user_id") == user), (start, F.col("date") >= F.lit(start or None).cast("date")), (end, F.col("date") <= F.lit(end or None).cast("date")), (account, F.col("account_id") == account),
        (category, F.col("category") == category), (subcategory, F.col("subcategory") == subcategory), (direction, F.lower(F.trim("direction")) == direction),
    ):
        if value:
            out = out.where(condition)
    if least is not None:
        out = out.where(F.col("amount") >= least)
    if most is not None:
        out = out.where(F.col("amount") <= most)
    out = out.orderBy(F.desc("date"), "id")
    if offset:
        out = out.offset(offset)
    if limit or offset:
        out = out.limit(limit or DEFAULT_PAGE)
    return out


@query("""SELECT id, user_id, account_id, date, CAST(amount AS DOUBLE) AS amount, category FROM ledger_transactions
WHERE date >= DATE '2024-01-01' AND date <= DATE '2024-12-31' AND amount >= -500 AND amount <= -5 AND lower(trim(direction)) = 'debit' AND category = 'Dining' ORDER BY date DESC, id LIMIT 50 OFFSET 20""")
def transactions_filtered_page(spark: SparkSession, folder: str) -> DataFrame:
    page = filtered(_ledger(spark, folder), start="2024-01-01", end="2024-12-31", least=-500, most=-5, direction="debit", category="Dining", limit=50, offset=20)
    return page.select("id", "user_id", "account_id", "date", F.col("amount").cast("double").alias("amount"), "category")


@query("SELECT id, account_id, statement_id, period_start, period_end, CAST(ending_balance AS DOUBLE) AS ending_balance FROM statements WHERE period_start >= DATE '2024-01-01' AND period_end <= DATE '2024-12-31'")
def statements_filtered(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "statements").where("period_start >= date'2024-01-01' and period_end <= date'2024-12-31'")
    return s.select("id", "account_id", "statement_id", "period_start", "period_end", F.col("ending_balance").cast("double").alias("ending_balance"))


@query(f"""WITH {EFFECTIVE}, m AS (SELECT effective_merchant, CAST(sum(CASE WHEN amount < 0 THEN abs(amount) ELSE 0 END) AS DOUBLE) AS total_spent, count(*) AS transaction_count
FROM eff WHERE effective_merchant IS NOT NULL GROUP BY 1) SELECT * FROM m WHERE total_spent >= 100 ORDER BY total_spent DESC, effective_merchant LIMIT 20""")
def merchant_topn(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty merchants with the most spent: a top-k report."""
    m = _effective(spark, folder).where("effective_merchant is not null").groupBy("effective_merchant")
    m = m.agg(F.sum(F.when(F.col("amount") < 0, F.abs("amount")).otherwise(F.lit(0))).cast("double").alias("total_spent"), F.count("*").alias("transaction_count"))
    return m.where("total_spent >= 100").orderBy(F.desc("total_spent"), "effective_merchant").limit(20)


@query(f"""WITH {EFFECTIVE} SELECT user_id, CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(amount) AS DOUBLE) AS net_amount FROM eff
WHERE date >= DATE '2024-03-01' AND date < DATE '2024-07-01' AND effective_category = 'Dining' GROUP BY 1, 2""")
def monthly_totals_range(spark: SparkSession, folder: str) -> DataFrame:
    m = monthly_totals(_effective(spark, folder)).where("month between date'2024-03-01' and date'2024-06-01' and effective_category = 'Dining'")
    return m.select("user_id", "month", "net_amount")


@query("SELECT t.account_id, a.institution, min(t.date) AS min_date, max(t.date) AS max_date, count(*) AS transaction_count FROM ledger_transactions t JOIN accounts a ON a.id = t.account_id GROUP BY 1, 2")
def account_date_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """First and last day and count per account in one aggregation; accounts without rows are left out."""
    r = _ledger(spark, folder).groupBy("account_id").agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"), F.count("*").alias("transaction_count"))
    return r.join(table(spark, folder, "accounts").select(F.col("id").alias("account_id"), "institution"), "account_id").select("account_id", "institution", "min_date", "max_date", "transaction_count")


@query("""WITH d AS (SELECT account_id, date, CAST(sum(sum(amount)) OVER (PARTITION BY user_id, account_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_balance
FROM ledger_transactions GROUP BY user_id, account_id, date) SELECT * FROM d WHERE date BETWEEN DATE '2024-06-01' AND DATE '2024-06-30'""")
def daily_balance_range(spark: SparkSession, folder: str) -> DataFrame:
    """Balances of a month; the filter comes after the running sum, so earlier history counts."""
    return running_balances(_ledger(spark, folder)).where("date between date'2024-06-01' and date'2024-06-30'").select("account_id", "date", "running_balance")


@query("SELECT id, user_id, institution, account_type, created_at::DATE AS created_on FROM accounts")
def accounts_list(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "accounts").orderBy(F.desc("created_at")).select("id", "user_id", "institution", "account_type", F.to_date("created_at").alias("created_on"))


@query("SELECT id, transaction_id, description FROM ledger_transactions WHERE transaction_id = (SELECT min(transaction_id) FROM ledger_transactions)")
def transaction_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One row by its transaction id, here the least id there is."""
    t = _ledger(spark, folder)
    return t.join(t.agg(F.min("transaction_id").alias("transaction_id")), "transaction_id", "left_semi").select("id", "transaction_id", "description")


@query("""WITH o AS (SELECT id AS transaction_db_id, rule_id AS notes, created_at FROM ledger_transactions WHERE rule_id IS NOT NULL AND (category IS NULL OR lower(trim(category)) IN ('', 'n/a', 'unknown', 'uncategorized')))
SELECT transaction_db_id, notes FROM o""")
def overrides_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The override in force for each transaction: of repeated ones the last."""
    o = overrides_of(_ledger(spark, folder))
    return o.groupBy("transaction_db_id").agg(F.max("notes").alias("notes"))
