"""Reports over the ledger: analytics, recurring payments, deduplication, integrity, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import merchant_key
from ledgerloom.operators import analytics, coverage, dedup, integrity, recurring
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import table


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ledger_transactions")


def owned(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows as the reports take them: owner is the user, direction tidied."""
    return _ledger(spark, folder).select("id", F.col("user_id").alias("owner"), "date", "description", "amount", F.lower(F.trim("direction")).alias("direction"), "category", "subcategory")


FLOWS = """
r AS (SELECT id, user_id AS owner, date, description, amount, lower(trim(direction)) AS direction, category, subcategory,
  (contains(lower(description), 'transfer from') OR contains(lower(description), 'transfer to') OR contains(lower(description), 'xfer from') OR contains(lower(description), 'xfer to')
   OR contains(lower(description), 'online banking transfer') OR coalesce(category = 'Transfer', false)
   OR coalesce(subcategory IN ('Transfer', 'Internal Transfer', 'Internal', 'Zelle', 'Venmo', 'Wire', 'ACH'), false)) AS transfer FROM ledger_transactions),
f AS (SELECT *, CASE WHEN NOT transfer AND direction = 'credit' THEN abs(amount) ELSE 0 END AS income, CASE WHEN NOT transfer AND direction = 'debit' THEN abs(amount) ELSE 0 END AS expense FROM r),
m AS (SELECT owner, CAST(date_trunc('month', date) AS DATE) AS month, CAST(sum(income) AS DOUBLE) AS income, CAST(sum(expense) AS DOUBLE) AS expenses FROM f WHERE NOT transfer GROUP BY 1, 2)
"""


@query(f"""WITH {FLOWS} SELECT owner, year(date) || '-Q' || quarter(date) AS quarter, CAST(date_trunc('quarter', date) AS DATE) AS start_date,
CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS end_date, CAST(sum(income) AS DOUBLE) AS total_income, CAST(sum(expense) AS DOUBLE) AS total_expenses,
CAST(sum(income) - sum(expense) AS DOUBLE) AS net_cash_flow, count(*) AS transaction_count FROM f WHERE NOT transfer GROUP BY 1, 2, 3, 4""")
def quarterly_cash_flow(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.quarterly_cash_flow(owned(spark, folder))


@query(f"""WITH {FLOWS} SELECT owner, CAST(sum(income) AS DOUBLE) AS total_income, CAST(sum(expense) AS DOUBLE) AS total_expenses, CAST(sum(income) - sum(expense) AS DOUBLE) AS net_income,
CAST(sum(CASE WHEN transfer THEN abs(amount) ELSE 0 END) AS DOUBLE) AS excluded_transfers, min(date) AS period_start, max(date) AS period_end FROM f GROUP BY 1""")
def income_vs_expenses(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.income_and_expenses(owned(spark, folder))


@query(f"WITH {FLOWS} SELECT owner, category, CAST(sum(income) AS DOUBLE) AS total FROM f WHERE NOT transfer AND direction = 'credit' GROUP BY 1, 2")
def income_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.by_category(owned(spark, folder), "income")


@query(f"WITH {FLOWS} SELECT owner, category, CAST(sum(expense) AS DOUBLE) AS total FROM f WHERE NOT transfer AND direction = 'debit' GROUP BY 1, 2")
def expenses_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.by_category(owned(spark, folder), "expense")


@query()
def expense_maps(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.category_map(owned(spark, folder), "expense")


@query(f"WITH {FLOWS} SELECT * FROM m")
def lender_monthly(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.monthly_breakdown(owned(spark, folder))


STREAK = """
i AS (SELECT owner, month, income > 0 AS got, row_number() OVER (PARTITION BY owner ORDER BY month) - row_number() OVER (PARTITION BY owner, income > 0 ORDER BY month) AS g FROM m),
n AS (SELECT owner, got, g, count(*) AS n FROM i GROUP BY 1, 2, 3),
streak AS (SELECT owner, coalesce(max(CASE WHEN got THEN n END), 0) AS months FROM n GROUP BY 1)
"""


@query(f"WITH {FLOWS}, {STREAK} SELECT owner, months FROM streak")
def income_streak(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.income_streaks(owned(spark, folder))


@query(f"""WITH {FLOWS}, {STREAK},
s AS (SELECT owner, CAST(sum(CAST(income AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS ai, CAST(sum(CAST(expenses AS DECIMAL(20,2))) AS DOUBLE) / count(*) AS ae, stddev_pop(income) AS sd, count(*) AS months FROM m GROUP BY 1),
v AS (SELECT *, CASE WHEN months > 1 THEN sd / CASE WHEN ai = 0 THEN 1 ELSE ai END ELSE 0 END AS cv FROM s),
g AS (SELECT m.owner, count(*) FILTER (m.income > s.ai * 0.5::DOUBLE) AS regular FROM m JOIN s ON s.owner = m.owner GROUP BY 1),
c AS (SELECT owner, count(DISTINCT category) AS sources FROM f WHERE NOT transfer AND direction = 'credit' GROUP BY 1),
a AS (SELECT owner, max(n) AS most FROM (SELECT owner, floor(abs(amount)::DOUBLE + 0.5) AS x, count(*) AS n FROM f WHERE NOT transfer AND direction = 'credit' GROUP BY 1, 2) GROUP BY 1)
SELECT v.owner, floor(ai * 100 + 0.5::DOUBLE) / 100 AS average_income, floor(ae * 100 + 0.5::DOUBLE) / 100 AS average_expenses, floor(cv * 10000 + 0.5::DOUBLE) / 10000 AS income_variation,
CAST(floor(round(greatest(0.0::DOUBLE, 100 - cv * 100) * 0.4::DOUBLE + least(100.0::DOUBLE, k.months::DOUBLE / v.months * 100) * 0.3::DOUBLE + g.regular::DOUBLE / v.months * 100 * 0.3::DOUBLE, 6) + 0.5::DOUBLE) AS BIGINT) AS stability_score,
k.months AS consecutive_months, v.months AS total_months, coalesce(c.sources, 0) AS income_sources, coalesce(a.most >= 3, false) AS regular_income, floor(ai * 12 * 100 + 0.5::DOUBLE) / 100 AS annual_income
FROM v JOIN g ON g.owner = v.owner JOIN streak k ON k.owner = v.owner LEFT JOIN c ON c.owner = v.owner LEFT JOIN a ON a.owner = v.owner""")
def lender_summary(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.lender_summary(owned(spark, folder))


TAX = f"""{FLOWS}, y AS (SELECT owner, max(year(date)) AS tax_year FROM r GROUP BY 1),
x AS (SELECT f.*, y.tax_year, CASE WHEN coalesce(category, '') IN ('Income', 'Financial') AND coalesce(subcategory, '') IN ('Salary', 'Interest', 'Dividend', 'Rental Income', 'Business Income') THEN 'income'
 WHEN category = 'Business' AND coalesce(subcategory, '') IN ('', 'Office Supplies', 'Software', 'Equipment', 'Professional Services') THEN 'deductible'
 WHEN category = 'Health' AND coalesce(subcategory, '') IN ('', 'Medical', 'Pharmacy', 'Healthcare', 'Insurance') THEN 'deductible'
 WHEN category = 'Education' AND coalesce(subcategory, '') IN ('', 'Tuition', 'Books', 'Courses') THEN 'deductible'
 WHEN category = 'Professional Services' AND coalesce(subcategory, '') IN ('', 'Legal', 'Accounting', 'Consulting') THEN 'deductible'
 WHEN category = 'Charitable' AND coalesce(subcategory, '') IN ('', 'Donation', 'Charity') THEN 'deductible'
 WHEN category IN ('Business', 'Professional Services', 'Education') THEN 'review' ELSE 'neutral' END AS relevance FROM f JOIN y ON y.owner = f.owner WHERE NOT transfer AND year(date) = y.tax_year)"""


@query(f"WITH {TAX} SELECT owner, CAST(tax_year AS INTEGER) AS tax_year, category, subcategory, relevance, CAST(sum(abs(amount)) AS DOUBLE) AS total_amount, count(*) AS transaction_count FROM x GROUP BY 1, 2, 3, 4, 5")
def tax_categories(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.tax_categories(owned(spark, folder))


@query(f"""WITH {TAX} SELECT owner, CAST(tax_year AS INTEGER) AS tax_year, CAST(sum(CASE WHEN relevance = 'income' THEN income ELSE 0 END) AS DOUBLE) AS taxable_income, CAST(sum(CASE WHEN relevance = 'deductible' THEN expense ELSE 0 END) AS DOUBLE) AS deductible,
CAST(sum(CASE WHEN relevance = 'deductible' AND category = 'Business' THEN expense ELSE 0 END) AS DOUBLE) AS business, CAST(sum(CASE WHEN relevance = 'deductible' AND category = 'Health' THEN expense ELSE 0 END) AS DOUBLE) AS medical,
CAST(sum(CASE WHEN relevance = 'deductible' AND category = 'Charitable' THEN expense ELSE 0 END) AS DOUBLE) AS charitable, CAST(sum(CASE WHEN relevance = 'deductible' AND category = 'Professional Services' THEN expense ELSE 0 END) AS DOUBLE) AS professional,
CAST(sum(CASE WHEN relevance = 'deductible' AND coalesce(category, '') NOT IN ('Business', 'Health', 'Charitable', 'Professional Services') THEN expense ELSE 0 END) AS DOUBLE) AS other FROM x GROUP BY 1, 2""")
def tax_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.tax_buckets(owned(spark, folder))


@query("SELECT category, CAST(sum(amount) AS DOUBLE) AS total, count(*) AS transaction_count FROM ledger_transactions GROUP BY 1")
def category_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger(spark, folder).groupBy("category").agg(F.sum("amount").cast("double").alias("total"), F.count("*").alias("transaction_count"))


# ---- recurring payments ----

_KEY = r"trim(regexp_replace(regexp_replace(lower(regexp_replace(description, '[\p{Z}\t]', ' ', 'g')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_FREQ = "CASE WHEN cv > 0.4 THEN 'irregular' WHEN mean BETWEEN 5 AND 9 THEN 'weekly' WHEN mean BETWEEN 12 AND 16 THEN 'bi-weekly' WHEN mean BETWEEN 26 AND 35 THEN 'monthly' WHEN mean BETWEEN 85 AND 100 THEN 'quarterly' WHEN mean BETWEEN 170 AND 200 THEN 'semi-annual' WHEN mean BETWEEN 350 AND 380 THEN 'annual' ELSE 'irregular' END"
_WORDS = " OR ".join(f"contains(d1, '{w}')" for w in recurring.SUBSCRIPTION_WORDS)
RECURRING = f"""
t AS (SELECT id, user_id AS owner, date, description, abs(amount) AS ad, abs(amount)::DOUBLE AS a, lower(trim(direction)) AS direction, category, subcategory, {_KEY} AS tidy FROM ledger_transactions),
k AS (SELECT *, array_to_string(list_slice(string_split(tidy, ' '), 1, CASE WHEN regexp_matches(tidy, '^zelle payment (from|to)( |$)') THEN 4 ELSE 3 END), ' ') AS merchant_key FROM t),
w AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY owner, merchant_key, direction ORDER BY date, id), date) AS step FROM k WHERE length(merchant_key) >= 3),
g AS (SELECT owner, merchant_key, direction, count(*) AS n, CAST(sum(ad) AS DOUBLE) / count(*) AS aa, stddev_pop(a) AS sa, min(date) AS first_seen, max(date) AS last_seen, avg(step) AS mean0, count(step) AS m, sum(step) AS s1, sum(step * step) AS s2,
  arg_min_null(category, (date, id)) AS category, arg_min_null(subcategory, (date, id)) AS subcategory, lower(arg_min(description, (date, id))) AS d1 FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 2),
h AS (SELECT *, s1::DOUBLE / m AS mean1, CASE WHEN m < 2 THEN 0 ELSE sqrt(greatest(0, s2::DOUBLE / m - (s1::DOUBLE / m) * (s1::DOUBLE / m))) END AS sd FROM g),
c AS (SELECT *, round(mean1, 9) AS mean, round(CASE WHEN mean1 > 0 THEN sd / mean1 ELSE 1 END, 9) AS cv, round(CASE WHEN aa > 0 THEN sa / aa ELSE 0 END, 9) AS acv, CASE WHEN aa > 0 THEN sa / aa ELSE 0 END AS acv0 FROM h),
q AS (SELECT *, {_FREQ} AS frequency FROM c WHERE cv <= 0.3 OR n >= 6),
p AS (SELECT owner, merchant_key, direction, frequency, round(mean1, 1) AS interval_days, floor(aa * 100 + 0.5::DOUBLE) / 100 AS average_amount, acv < 0.01 AS fixed_amount, category, subcategory, n AS occurrences, first_seen, last_seen,
  CAST(CASE frequency WHEN 'weekly' THEN last_seen + 7 WHEN 'bi-weekly' THEN last_seen + 14 WHEN 'monthly' THEN last_seen + 30 WHEN 'quarterly' THEN last_seen + 91 WHEN 'semi-annual' THEN last_seen + 182 WHEN 'annual' THEN last_seen + 365 END AS DATE) AS expected_next,
  least(1.0::DOUBLE, round(0.5::DOUBLE + CASE WHEN n >= 3 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n >= 6 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN n >= 12 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN cv < 0.1 THEN 0.1::DOUBLE WHEN cv < 0.2 THEN 0.05::DOUBLE ELSE 0 END
   + CASE WHEN acv < 0.01 THEN 0.1::DOUBLE WHEN acv < 0.05 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN frequency <> 'irregular' THEN 0.05::DOUBLE ELSE 0 END, 2)) AS confidence,
  ({_WORDS} OR coalesce(category IN ('Entertainment', 'Utilities'), false)) AND acv < 0.05 AND frequency <> 'irregular' AS subscription FROM q)
"""


@query(f"WITH {RECURRING} SELECT * FROM p")
def recurring_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return recurring.patterns(owned(spark, folder)).drop("pattern_id", "amount_variation")


@query(f"""WITH {RECURRING}, u AS (SELECT user_id AS owner, count(*) AS total FROM ledger_transactions GROUP BY 1),
z AS (SELECT owner, count(*) AS patterns, CAST(sum(occurrences) AS BIGINT) AS recurring, count(*) FILTER (subscription) AS subscriptions,
 sum(CASE WHEN direction = 'debit' THEN average_amount * CASE frequency WHEN 'weekly' THEN 4.33::DOUBLE WHEN 'bi-weekly' THEN 2.17::DOUBLE WHEN 'quarterly' THEN 1::DOUBLE / 3 WHEN 'semi-annual' THEN 1::DOUBLE / 6 WHEN 'annual' THEN 1::DOUBLE / 12 ELSE 1 END ELSE 0 END) AS monthly FROM p GROUP BY 1)
SELECT z.owner, patterns, recurring, subscriptions, floor(round(monthly, 6) * 100 + 0.5::DOUBLE) / 100 AS monthly FROM z""")
def recurring_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = owned(spark, folder)
    return recurring.summary(recurring.patterns(rows), rows).select("owner", "patterns", "recurring", "subscriptions", "monthly")


@query(f"""WITH {RECURRING}, x AS (SELECT k.id, k.direction, p.subscription, list_reduce(list_transform(string_split(k.merchant_key, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: (a * 31 + c) & 4294967295) AS h
FROM k JOIN p ON p.owner = k.owner AND p.merchant_key = k.merchant_key AND p.direction = k.direction)
SELECT id, 'rec_' || direction || '_' || format('{{:08x}}', CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END) AS pattern_id, subscription FROM x""")
def recurring_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = owned(spark, folder)
    return recurring.flagged(rows, recurring.patterns(rows))


@query(f"SELECT id, array_to_string(list_slice(string_split({_KEY}, ' '), 1, CASE WHEN regexp_matches({_KEY}, '^zelle payment (from|to)( |$)') THEN 4 ELSE 3 END), ' ') AS merchant_key FROM ledger_transactions")
def merchant_keys(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger(spark, folder).select("id", merchant_key(F.col("description")).alias("merchant_key"))


# ---- deduplication ----


@query("SELECT min(id) AS id FROM ledger_transactions GROUP BY date, description, amount")
def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.first_seen(_ledger(spark, folder), "id").select("id")


@query(r"""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY statement_db_id, date, amount, direction, regexp_replace(lower(trim(description)), '\s+', ' ', 'g') ORDER BY coalesce(confidence, -1) DESC, id) AS n FROM ledger_transactions) WHERE n = 1""")
def dedup_best_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.most_confident(_ledger(spark, folder), "id").select("id")


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY account_id, date, amount, direction, description ORDER BY created_at DESC, id) AS n FROM ledger_transactions) WHERE n = 1")
def dedup_latest(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.latest(_ledger(spark, folder), "id").select("id")


@query("""WITH s AS (SELECT *, coalesce(transaction_count, 0) * 10 + CASE WHEN total_credits > 0 THEN 5 ELSE 0 END + CASE WHEN abs(total_debits) > 0 THEN 5 ELSE 0 END
 + CASE WHEN coalesce(starting_balance, 0) <> 0 OR coalesce(ending_balance, 0) <> 0 THEN 3 ELSE 0 END + 5 AS score,
 regexp_matches(lower(statement_id), 'combined|merged|all_statements|all-statements|allstatements') AS combined FROM statements)
SELECT id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY account_id, period_start, period_end ORDER BY score DESC, combined, statement_id, id) AS INTEGER) AS rank FROM s""")
def statement_rank_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.ranked_statements(table(spark, folder, "statements")).select("id", F.col("score").cast("int").alias("score"), "rank")


# ---- integrity ----

CHECKS = """c AS (SELECT id, account_id, coalesce(starting_balance, 0) + coalesce(total_credits, 0) - abs(coalesce(total_debits, 0)) AS calc, coalesce(ending_balance, 0) AS e FROM statements)"""


@query(f"""WITH {CHECKS} SELECT id, account_id, CAST(calc AS DOUBLE) AS calculated_ending, CAST(e - calc AS DOUBLE) AS delta, abs(e - calc) <= 0.01 AS passed,
CASE WHEN abs(e - calc) <= 0.01 THEN NULL WHEN abs(e - calc) > 1 THEN 'error' ELSE 'warning' END AS severity FROM c""")
def statement_integrity(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.statement_checks(table(spark, folder, "statements"))


@query(f"""WITH {CHECKS} SELECT count(*) AS checked, count(*) FILTER (abs(e - calc) > 0.01) AS with_issues, CAST(coalesce(sum(e - calc) FILTER (abs(e - calc) > 0.01), 0) AS DOUBLE) AS total_delta,
count(*) FILTER (abs(e - calc) > 0.01) = 0 AS valid, abs(coalesce(sum(e - calc) FILTER (abs(e - calc) > 0.01), 0)) > 1 AS warn_total FROM c""")
def integrity_summary(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.summary(integrity.statement_checks(table(spark, folder, "statements")))


@query("""WITH t AS (SELECT statement_db_id AS id, count(*) AS n, sum(CASE WHEN lower(trim(direction)) = 'credit' THEN abs(amount) ELSE 0 END) AS c, sum(CASE WHEN lower(trim(direction)) = 'debit' THEN abs(amount) ELSE 0 END) AS d
FROM ledger_transactions WHERE statement_db_id IS NOT NULL GROUP BY 1)
SELECT s.id, t.n AS rows, CAST(abs(abs(coalesce(total_credits, 0)) - t.c) AS DOUBLE) AS credits_difference, CAST(abs(abs(coalesce(total_debits, 0)) - t.d) AS DOUBLE) AS debits_difference,
abs(abs(coalesce(total_credits, 0)) - t.c) <= 0.01 AND abs(abs(coalesce(total_debits, 0)) - t.d) <= 0.01 AS passed FROM statements s JOIN t ON t.id = s.id""")
def balance_validation(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.totals_against_rows(table(spark, folder, "statements"), _ledger(spark, folder))


@query("""SELECT account_id, CAST(arg_min_null(starting_balance, (period_start, id)) AS DOUBLE) AS starting_balance, CAST(arg_max_null(ending_balance, (period_start, id)) AS DOUBLE) AS ending_balance,
CAST(sum(total_credits) AS DOUBLE) AS total_credits, CAST(sum(total_debits) AS DOUBLE) AS total_debits, min(period_start) AS period_start, arg_max(period_end, (period_start, id)) AS period_end, count(*) AS total_statements FROM statements GROUP BY 1""")
def account_rollup_v2(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.account_rollup(table(spark, folder, "statements"))


@query(r"""SELECT id, path, keyword FROM (SELECT id, unnest([CASE WHEN NOT regexp_full_match(transaction_id, 'tx_[a-f0-9]{24}') THEN {'path': 'transaction_id', 'keyword': 'pattern'} END,
CASE WHEN NOT lower(trim(direction)) IN ('credit', 'debit') THEN {'path': 'direction', 'keyword': 'enum'} END, CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN {'path': 'confidence', 'keyword': 'range'} END,
CASE WHEN length(description) = 0 THEN {'path': 'description', 'keyword': 'minLength'} END, CASE WHEN category IS NULL THEN {'path': 'category', 'keyword': 'required'} END], recursive := true) FROM ledger_transactions) WHERE path IS NOT NULL""")
def schema_violations(spark: SparkSession, folder: str) -> DataFrame:
    checks = {
        "transaction_id": ("pattern", F.col("transaction_id").rlike("^tx_[a-f0-9]{24}$")), "direction": ("enum", F.lower(F.trim("direction")).isin("credit", "debit")),
        "confidence": ("range", F.col("confidence").between(0, 1)), "description": ("minLength", F.length("description") > 0), "category": ("required", F.col("category").isNotNull()),
    }
    return integrity.violations(_ledger(spark, folder), checks)


# ---- coverage ----

_A, _B = "2023-01-01", "2025-12-31"
ISLANDS = """ok AS (SELECT account_id, period_start AS s, period_end AS e FROM statements WHERE period_start <= period_end),
k AS (SELECT *, max(e) OVER (PARTITION BY account_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ok),
z AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM k),
p AS (SELECT account_id, min(s) AS s, max(e) AS e FROM z GROUP BY account_id, g)"""
GAPS = f"""{ISLANDS},
c AS (SELECT account_id, s, e, greatest(DATE '{_A}', coalesce(CAST(lag(e) OVER (PARTITION BY account_id ORDER BY s) + 1 AS DATE), DATE '{_A}')) AS cursor, lead(s) OVER (PARTITION BY account_id ORDER BY s) IS NULL AS last FROM p),
h AS (SELECT *, CASE WHEN s < DATE '{_B}' THEN CAST(s - 1 AS DATE) ELSE DATE '{_B}' END AS ge FROM c),
gaps AS (SELECT account_id, cursor AS gap_start, ge AS gap_end FROM h WHERE s > cursor AND cursor <= DATE '{_B}' AND cursor <= ge
UNION ALL SELECT account_id, greatest(cursor, CAST(e + 1 AS DATE)), DATE '{_B}' FROM h WHERE last AND greatest(cursor, CAST(e + 1 AS DATE)) <= DATE '{_B}')"""


@query(f"WITH {ISLANDS} SELECT account_id, s AS start_day, e AS end_day FROM p")
def coverage_islands(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerloom.operators.intervals import periods_and_gaps

    found = periods_and_gaps(table(spark, folder, "statements"), "account_id", "period_start", "period_end")
    return found.where("kind = 'period'").select("account_id", "start_day", "end_day")


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    day = lambda d: F.lit(d).cast("date")
    return coverage.uncovered(table(spark, folder, "statements"), "account_id", "period_start", "period_end", day(_A), day(_B))


@query(f"WITH {GAPS} SELECT account_id, gap_start, gap_end FROM gaps")
def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return _gaps(spark, folder)


@query(f"WITH {GAPS} SELECT t.id FROM ledger_transactions t WHERE EXISTS (SELECT 1 FROM gaps g WHERE g.account_id = t.account_id AND t.date BETWEEN g.gap_start AND g.gap_end)")
def gap_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    return coverage.rows_in_gaps(_ledger(spark, folder), "account_id", "date", _gaps(spark, folder)).select("id")


@query("""WITH a AS (SELECT account_id, arg_max(period_end, (period_end, id)) AS pe, arg_max(ending_balance, (period_end, id)) AS eb FROM statements WHERE ending_balance IS NOT NULL GROUP BY 1),
x AS (SELECT t.account_id, t.date, abs(t.amount) AS s, lower(trim(t.direction)) = 'credit' AS c, a.pe, a.eb FROM (SELECT *, row_number() OVER (PARTITION BY account_id, date, amount, direction, description ORDER BY created_at DESC, id) AS n FROM ledger_transactions) t LEFT JOIN a ON a.account_id = t.account_id WHERE t.n = 1),
s AS (SELECT account_id, sum(CASE WHEN c THEN s ELSE 0 END) AS tc, sum(CASE WHEN c THEN 0 ELSE s END) AS td, sum(CASE WHEN date > pe THEN CASE WHEN c THEN s ELSE -s END ELSE 0 END) AS later, any_value(eb) AS eb, min(date) AS period_start, max(date) AS period_end FROM x GROUP BY 1)
SELECT account_id, CAST(coalesce(eb + later, tc - td) AS DOUBLE) AS ending_balance, CAST(coalesce(eb + later, tc - td) - tc + td AS DOUBLE) AS starting_balance, CAST(tc AS DOUBLE) AS total_credits, CAST(td AS DOUBLE) AS total_debits, period_start, period_end FROM s""")
def anchored_balances(spark: SparkSession, folder: str) -> DataFrame:
    """Each account's balances reckoned from its latest statement, over deduplicated rows."""
    return integrity.anchored_balances(dedup.latest(_ledger(spark, folder), "id"), table(spark, folder, "statements"))


@query("""WITH n AS (SELECT *, coalesce(total_credits, 0) - abs(coalesce(total_debits, 0)) AS net FROM statements)
SELECT id, account_id, CAST(CASE WHEN count(*) OVER (PARTITION BY account_id) = 1 AND ending_balance IS NOT NULL THEN ending_balance
ELSE sum(net) OVER (PARTITION BY account_id ORDER BY period_start RANGE UNBOUNDED PRECEDING) END AS DOUBLE) AS balance FROM n""")
def statement_running_balance(spark: SparkSession, folder: str) -> DataFrame:
    return integrity.running_statement_balances(table(spark, folder, "statements"))
