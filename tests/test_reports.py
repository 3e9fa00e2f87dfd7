from datetime import date, timedelta
from decimal import Decimal

import pytest
from ledgerloom.operators import analytics, dedup, integrity, recurring
from ledgerloom.plans.views import filtered
from pyspark.sql import functions as F

ROWS = "owner string, id string, date date, description string, amount decimal(14,2), direction string, category string, subcategory string"


def series(name, day, step, n, amount, direction="debit", category="X", jitter=0):
    return [("u", f"{name}{i}", day + timedelta(step * i), name, Decimal(str(amount + jitter * (i % 3))), direction, category, None) for i in range(n)]


def monthly(name, n, amount, **k):
    return [("u", f"{name}{i}", date(2025, 1 + i, 15), name, Decimal(str(amount)), k.get("direction", "debit"), k.get("category", "X"), None) for i in range(n)]


def test_recurring_expectations(spark):
    rows = monthly("NETFLIX.COM", 4, 15.99) + series("GROCERY STORE", date(2025, 1, 3), 7, 4, 50.0, jitter=3) + series("PAYROLL DEPOSIT", date(2025, 1, 3), 14, 4, 2500, "credit")
    rows += [("u", f"i{i}", date(2025, m, 15), "INSURANCE PREMIUM", Decimal(450), "debit", "X", None) for i, m in enumerate((1, 4, 7))] + [("u", "z", date(2025, 1, 1), "ODD ONE", Decimal(1), "debit", "X", None), ("u", "y", date(2025, 1, 1), "ab", Decimal(1), "debit", "X", None)]
    df = spark.createDataFrame(rows, ROWS)
    got = {r.merchant_key: r for r in recurring.patterns(df).collect()}
    assert set(got) == {"netflixcom", "grocery store", "payroll deposit", "insurance premium"}
    n = got["netflixcom"]
    assert (n.frequency, n.fixed_amount, n.subscription, n.occurrences, n.expected_next) == ("monthly", True, True, 4, date(2025, 5, 15))
    assert (got["grocery store"].frequency, got["grocery store"].fixed_amount) == ("weekly", False)
    assert (got["payroll deposit"].frequency, got["payroll deposit"].fixed_amount) == ("bi-weekly", True)
    assert got["insurance premium"].frequency == "quarterly"
    s = recurring.summary(recurring.patterns(df), df).first()
    assert s.patterns == 4 and s.n_monthly == 1 and s.recurring == 15
    assert recurring.flagged(df, recurring.patterns(df)).count() == 15


def test_same_day_rows_make_intervals_of_zero(spark):
    rows = [("u", str(i), date(2025, 1, 1 + i // 2), "SAME THING TWICE", Decimal(5), "debit", None, None) for i in range(8)]
    r = recurring.patterns(spark.createDataFrame(rows, ROWS)).first()
    steps = [0, 1, 0, 1, 0, 1, 0]
    assert r.occurrences == 8 and r.interval_days == round(sum(steps) / 7, 1) and r.frequency == "irregular" and r.expected_next is None


def test_analytics_edges(spark):
    rows = [
        ("u", "1", date(2024, 2, 1), "Salary", Decimal("100.00"), "credit", "Income", "Salary"), ("u", "2", date(2024, 2, 9), "transfer to x", Decimal("-9.00"), "debit", "Shopping", None), ("u", "3", date(2024, 5, 1), "Gift", Decimal("50.00"), "credit", None, None),
        ("u", "4", date(2024, 5, 2), "Food", Decimal("-20.00"), "debit", "Health", None), ("v", "5", date(2023, 1, 1), None, Decimal("-1.00"), "debit", None, None),
    ]
    df = spark.createDataFrame(rows, ROWS)
    q = {(r.owner, r.quarter): r for r in analytics.quarterly_cash_flow(df).collect()}
    assert q["u", "2024-Q1"].total_income == 100 and q["u", "2024-Q1"].transaction_count == 1 and q["u", "2024-Q2"].net_cash_flow == 30 and q["u", "2024-Q2"].end_date == date(2024, 6, 30)
    i = {r.owner: r for r in analytics.income_and_expenses(df).collect()}
    assert i["u"].excluded_transfers == 9 and i["u"].net_income == 130
    # Months without rows do not break a streak.
    assert {r.owner: r.months for r in analytics.income_streaks(df).collect()} == {"u": 2, "v": 0}
    s = {r.owner: r for r in analytics.lender_summary(df).collect()}
    assert s["u"].total_months == 2 and s["u"].average_income == 75 and s["v"].income_sources == 0 and not s["u"].regular_income
    t = {r.owner: r for r in analytics.tax_buckets(df).collect()}
    assert t["u"].medical == 20 and t["u"].taxable_income == 100 and t["v"].tax_year == 2023
    assert analytics.lender_summary(df.limit(0)).count() == analytics.tax_categories(df.limit(0)).count() == 0
    assert analytics.category_map(df, "expense").where("owner = 'u'").first().totals == {"Health": 20.0}


def test_dedup_winners(spark):
    ts = "2024-01-01 00:00:0"
    rows = [("1", "s", "a", date(2024, 1, 1), Decimal(5), "debit", "X y", 0.5, ts + "1"), ("2", "s", "a", date(2024, 1, 1), Decimal(5), "debit", "x  Y ", 0.9, ts + "2"), ("3", "s", "a", date(2024, 1, 1), Decimal(5), "debit", "X y", None, ts + "3"), ("4", None, "a", None, None, None, None, None, ts + "4"), ("5", None, "a", None, None, None, None, None, ts + "4")]
    df = spark.createDataFrame(rows, "id string, statement_db_id string, account_id string, date date, amount decimal(14,2), direction string, description string, confidence double, c string").withColumn("created_at", F.col("c").cast("timestamp"))
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(dedup.first_seen(df, "id")) == ["1", "2", "4"] and ids(dedup.most_confident(df, "id")) == ["2", "4"] and ids(dedup.latest(df, "id")) == ["2", "3", "4"]
    once = dedup.latest(df, "id")
    assert ids(dedup.latest(once, "id")) == ids(once)


def test_integrity(spark):
    rows = [("1", "a", 1000, 200, 50, 1150), ("2", "a", 0, 10, 0, 10.5), ("3", "a", 0, 10, -5, 50), ("4", "a", None, None, None, None)]
    df = spark.createDataFrame([(i, a, *[None if x is None else Decimal(str(x)) for x in v]) for i, a, *v in rows], "id string, account_id string, starting_balance decimal(14,2), total_credits decimal(14,2), total_debits decimal(14,2), ending_balance decimal(14,2)")
    got = {r.id: (r.passed, r.severity, r.delta) for r in integrity.statement_checks(df).collect()}
    assert got == {"1": (True, None, 0), "2": (False, "warning", 0.5), "3": (False, "error", 45), "4": (True, None, 0)}
    s = integrity.summary(integrity.statement_checks(df)).first()
    assert (s.checked, s.with_issues, s.total_delta, s.valid, s.warn_total) == (4, 2, 45.5, False, True)
    assert integrity.summary(integrity.statement_checks(df.limit(0))).first().valid


@pytest.mark.parametrize(("args", "n"), [({}, 5), ({"limit": 2}, 2), ({"limit": 0, "start": ""}, 5), ({"offset": 3}, 2), ({"start": "2024-01-03"}, 3), ({"least": -3, "most": -2}, 2), ({"direction": "credit"}, 0)])
def test_filter_builder(spark, args, n):
    df = spark.createDataFrame([(str(i), "u", date(2024, 1, i), Decimal(-i), "Debit ", "a", "c", None) for i in range(1, 6)], "id string, user_id string, date date, amount decimal(14,2), direction string, account_id string, category string, subcategory string")
    rows = filtered(df, "u", **args).collect()
    assert len(rows) == n and [r.date for r in rows] == sorted((r.date for r in rows), reverse=True)
