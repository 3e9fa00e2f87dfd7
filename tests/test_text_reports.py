from datetime import date

from ledgerloom.sinks import reports


def test_reconciliation_and_merge(spark):
    s = spark.createDataFrame([(2, 1, 1, 0, 0, 0.5, 10.0, 8.0, 2.0)], "matched int, exact int, fuzzy int, amount_date int, amount_only int, match_rate double, amount_left double, amount_right double, amount_difference double")
    left = spark.createDataFrame([(f"{i:02}", date(2024, 1, 1 + i), 5.0, f"row {i}") for i in range(13)], "id string, date date, amount double, description string")
    right = spark.createDataFrame([], "id string, date date, amount double, name string")
    text = reports.reconciliation_report(s, left, right)
    assert "Matched: 2 (50.0%)" in text and "row 9" in text and "row 10" not in text and text.endswith("... and 3 more") and "Only in the feed" not in text
    m = spark.createDataFrame([("both",), ("feed",), ("feed",)], "origin string")
    assert reports.merge_report(m) == "Merge\nUpdated: 1\nAdded: 2\nUnchanged: 0"


def test_balances_and_holdings(spark):
    c = spark.createDataFrame([("1", True, 0.0, None), ("2", False, -7.5, "error"), ("3", False, 0.5, "warning")], "id string, passed boolean, delta double, severity string")
    assert reports.balance_report(c) == "Balances\n  error: 2 is off by -7.50\n  warning: 3 is off by 0.50"
    assert reports.balance_report(c.where("passed")) == "Balances\n  all statements add up"
    g = spark.createDataFrame([("a", "s", "Fund", 150.0, 50.0), ("a", "t", None, 5.0, None)], "account_id string, security_id string, security string, value double, gain double")
    t = spark.createDataFrame([("a", 155.0, 50.0)], "account_id string, value double, gain double")
    assert reports.holdings_report(g, t) == "Holdings\n  Fund: 150.00 (+50.00)\n  t: 5.00\nAccounts\n  a: 155.00, gain +50.00"
