from datetime import date
from decimal import Decimal

import pytest
from ledgerloom.functions import classify, scalars
from pyspark.sql import functions as F


def one(spark, column, *args):
    cols = [F.lit(a) for a in args]
    return spark.range(1).select(column(*cols).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("$1,234.50", 1234.5), ("(5.00)", -5.0), ("5.00-", 5.0), ("-7", -7.0), ("abc", None), ("", None), ("($1,000.00)", -1000.0)])
def test_parse_amount(spark, text, want):
    assert one(spark, scalars.parse_amount, text) == want


@pytest.mark.parametrize(("x", "want"), [(-2.5, -2.0), (2.5, 3.0), (-2.345, -2.35), (-2.125, -2.12), (1.005, 1.0), (0.0, 0.0)])
def test_round_half_up(spark, x, want):
    digits = 0 if x in (-2.5, 2.5) else 2
    assert one(spark, lambda c: scalars.round_half_up(c, digits), x) == want


@pytest.mark.parametrize(("text", "want"), [("1/5/24", date(2024, 1, 5)), ("01/05/2024", date(2024, 1, 5)), ("3/7", date(2023, 3, 7)), ("Feb 9", date(2023, 2, 9)), ("13/45/24", None), ("x", None), ("Foo 9", None)])
def test_parse_us_date(spark, text, want):
    assert one(spark, lambda c: scalars.parse_us_date(c, F.lit(2023)), text) == want


def test_labels_and_keys(spark):
    args = ("Bank of  America", "Checking ", "****1234", date(2025, 1, 1), date(2025, 1, 31))
    assert one(spark, scalars.statement_key, *args) == "BOA-checking-****1234-2025-01-01-2025-01-31"
    assert one(spark, scalars.period_label, "Oxbow Federal", "savings", date(2025, 1, 1), date(2025, 1, 31)) == "2025-01 OXBOW_FEDERAL Savings"
    assert one(spark, scalars.period_label, "Oxbow", "savings", date(2025, 1, 9), date(2025, 2, 8)) == "2025-01-09..2025-02-08 OXBOW Savings"
    assert one(spark, scalars.quarter_label, date(2025, 5, 1)) == "2025-Q2" and one(spark, scalars.quarter_end, date(2025, 5, 1)) == date(2025, 6, 30)
    key = one(spark, scalars.transaction_key, "s", date(2025, 1, 2), None, "debit", Decimal("5.00"), " a  b ", None, 1, "x")
    assert len(key) == 27 and key == one(spark, scalars.transaction_key, "s", date(2025, 1, 2), None, "debit", Decimal("5.00"), "A b", "", 1, "X ")
    assert one(spark, scalars.is_transaction_key, key) and not one(spark, scalars.is_transaction_key, "tx_1") and not one(spark, scalars.is_statement_key, "a b")


def test_similarity_and_keys(spark):
    assert one(spark, scalars.similarity, "Abc", "abc ") == 1 and one(spark, scalars.similarity, "", "x") == 0 and one(spark, scalars.similarity, "kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert one(spark, scalars.merchant_key, "NETFLIX.COM *Sub  plan nine") == "netflixcom sub plan"
    assert one(spark, scalars.merchant_key, "Zelle payment from BOB Conf# 1") == "zelle payment from bob"

    def java(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return f"{abs(h - 2**32 if h >= 2**31 else h):08x}"

    for s in ("netflix com", "a", "rent payment", "zzzzzzzzzzzz"):
        assert one(spark, scalars.pattern_hash, s) == java(s)


def test_escapes(spark):
    assert one(spark, scalars.csv_field, 'a "b", c') == '"a ""b"", c"' and one(spark, scalars.csv_field, "a\nb") == '"a\nb"' and one(spark, scalars.csv_field, None) == "" and one(spark, scalars.csv_field, "a;b") == "a;b"
    assert one(spark, lambda c: scalars.xml_text(c, 32), "A&B <é>") == "A&amp;B &lt;?&gt;"
    assert one(spark, lambda c: scalars.xml_text(c, 6), "AB&CD") == "AB&amp"  # a cut may fall inside an entity
    assert one(spark, scalars.currency, -1234.5) == "-$1,234.50"


CATEGORIES = [
    ("PAYROLL DIRECT DEP ACME", "Income", "Salary", 0.95), ("STARBUCKS STORE 12345", "Food & Dining", "Restaurants", 0.85), ("UBER EATS", "Food & Dining", "Food Delivery", 0.95), ("UBER TRIP", "Transportation", "Rideshare", 0.95),
    ("qwxz", "Uncategorized", None, 0.5), ("AUTO ELECTRIC", "Uncategorized", None, 0.5), ("NETFLIX.COM", "Entertainment", "Streaming", 0.95),
]


@pytest.mark.parametrize(("text", "category", "sub", "confidence"), CATEGORIES)
def test_categories(spark, text, category, sub, confidence):
    got = one(spark, classify.categorize, text)
    assert (got.category, got.subcategory, got.confidence) == (category, sub, confidence)


def test_channel_gates_rules_only_if_given(spark):
    text = "CHECK #123"
    assert one(spark, classify.categorize, text).subcategory == "Check"
    assert one(spark, lambda c: classify.categorize(c, F.lit("ZELLE")), text).category == "Uncategorized"
    assert one(spark, lambda c: classify.categorize(c, F.lit("CHECK")), text).subcategory == "Check"


CHANNELS = [
    ("Online Banking transfer from SAV 1 Confirmation# 12", "ONLINE_BANKING_TRANSFER", "transfer_from_sav"), ("Zelle payment to Bob Conf# ab12", "ZELLE", "payment_to_Bob"), ("Zelle", "ZELLE", None), ("CHECKCARD 0101 X", "CHECKCARD", None),
    ("PURCHASE X", "PURCHASE", None), ("Check 12", "CHECK", None), ("MONTHLY MAINTENANCE", "FEE", None), ("hello", "OTHER", None), ("BKOFAMERICA ATM #000012345 01/01 DEPOSIT", "ATM_DEPOSIT", None),
]


@pytest.mark.parametrize(("text", "kind", "sub"), CHANNELS)
def test_channels(spark, text, kind, sub):
    got = one(spark, classify.channel, text)
    assert (got.type, got.subtype) == (kind, sub)


def test_reference_types_and_feed(spark):
    assert one(spark, lambda c: classify.bank_reference(c, F.lit("CHECKCARD")), "CHECKCARD 0101 X CA 74906415217235530457986").card_trace == "74906415217235530457986"
    assert one(spark, lambda c: classify.bank_reference(c, F.lit("OTHER")), "CHECK 12").check_number is None
    assert one(spark, classify.csv_type, "check 12 paid", "debit") == "Check" and one(spark, classify.csv_type, "x", "credit") == "Credit"
    assert tuple(one(spark, classify.ofx_type, "CHECK # 77", "debit")) == ("CHECK", "77") and one(spark, classify.ofx_type, "ANNUAL FEE", "credit").type == "CREDIT"
    assert one(spark, classify.feed_category, "FOOD_AND_DRINK", "FOOD_AND_DRINK_COFFEE").subcategory == "Restaurants" and one(spark, classify.feed_category, "TRAVEL", "nope").category == "Travel" and one(spark, classify.feed_category, None, None) is None


def test_merchant(spark):
    df = spark.createDataFrame([("CHECKCARD 0601 STARBUCKS STORE 123 SEATTLE WA",), ("PURCHASE JOES DINER 800-555-1234 AUSTIN TX",), ("x",), (None,)], "description string")
    rows = {r.description: r for r in classify.with_merchant(df, "description").collect()}
    a, b = rows["CHECKCARD 0601 STARBUCKS STORE 123 SEATTLE WA"], rows["PURCHASE JOES DINER 800-555-1234 AUSTIN TX"]
    assert a.normalized_name == "Starbucks" and a.state == "WA" and b.phone == "800-555-1234" and rows["x"].name is None and rows[None].name is None

