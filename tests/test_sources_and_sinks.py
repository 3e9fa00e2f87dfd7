import json
from datetime import date, datetime
from decimal import Decimal

from ledgerloom.operators import ml_categorizer as ml
from ledgerloom.operators import positions, upsert
from ledgerloom.sinks import exports
from ledgerloom.sources import files
from ledgerloom.sources import statement_lines as sl
from ledgerloom.streaming import sync
from pyspark.sql import functions as F

STATEMENT = """First Bank
Checking Account Statement
Account number: ****5678

Statement period: January 1, 2024 to January 31, 2024

Beginning balance $1,000.00
Ending balance $1,150.00

Deposits and other additions
01/05 PAYROLL DIRECT DEP ACME CORP 500.00
01/15 VENMO PAYMENT FROM JOHN 50.00

Withdrawals and other subtractions
01/10 STARBUCKS STORE 12345 5.75
01/12 AMAZON.COM*ABC123 94.25
01/20 ATM WITHDRAWAL 200.00

Daily ending balance"""


def lines(spark, text, name="a.pdf"):
    return spark.createDataFrame([(name, 1, i, x) for i, x in enumerate(text.split("\n"))], "file string, page int, line_index int, line string")


def test_statement(spark):
    df = lines(spark, STATEMENT)
    s = sl.statements(df).first()
    assert (s.kind, s.account_number_masked, s.period_start, s.period_end) == ("checking", "****5678", date(2024, 1, 1), date(2024, 1, 31))
    assert (s.starting_balance, s.ending_balance, s.transaction_count, s.total_credits, s.total_debits, s.warnings) == (1000, 1150, 5, 550, 300, [])
    rows = sl.transactions(df, sl.headers(df)).orderBy("line_index").collect()
    assert [(r.section, r.date.day, r.amount) for r in rows] == [("deposits", 5, 500), ("deposits", 15, 50), ("withdrawals", 10, -5.75), ("withdrawals", 12, -94.25), ("withdrawals", 20, -200)]
    assert sl.within_period(sl.transactions(df, sl.headers(df)), sl.headers(df)).count() == 5


def test_glued_and_wrapped_rows(spark):
    text = STATEMENT.replace("01/20 ATM WITHDRAWAL 200.00", "03/17/257-ELEVEN STORE\n12.50\n01/21/24 Zelle payment to Bob Conf# T0ZGTJ9B91,000.00\n01/22/24 Zelle payment to Bob Conf# T0ZDL3WND950.00\n01/22/24 transfer Confirmation# 757982788977.98\n03/18/25 LATE\nTotal x 5.00\n9.00\nChecks\n11/06/25\t108\t-2,300.00\t12/08/25\t109\t2,300.00")
    df = lines(spark, text)
    rows = [(r.description, r.amount) for r in sl.transactions(df, sl.headers(df)).orderBy("line_index", "description").collect()][4:]
    assert rows == [("7-ELEVEN STORE", -12.5), ("Zelle payment to Bob Conf# T0ZGTJ9B9", -1000), ("Zelle payment to Bob Conf# T0ZDL3WND", -950), ("transfer Confirmation# 7579827889", -77.98), ("Check #108", -2300), ("Check #109", -2300)]


def test_other_kinds_and_nothing(spark):
    kinds = {"Advantage Savings": "savings", "credit card minimum payment credit limit": "credit", "beginning balance ending balance annual percentage yield": "savings", "hello": "unknown", "": "unknown"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    assert {r.t: r.k for r in df.select("t", sl.account_kind(F.col("t")).alias("k")).collect()} == kinds
    s = sl.statements(lines(spark, "nothing here")).first()
    assert s.kind == "checking" and s.transaction_count == 0 and len(s.warnings) == 6
    assert sl.statements(lines(spark, "x").limit(0)).count() == 0


def test_layout(spark):
    t = [("f", 1, s, float(x), float(y), 30.0) for s, x, y in (("Date", 50, 700), ("Amount", 400, 701), ("Description", 150, 700), ("03/15/25", 50, 680), ("STARBUCKS", 150, 680), ("-5.50", 400, 680), ("CITY", 150, 670))]
    tok = spark.createDataFrame(t, "file string, page int, str string, x double, y double, width double")
    rows = files.token_rows(tok).orderBy("row").collect()
    assert [r.text for r in rows] == ["Date Description Amount", "03/15/25 STARBUCKS -5.50", "CITY"] and len(rows[0]["items"]) == 3
    assert [r.text for r in files.wrapped_rows(files.token_rows(tok)).orderBy("row").collect()] == ["Date Description Amount", "03/15/25 STARBUCKS -5.50 CITY"]
    head = files.header_columns(tok.where("y >= 700"))
    assert {r.name: (r.left, r.right) for r in head.collect()} == {"date": (50, 149), "description": (150, 399), "amount": (400, 612)}
    assert {r.str: r.column for r in files.in_columns(tok.where("y = 680"), head).collect()} == {"03/15/25": "date", "STARBUCKS": "description", "-5.50": "amount"}
    assert sorted((r.left, r.tokens) for r in files.clustered_columns(tok).collect()) == [(50, 2), (150, 3), (400, 2)]
    assert files.tokens_to_lines([("a", 0, 10, 5), ("b", 30, 10, 5), ("c", 39, 10, 5), ("d", 0, 0, 5)]) == ["a\tb c", "d"]


def test_folder_scan(spark, tmp_path):
    for name, data in (("b.pdf", b"x"), ("A.PDF", b"yy"), ("~$t.pdf", b"z"), ("empty.pdf", b""), ("c.txt", b"t")):
        (tmp_path / name).write_bytes(data)
    got = {r["name"]: r.skipped for r in files.statement_files(spark, str(tmp_path)).collect()}
    assert got == {"b.pdf": None, "A.PDF": None, "~$t.pdf": "temporary", "empty.pdf": "empty"}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "s.txt").write_text("one\ntwo\fthree")
    assert sorted((r.page, r.line_index, r.line) for r in files.text_lines(spark, str(tmp_path / "t")).collect()) == [(1, 0, "one"), (1, 1, "two"), (2, 0, "three")]
    x = spark.createDataFrame([("a [b] c",), ("a [b",), ("none",)], "t string").select(files.between_markers(F.col("t"), "[", "]").alias("x"))
    assert [r.x for r in x.collect()] == ["b", "b", ""]


ROWS = "id string, account_id string, statement_db_id string, date date, posted_date date, description string, merchant string, amount decimal(14,2), direction string, category string, subcategory string, confidence double, account_type string, account_number_masked string"
STATEMENTS = "id string, account_id string, institution string, account_type string, account_number_masked string, currency string, period_start date, period_end date, starting_balance decimal(14,2), ending_balance decimal(14,2), total_credits decimal(14,2), total_debits decimal(14,2)"


def ledger(spark):
    rows = [
        ("t1", "a", "s1", date(2024, 1, 5), None, 'CHECK #12 "x", y', None, Decimal("-5.00"), "debit", "Checks", None, 0.9, "checking", "****1234"), ("t2", "a", "s1", date(2024, 1, 3), date(2024, 1, 4), "A & B", "Amber", Decimal("7.10"), "credit", None, None, None, "checking", "****1234"),
        ("t3", "a", None, date(2024, 2, 3), None, None, None, Decimal("0.00"), "debit", None, None, 0.575, "checking", "****1234"),
    ]
    s = [("s1", "a", "First", "checking", "****1234", None, date(2024, 1, 1), date(2024, 1, 31), Decimal(1), Decimal(2), Decimal(3), Decimal(4)), ("s2", "a", "First", "checking", "****1234", "USD", date(2024, 2, 1), date(2024, 2, 29), Decimal(2), None, None, None)]
    return spark.createDataFrame(rows, ROWS), spark.createDataFrame(s, STATEMENTS)


def test_exports(spark, tmp_path):
    rows, statements = ledger(spark)
    got = {r.id: r.line for r in exports.csv_lines(rows).collect()}
    assert got["t1"] == '2024-01-05,,"CHECK #12 ""x"", y",,-5.00,debit,Check,checking,****1234,Checks,,0.90'
    assert got["t3"].startswith("2024-02-03,,,,0.00,debit,") and got["t3"].endswith("0.57")
    assert exports.csv_header(raw=True).count(",") == 16 and exports.csv_header(False, False).count(",") == 6
    assert exports.csv_lines(rows, account=False, categories=False, delimiter=";", us_dates=True).where("id = 't2'").first().line == "01/03/2024;01/04/2024;A & B;Amber;7.10;credit;Credit"
    blocks = exports.ofx_blocks(rows, statements).collect()
    b = blocks[0].block
    assert len(blocks) == 1 and "<CHECKNUM>12</CHECKNUM>" in b and "<NAME>Amber</NAME>" in b and "A &amp; B" in b and b.index("t2") < b.index("t1") and "<ACCTID>00001234" in b
    doc = json.loads(exports.nested(statements, rows, "v2").first().document)
    assert doc["totalStatements"] == 2 and doc["totalTransactions"] == 2 and doc["summary"]["startingBalance"] == 1 and [t["id"] for t in doc["transactions"]] == ["t2", "t1"]
    assert exports.nested(statements, rows, "v1").count() == 2
    exports.write_lines(exports.csv_lines(rows), str(tmp_path / "out"), by="account_id")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [got["t2"], got["t1"], got["t3"]]


def test_upserts(spark):
    old = spark.createDataFrame([("1", "a", 1), ("2", "b", 1)], "id string, v string, seq int")
    new = spark.createDataFrame([("2", "B", 2), ("3", "c", 2), ("3", "c2", 3)], "id string, v string, seq int")
    assert sorted(r.v for r in upsert.inserted(old, new, ["id"]).collect()) == ["a", "b", "c", "c2"]  # a changed row is not updated
    assert sorted(r.v for r in upsert.replaced(old, new, ["id"], F.col("seq")).collect()) == ["B", "a", "c2"]
    once = upsert.inserted(old, new, ["id"])
    assert upsert.inserted(once, new, ["id"]).count() == once.count()
    gone = upsert.tombstoned(old.withColumn("flags", F.lit("{}")), new, "id")
    assert {r.id: r.flags for r in gone.collect()} == {"1": "{}", "2": '{"removed": true}'}


def test_sync_stream(spark, tmp_path):
    ledger_path, removed_path, inbox = (str(tmp_path / x) for x in ("ledger", "removed", "inbox"))
    spark.createDataFrame([("1", 5.0)], "id string, amount double").write.parquet(ledger_path)
    spark.createDataFrame([], "id string").write.parquet(removed_path)
    schema = "op string, seq bigint, id string, amount double"
    spark.createDataFrame([("added", 1, "2", 7.0), ("modified", 2, "1", 9.0), ("modified", 3, "2", 8.0), ("removed", 4, "1", None)], schema).write.parquet(inbox)
    seen = []
    for _ in range(2):  # the second run finds nothing new
        q = sync.start_sync(sync.read_changes(spark, inbox, schema), ledger_path, removed_path, str(tmp_path / "cp"), lambda n, c: seen.append((n, c)))
        q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(ledger_path).collect()) == [("1", 5.0), ("2", 8.0)]
    assert [r.id for r in spark.read.parquet(removed_path).collect()] == ["1"] and seen == [(0, 4)]


def test_item_states(spark):
    t = datetime(2024, 1, 1)
    e = spark.createDataFrame([("a", "error", t), ("a", "LOGIN_REPAIRED", t.replace(day=2)), ("b", "login_required", t), ("c", "noise", t)], "item_id string, kind string, at timestamp")
    states = sync.item_states(e)
    assert {r.item_id: r.status for r in states.collect()} == {"a": "active", "b": "login_required"}
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item_id string")
    assert sorted(r.item_id for r in sync.items_to_sync(items, states).collect()) == ["a", "c"]


def test_learned_categories(spark):
    data = ml.training_rows(spark, 1200)
    model = ml.fit(data, "id", "category")
    held = ml.training_rows(spark, 300, seed=99)
    out = ml.predict(model, held)
    assert out.where("ml_category = category").count() / 300 > 0.9
    assert ml.predict(model, held.select("id", "description").limit(0)).count() == 0
    c = spark.createDataFrame([("A", 0.95, "B", 0.99), ("Uncategorized", 0.5, "B", 0.7), ("A", 0.8, "A", 0.9), ("A", 0.75, "B", 0.95), ("A", 0.75, "B", 0.5)], "r string, rc double, m string, mc double")
    got = [tuple(x.c) for x in c.select(ml.combined(*[F.col(n) for n in ("r", "rc", "m", "mc")]).alias("c")).collect()]
    assert [(a, round(p, 3), s) for a, p, s in got] == [("A", 0.95, "rules"), ("B", 0.7, "ml"), ("A", 0.84, "hybrid"), ("B", 0.855, "ml"), ("A", 0.75, "rules")]


def test_positions(spark):
    h = spark.createDataFrame([("a", "s", 2.0, 150.0, 100.0), ("a", "t", 1.0, 5.0, None), ("z", "s", 1.0, 5.0, 0.0)], "account_id string, security_id string, quantity double, value double, cost_basis double")
    s = spark.createDataFrame([("s", "Fund", "F")], "security_id string, name string, ticker string")
    a = spark.createDataFrame([("a", "Main", "1234")], "account_id string, name string, mask string")
    g = positions.holding_gains(h, s, a)
    assert {(r.account_id, r.security_id): (r.gain, r.gain_percent) for r in g.collect()} == {("a", "s"): (50, 50), ("a", "t"): (None, None), ("z", "s"): (5, None)}
    assert {r.account_id: r.gain for r in positions.holding_totals(g).collect()} == {"a": 55, "z": 5}
    raw = spark.createDataFrame([('{"transaction_id": "1", "amount": 5.5, "date": "2024-01-02", "personal_finance_category": {"primary": "TRAVEL"}, "location": {"city": "X"}}',), ('{"transaction_id": "2", "amount": "bad", "date": "no"}',), ("{",)], "value string")
    rows = {r.transaction_id: r for r in positions.feed_rows(raw).collect()}
    assert rows["1"].date == date(2024, 1, 2) and rows["1"].primary == "TRAVEL" and rows["1"].city == "X" and rows["2"].date is None and rows["2"].amount is None
    o = spark.createDataFrame([("a", [(["A B", "C"], [("x@y", False), ("p@q", True)], [])])], "account_id string, owners array<struct<names:array<string>,emails:array<struct<data:string,primary:boolean>>,phones:array<struct<data:string,primary:boolean>>>>")
    r = positions.owners(o).first()
    assert (r.name, r.email, r.phone) == ("A B, C", "p@q", None)
    assert spark.range(1).select(positions.masked(F.lit("123456")).alias("m")).first().m == "**3456"


def test_merged_lines(spark):
    text = "Header of a page\n01/05 BIG STORE\nSEATTLE WA\n12.00\n01/06 SMALL SHOP 3.50\nx continues\n" + "LONG " * 30 + "\n01/07/24 NO AMOUNT"
    rows = sl.merged_lines(lines(spark, text)).orderBy("line_index").collect()
    assert [(r.date, r.description, r.amount) for r in rows] == [("01/05", "01/05 BIG STORE SEATTLE WA 12.00", 12.0), ("01/06", "01/06 SMALL SHOP 3.50 x continues", 3.5), ("01/07/24", "01/07/24 NO AMOUNT", None)]


def test_details(spark):
    text = "Some Bank | Online Banking | Deposit | Print Transaction Details\nShowing results\n01/05/2024 COFFEE PLACE Debit Card -$4.50\nGLENDALE CA\nCleared\n1/5\n01/06/2024 PAYROLL 500.00\nBalance now\n"
    df = lines(spark, text)
    assert df.select(sl.is_details(F.col("line")).alias("d")).first().d
    rows = sl.details_rows(df).orderBy("line_index").collect()
    assert [(r.date, r.description, r.type, r.amount) for r in rows] == [(date(2024, 1, 5), "COFFEE PLACE GLENDALE CA", "Debit Card", -4.5), (date(2024, 1, 6), "PAYROLL", None, 500.0)]
    b = sl.details_balance(sl.details_rows(df), spark.createDataFrame([("a.pdf", 1000.0)], "file string, ending_balance double")).first()
    assert (b.starting_balance, b.total_credits, b.total_debits) == (504.5, 500, 4.5)
