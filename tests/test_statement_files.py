from datetime import date

from ledgerloom.sources import batch, files, layout
from ledgerloom.sources import statement_lines as sl
from pyspark.sql import functions as F

LINES = "file string, page int, line_index int, line string"


def lines(spark, **texts):
    rows = [(f.replace("_", "."), p, i, t) for f, pages in texts.items() for p, page in enumerate(pages, 1) for i, t in enumerate(page.strip().split("\n"))]
    return spark.createDataFrame(rows, LINES)


def month(n, last, start, end, rows):
    return f"""
Your Advantage Plus Banking
for {n} 1, 2024 to {n} {last}, 2024 Account number: 0000 1111 4242
Account summary
Beginning balance on {n} 1, 2024 ${start}
Deposits and other additions
{rows[0]}
Withdrawals and other subtractions
{rows[1]}
Service fees
{rows[2]}
Daily ending balance
Ending balance on {n} {last}, 2024 ${end}
"""


JAN = month("January", 31, "1,000.00", "1,150.00", ("01/05/24 PAYROLL ACME 500.00", "01/10/24 GROCER 245.00\n02/02/24 NEXT MONTH 7.00", "01/31/24 MONTHLY FEE 105.00"))
FEB = month("February", 29, "1,150.00", "1,140.00", ("02/03/24 REFUND 10.00", "02/09/24 BOOKS 20.00", "02/20/24 WIRE FEE 0.50"))


def test_several_statements_in_one_file(spark):
    s, r = batch.parsed(lines(spark, two_pdf=["Cover page", JAN, FEB], one_pdf=[FEB], none_pdf=["Your Advantage Plus Banking\n02/03/24 LOOSE ROW 1.00"]))
    got = {x.file: x for x in s.collect()}
    assert set(got) == {"two.pdf#1", "two.pdf#2", "one.pdf#1", "none.pdf#1"}
    a, b = got["two.pdf#1"], got["two.pdf#2"]
    assert (a.period_start, a.period_end, a.starting_balance, a.ending_balance) == (date(2024, 1, 1), date(2024, 1, 31), 1000.0, 1150.0)
    assert (a.total_credits, a.total_debits, a.transaction_count, a.account_number_masked) == (500.0, 350.0, 3, "****4242")
    assert (b.period_start, b.total_credits, b.total_debits, b.source, b.part) == (date(2024, 2, 1), 10.0, 20.5, "two.pdf", 2)
    rows = sorted((x.file, str(x.date), x.amount) for x in r.where("source = 'two.pdf'").collect())
    assert rows == [("two.pdf#1", "2024-01-05", 500.0), ("two.pdf#1", "2024-01-10", -245.0), ("two.pdf#1", "2024-01-31", -105.0), ("two.pdf#2", "2024-02-03", 10.0), ("two.pdf#2", "2024-02-09", -20.0), ("two.pdf#2", "2024-02-20", -0.5)]


def test_batch_keeps_going_past_bad_files(spark):
    ok = lines(spark, good_pdf=[JAN], blank_pdf=[" "], prose_pdf=["Dear reader,\nnothing here"])
    listed = spark.createDataFrame([("good.pdf", None), ("blank.pdf", None), ("prose.pdf", None), ("~$x.pdf", "temporary"), ("gone.pdf", None)], "name string, skipped string")
    s, r, e = batch.batch(ok, listed)
    errors = {x.file: x.error for x in e.collect()}
    assert set(errors) == {"blank.pdf", "prose.pdf", "~$x.pdf", "gone.pdf"} and errors["prose.pdf"].startswith("No transactions found")
    assert {x.file: x.f for x in e.select("file", batch.is_foreign(F.col("error")).alias("f")).collect()} == {"blank.pdf": False, "prose.pdf": True, "~$x.pdf": False, "gone.pdf": False}
    assert r.count() == 3 and batch.batch_summary(listed, s, e).first().asDict() == {"files_found": 5, "files_read": 1, "files_failed": 4, "statements_found": 3, "duplicates_removed": 0}
    assert [x.count() for x in batch.batch(ok.limit(0), listed.limit(0))] == [0, 0, 0]


def test_credit_card_headers(spark):
    text = """Credit card statement
Account number ending in 9876
Statement closing date: March 15, 2024
Minimum payment due
Previous balance $200.00
New balance -$5.00
New balance $150.25
Payments and other credits
03/01 03/02 THANK YOU 100.00
Purchases and adjustments
02/20 02/21 BOOKS 45.25
Purchases $50.25
Fees charged
03/10 LATE FEE 5.00
"""
    h = sl.headers(lines(spark, card_pdf=[text])).first()
    assert (h.kind, h.account_number_masked, h.period_start, h.period_end) == ("credit", "****9876", date(2024, 2, 16), date(2024, 3, 15))
    assert (h.starting_balance, h.ending_balance, h.total_debits) == (200.0, 150.25, 50.25)
    s, r = batch.parsed(lines(spark, card_pdf=[text]))
    assert sorted(x.amount for x in r.collect()) == [-100.0, 5.0, 45.25] and (s.first().total_credits, s.first().total_debits) == (100.0, 50.25)


def tokens(spark, *rows):
    return spark.createDataFrame([("f", 1, t, float(x), float(y), 6.0 * len(t)) for y, items in rows for x, t in items], "file string, page int, str string, x double, y double, width double")


def test_layout_statement(spark):
    t = tokens(
        spark, (790, [(50, "Account # 0000 1234")]), (780, [(50, "January 1, 2024 to January 31, 2024")]), (770, [(50, "Beginning balance"), (400, "$100.00")]), (760, [(50, "Ending balance"), (400, "$90.00")]),
        (750, [(50, "Total service fees"), (400, "-$2.50")]), (745, [(50, "Total ATM and debit card subtractions"), (400, "-$7.50")]), (740, [(50, "01/02/24"), (150, "BEFORE ANY SECTION"), (400, "1.00")]),
        (730, [(50, "Deposits and other additions")]), (725, [(50, "Date"), (150, "Description"), (400, "Amount")]), (720, [(50, "01/05/24"), (150, "PAY"), (400, "20.00")]), (715, [(150, "FROM ACME")]),
        (700, [(50, "Other subtractions")]), (690, [(50, "01/06/24"), (150, "BOOKS"), (400, "7.50")]), (680, [(50, "Total other subtractions"), (400, "1.00")]), (670, [(50, "Daily ending balance")]), (660, [(50, "01/31/24"), (150, "x"), (400, "90.00")]),
    )
    s, r = layout.statements(t)
    h = s.first()
    assert (h.account_number_masked, h.period_start, h.starting_balance, h.ending_balance, h.total_debits) == ("****1234", date(2024, 1, 1), 100.0, 90.0, 11.0)
    assert [(x.section, str(x.date), x.description, x.amount) for x in r.collect()] == [("other", "2024-01-06", "BOOKS", -7.5)]  # the first one's amount doesn't end its row
    rows = layout.sorted_items(files.token_rows(t))
    cols = {c.name: (c.left, c.right) for c in layout.table_columns(rows).collect()}
    assert cols == {"date": (45.0, 110.0), "description": (110.0, 395.0), "amount": (395.0, 612.0)}
    triples = [(x.date, x.description, x.amount) for x in layout.row_triples(layout.rows_between(rows, 685, 695)).collect()]
    assert triples == [("01/06/24", "BOOKS", "7.50")] and layout.rows_of_page(rows, 2).count() == 0


def test_row_triples_from_glued_items(spark):
    rows = layout.sorted_items(files.token_rows(tokens(spark, (700, [(50, "03/15/25 SHOP"), (200, "9.99"), (300, "extra"), (400, "-5.50")]), (680, [(50, "no date"), (400, "1.00")]), (660, [(50, "03/16"), (400, "none")]))))
    assert [(x.date, x.description, x.amount) for x in layout.row_triples(rows).collect()] == [("03/15/25", "SHOP 9.99 extra", "-5.50")]
