from ledgerloom.functions.scalars import month_number, statement_year
from ledgerloom.operators import positions
from ledgerloom.sources import files, parsers
from ledgerloom.streaming import progress
from pyspark.sql import functions as F
from test_statement_files import FEB, lines

DETAILS = "Some Bank | Online Banking | Deposit | Print Transaction Details\n01/05/2024 COFFEE Debit Card -$4.50"


def test_files_go_to_the_parser_that_knows_them(spark):
    df = lines(spark, a_pdf=[FEB], b_pdf=[DETAILS], c_csv=["2024-01-02;tea;-3.00\n2024-01-03;pay;9.00"], d_pdf=["prose"])
    assert {r.file: r.parser for r in parsers.detected(df).collect()} == {"a.pdf": "statement", "b.pdf": "details", "c.csv": None, "d.pdf": None}

    def parse(own):
        p = F.split("line", ";")
        return own.select("file", "page", "line_index", p[0].cast("date").alias("date"), p[1].alias("description"), p[2].cast("double").alias("amount"), F.col("line").alias("original_text"))

    parsers.add("semicolons", lambda text: text.rlike(r"^\d{4}-\d\d-\d\d;"), parse)
    try:
        assert parsers.names() == ["details", "statement", "semicolons"]
        got = sorted((r.parser, r.file, str(r.date), r.amount) for r in parsers.parsed(df).collect())
        assert got == [("details", "b.pdf", "2024-01-05", -4.5), ("semicolons", "c.csv", "2024-01-02", -3.0), ("semicolons", "c.csv", "2024-01-03", 9.0), ("statement", "a.pdf", "2024-02-03", 10.0), ("statement", "a.pdf", "2024-02-09", -20.0), ("statement", "a.pdf", "2024-02-20", -0.5)]
    finally:
        parsers.remove("semicolons")
    assert parsers.parsed(df.limit(0)).count() == 0


def test_syncs_are_watched_and_stopped(spark, tmp_path):
    seen = []
    listener = progress.watch(spark, lambda *x: seen.append(x))
    try:
        spark.createDataFrame([(1,)], "x int").write.parquet(str(tmp_path / "in"))
        q = spark.readStream.schema("x int").parquet(str(tmp_path / "in")).writeStream.queryName("watched").format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        q.processAllAvailable()
        assert [s["name"] for s in progress.status(spark)] == ["watched"]
        assert progress.stop(q) and progress.status(spark) == []
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        kinds = [k for k, name, _ in seen if name == "watched"]
        assert kinds[0] == "started" and kinds[-1] == "complete" and ("importing", "watched", 1) in seen
    finally:
        spark.streams.removeListener(listener)


def test_month_and_year(spark):
    r = spark.createDataFrame([("January", "2024-02-28"), ("dec", None), ("x", None)], "m string, d string").select(month_number(F.col("m")).alias("m"), statement_year(F.col("d").cast("date")).alias("y")).collect()
    assert [tuple(x) for x in r] == [(1, 2024), (12, None), (None, None)]


def test_folders_and_whole_texts(spark, tmp_path):
    (tmp_path / "f").write_text("x")
    assert [files.folder_problem(spark, str(tmp_path / x)) for x in ("", "f", "none")] == [None, "no folder", "missing"]
    df = spark.createDataFrame([("a", 2, 0, "c"), ("a", 1, 1, "b"), ("a", 1, 0, "a"), ("e", 1, 0, "")], "file string, page int, line_index int, line string")
    assert {r.file: (r.pages, r.text) for r in files.document_text(df).collect()} == {"a": (2, "a\nb\nc"), "e": (1, "")}


def test_feed_documents(spark):
    raw = lambda *x: spark.createDataFrame([(t,) for t in x], "value string")
    a = positions.account_rows(raw('{"account_id": "a", "type": "credit", "balances": {"current": 5.5}}', "{", '{"name": "none"}')).collect()
    assert [(r.account_id, r.balance_current, r.balance_limit, r.iso_currency_code) for r in a] == [("a", 5.5, None, "USD")]
    h = positions.holding_rows(raw('{"account_id": "a", "security_id": "s", "quantity": 2, "institution_price": 3}', '{"account_id": "a"}')).collect()
    assert [(r.value, r.cost_basis) for r in h] == [(6.0, None)]
    rows = raw(*[f'{{"investment_transaction_id": "{i}", "date": "2024-01-0{i}", "amount": {i}}}' for i in range(1, 5)], '{"investment_transaction_id": "x", "date": "no"}')
    day = lambda d: F.lit(d).cast("date")
    assert positions.investment_rows(rows).count() == 5
    assert sorted(r.amount for r in positions.investment_rows(rows, day("2024-01-02"), day("2024-01-03")).collect()) == [2.0, 3.0]
