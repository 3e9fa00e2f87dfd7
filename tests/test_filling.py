import json
from datetime import date, datetime

import pytest
from ledgerloom.functions import classify
from ledgerloom.operators import gaps, importing, items
from ledgerloom.sinks import ddl, exports
from ledgerloom.sources import retry
from ledgerloom.streaming import cursor, sync
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def d(m, n):
    return date(2024, m, n)


def test_gap_cache_and_filling(spark):
    ranges = "account string, start date, end date"
    known = spark.createDataFrame([("a", d(2, 1), d(2, 29)), ("b", d(1, 1), d(4, 30))], ranges)
    cache = spark.createDataFrame([("a", d(3, 1), d(3, 10), T0)], ranges + ", checked_at timestamp")
    open_ = gaps.open_gaps(known, cache, F.lit(d(1, 1)), F.lit(d(4, 30)))
    assert sorted(tuple(r) for r in open_.collect()) == [("a", d(1, 1), d(1, 31)), ("a", d(3, 11), d(4, 30))]
    fetch, before = gaps.clamped(open_, spark.createDataFrame([("a", d(1, 20))], "account string, earliest date"))
    assert sorted(tuple(r) for r in fetch.collect()) == [("a", d(1, 20), d(1, 31)), ("a", d(3, 11), d(4, 30))] and [tuple(r) for r in before.collect()] == [("a", d(1, 1), d(1, 19))]
    feed = spark.createDataFrame([("a", d(2, 5)), ("a", d(4, 2)), ("b", d(1, 25))], "account string, date date")
    rows, empty = gaps.filled(fetch, feed)
    assert [tuple(r) for r in rows.collect()] == [("a", d(4, 2))] and [tuple(r) for r in empty.collect()] == [("a", d(1, 20), d(1, 31))]
    again = gaps.mark_checked(gaps.mark_checked(cache, empty, F.lit(T0)), empty, F.lit(datetime(2025, 1, 1)))
    assert again.count() == 2 and again.where("checked_at > '2024-06-01'").count() == 0
    known_first = spark.createDataFrame([("f", d(1, 5)), ("g", d(1, 6))], "feed_account string, earliest date")
    assert {r.feed_account: r.earliest for r in gaps.remember_earliest(known_first, known_first.where("feed_account = 'f'").withColumn("earliest", F.lit(d(1, 2)))).collect()} == {"f": d(1, 2), "g": d(1, 6)}
    assert gaps.filled(fetch.limit(0), feed)[0].count() == 0


def test_import_creates_what_is_absent_once(spark):
    key = "user_id string, institution string, account_type string, account_number_masked string"
    accounts = spark.createDataFrame([("A1", "u", "First", "checking", "****1")], "id string, " + key)
    statements = spark.createDataFrame([("S1", "u", "old")], "id string, user_id string, statement_id string")
    rows = spark.createDataFrame([("R1", "t1")], "id string, transaction_id string")
    parsed = spark.createDataFrame([("u", "First", "checking", "****1", "old"), ("u", "First", "checking", "****1", "new"), ("u", "First", "savings", "****1", "sav"), ("u", "First", "savings", "****1", "sav")], key + ", statement_id string")
    parsed_rows = spark.createDataFrame([("u", "old", "t1"), ("u", "new", "t2"), ("u", "new", "t2"), ("u", "sav", "t3"), ("u", "none", "t4")], "user_id string, statement_id string, transaction_id string")
    made = importing.imported(accounts, statements, rows, parsed, parsed_rows)
    assert {k: v.count() for k, v in made.items() if k != "links"} == {"accounts": 1, "statements": 2, "rows": 2}
    got = {r.transaction_id: r for r in made["rows"].collect()}
    assert set(got) == {"t2", "t3"} and got["t2"].account_id == "A1" and got["t3"].account_id == made["accounts"].first().id
    all_accounts = accounts.unionByName(made["accounts"].select(accounts.columns))
    twice = importing.imported(all_accounts, statements.unionByName(made["statements"].select(statements.columns)), rows.unionByName(made["rows"].select(rows.columns)), parsed, parsed_rows)
    assert [twice[k].count() for k in ("accounts", "statements", "rows")] == [0, 0, 0]
    assert importing.deleted(rows, rows.select("id")).count() == 0


def test_items(spark):
    i = spark.createDataFrame([("i", "u", "First", "active", None, None), ("j", "v", "Second", "active", "5", None)], items.SCHEMA)
    i = items.put(i, spark.createDataFrame([("j", "v", "Second", "error", "6", None), ("k", "u", "Third", "active", None, None)], items.SCHEMA))
    assert sorted((r.item_id, r.status, r.cursor) for r in i.collect()) == [("i", "active", None), ("j", "error", "6"), ("k", "active", None)]
    i = items.with_status(i, spark.createDataFrame([("i", "login_required")], "item_id string, status string"))
    i = items.with_cursor(i, spark.createDataFrame([("j", None), ("k", "9")], "item_id string, cursor string"), F.lit(T0))
    got = {r.item_id: (r.status, r.cursor, r.synced_at) for r in i.collect()}
    assert got == {"i": ("login_required", None, None), "j": ("error", None, T0), "k": ("active", "9", T0)}
    assert items.of_user(i, "u").count() == 2 and items.without(i, i.where("item_id = 'i'")).count() == 2


def test_retry_and_rate_limit():
    assert [retry.passes(retry.FeedError(code=c)) for c in ("INSTITUTION_DOWN", "INVALID")] == [True, False]
    assert [retry.passes(retry.FeedError(status=s)) for s in (429, 500, 599, 600, 404)] == [True, True, True, False, False] and not retry.passes(ValueError()) and not retry.passes(None)
    assert [retry.wait_s(n, chance=0) for n in (1, 2, 3)] == [1, 2, 4] and retry.wait_s(9) == 30 and 1 <= retry.wait_s(1) <= 1.3
    calls, pauses = [], []

    def fails(times, error):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return "ok"

        return call

    assert retry.retried(fails(3, retry.FeedError(status=503)), sleep=pauses.append) == "ok" and len(calls) == 4 and len(pauses) == 3
    calls.clear()
    with pytest.raises(retry.FeedError):
        retry.retried(fails(9, retry.FeedError(status=503)), sleep=pauses.append)
    assert len(calls) == 4
    calls.clear()
    with pytest.raises(ValueError):
        retry.retried(fails(9, ValueError("x")), sleep=pauses.append)
    assert len(calls) == 1
    clock = [0.0]
    limit = retry.RateLimit(2, 1, now=lambda: clock[0], sleep=lambda s: clock.__setitem__(0, clock[0] + s))
    for _ in range(4):
        limit.take()
    assert clock[0] == pytest.approx(2.0) and limit.available() == pytest.approx(0.0)


def test_cursor_feed(spark, tmp_path):
    pages, out, cp = (str(tmp_path / x) for x in ("pages", "out", "cp"))
    (tmp_path / "pages").mkdir()
    page = lambda n, **x: (tmp_path / "pages" / f"{n:05}.json").write_text(json.dumps(x))
    page(0, added=[{"transaction_id": "1", "account_id": "a", "date": "2024-01-02", "amount": 5, "name": "x"}], removed=[])
    page(1, modified=[{"transaction_id": "1", "amount": 6.5}], removed=[{"transaction_id": "0"}])
    spark.dataSource.register(cursor.CursorFeed)

    def run():
        spark.readStream.format("cursor_feed").option("pages", pages).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.seq, r.op, r.id, r.amount) for r in spark.read.parquet(out).collect())

    assert run() == [(0, "added", "1", 5.0), (1_000_000, "modified", "1", 6.5), (1_000_001, "removed", "0", None)]
    page(2, added=[{"transaction_id": "2", "amount": 1}])
    assert len(run()) == 4


def test_bucketed_sync_and_tombstones(spark, tmp_path):
    ledger, removed, inbox = (str(tmp_path / x) for x in ("ledger", "removed", "inbox"))
    sync.write_bucketed(spark.createDataFrame([(str(i), float(i)) for i in range(50)], "id string, amount double"), ledger, 8)
    sync.write_bucketed(spark.createDataFrame([("x",)], "id string"), removed, 8)
    schema = "op string, seq bigint, id string, amount double"
    spark.createDataFrame([("added", 1, "77", 7.0), ("modified", 2, "3", 9.0), ("removed", 3, "4", None)], schema).write.parquet(inbox)
    for cp in ("a", "b"):  # the same batch twice changes nothing
        sync.start_sync(sync.read_changes(spark, inbox, schema), ledger, removed, str(tmp_path / cp), buckets=8).awaitTermination(120)
    rows = spark.read.parquet(ledger).drop("bucket")
    assert rows.count() == 51 and rows.where("id = '3'").first().amount == 3.0
    view = {r.id: r.flags for r in sync.ledger_view(rows, spark.read.parquet(removed)).collect()}
    assert len(view) == 51 and [i for i, f in view.items() if "removed" in f] == ["4"]


def test_ddl(spark, tmp_path):
    name = "ledger_ddl_test"
    assert ddl.missing(spark, name) == list(ddl.TABLES)
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path}/db'")
    spark.sql(f"CREATE TABLE {name}.overrides (id STRING, user_id STRING) USING parquet LOCATION '{tmp_path}/o'")
    try:
        lacking = ddl.migrate(spark, name)
        assert "overrides.kind" in lacking and "accounts" in lacking and ddl.missing(spark, name) == [] and ddl.migrate(spark, name) == []
        assert spark.table(f"{name}.ledger_transactions").schema["amount"].dataType.simpleString() == "decimal(14,2)"
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


def test_account_lines_hold_every_row(spark, tmp_path):
    from test_sources_and_sinks import ledger

    rows, statements = ledger(spark)
    got = exports.account_lines(statements, rows).collect()
    docs = [json.loads(r.line) for r in got]
    head = next(x for x in docs if "schemaVersion" in x)
    assert head["totalStatements"] == 2 and head["totalTransactions"] == 3 and head["startingBalance"] == 1.0 and head["endingBalance"] is None
    assert {x["transactionId"]: x["statementId"] for x in docs if "transactionId" in x} == {"t1": "s1", "t2": "s1", "t3": None}
    big = spark.range(20_000).selectExpr("'a' as account_id", "date_add(date'2020-01-01', cast(id % 900 as int)) as date", "cast(id as string) as id", "cast(id as string) as line")
    exports.write_lines(big, str(tmp_path / "big"), by="account_id")
    assert spark.read.text(str(tmp_path / "big")).count() == 20_000


def test_rules_of_ones_own_and_recategorizing(spark):
    df = spark.createDataFrame([("1", "PAYROLL ACME"), ("2", "Tea and Coffee"), ("3", None)], "id string, description string")
    rules = [("b", 2, "Drinks", "Coffee", 0.9, "coffee", "", ""), ("a", 1, "Drinks", "Tea", 0.8, r"\btea\b", "green", "")]
    got = {r.id: (r.category, r.rule_id) for r in classify.by_rules(df, "description", rules).collect()}
    assert got["2"] == ("Drinks", "a") and got["1"] == got["3"] == ("Uncategorized", None)
    assert {r.category for r in classify.by_rules(df, "description", []).collect()} == {"Uncategorized"}
    assert classify.rule("income-payroll")[2] == "Income" and classify.rule("none") is None
    c = spark.createDataFrame([("Food", None, 0.9, ("Fuel", "x", 0.95, "ml")), ("Uncategorized", None, 0.9, ("Fuel", "x", 0.5, "hybrid")), ("Food", None, 0.9, ("Fuel", "x", 0.99, "rules")), ("Food", None, 0.9, ("Fuel", "x", 0.8, "ml"))], "category string, subcategory string, confidence double, learned struct<category:string,subcategory:string,confidence:double,source:string>")
    assert [(r.category, r.recategorized) for r in classify.recategorized(c).collect()] == [("Fuel", True), ("Fuel", True), ("Food", False), ("Food", False)]
