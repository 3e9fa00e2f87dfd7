"""Exports of the ledger as CSV lines, OFX blocks and nested JSON, built in generated code.

A file's text is gathered per account at most where the format needs one document for it; lines are
otherwise rows, written in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import classify
from ledgerloom.functions.scalars import csv_field, round_half_up, xml_text

# Columns of the CSV export by group.
CSV_BASE = ("Date", "Posted Date", "Description", "Merchant", "Amount", "Direction", "Type")
CSV_ACCOUNT = ("Account Type", "Account Number")
CSV_CATEGORY = ("Category", "Subcategory", "Confidence")
CSV_RAW = ("Transaction ID", "Statement ID", "Period", "Original Text", "Page")
OFX_ACCOUNTS = {"checking": "CHECKING", "savings": "SAVINGS", "credit": "CREDITLINE"}
OFX_NAME, OFX_MEMO = 32, 255


def day(c: Column, us: bool = False) -> Column:
    return F.coalesce(F.date_format(c, "MM/dd/yyyy" if us else "yyyy-MM-dd"), F.lit(""))


def signed(amount: Column, direction: Column) -> Column:
    """The size as a decimal of two places, negative unless a credit; zero has no sign."""
    size = F.abs(amount).cast("decimal(14,2)")
    return F.when((direction == "credit") | (size == 0), size).otherwise(-size).cast("string")


def csv_header(account: bool = True, categories: bool = True, raw: bool = False, delimiter: str = ",") -> str:
    return delimiter.join([*CSV_BASE, *(CSV_ACCOUNT if account else ()), *(CSV_CATEGORY if categories else ()), *(CSV_RAW if raw else ())])


def csv_lines(rows: DataFrame, account: bool = True, categories: bool = True, raw: bool = False, delimiter: str = ",", us_dates: bool = False) -> DataFrame:
    """(account_id, date, id, line) of each row.

    rows: id, account_id, date, posted_date, description, merchant, amount, direction, and for the
    groups account_type, account_number_masked; category, subcategory, confidence; statement_id,
    period_label, original_text, page.
    """
    f = lambda c: csv_field(c if isinstance(c, Column) else F.col(c), delimiter)
    cells = [day(F.col("date"), us_dates), day(F.col("posted_date"), us_dates), f("description"), f("merchant"), signed(F.col("amount"), F.col("direction")), f("direction"), classify.csv_type(F.col("description"), F.col("direction"))]
    if account:
        cells += [f("account_type"), f("account_number_masked")]
    if categories:
        cells += [f("category"), f("subcategory"), F.coalesce(round_half_up(F.col("confidence")).cast("decimal(6,2)").cast("string"), F.lit(""))]
    if raw:
        cells += [f(c) for c in ("id", "statement_id", "period_label", "original_text", "page")]
    return rows.select("account_id", "date", "id", F.concat_ws(delimiter, *cells).alias("line"))


def ofx_transaction(row_id: Column, description: Column, merchant: Column, amount: Column, direction: Column, posted: Column) -> Column:
    kind = classify.ofx_type(description, direction)
    name = F.when(F.coalesce(merchant, F.lit("")) != "", merchant).otherwise(description)
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    return F.concat_ws(
        "\n", F.lit("<STMTTRN>"), tag("TRNTYPE", kind["type"]), tag("DTPOSTED", F.date_format(posted, "yyyyMMdd")), tag("TRNAMT", signed(amount, direction)), tag("FITID", row_id),
        F.when(kind["check_number"].isNotNull(), tag("CHECKNUM", kind["check_number"])), tag("NAME", xml_text(name, OFX_NAME)), tag("MEMO", xml_text(description, OFX_MEMO)), F.lit("</STMTTRN>"),
    )


def ofx_blocks(rows: DataFrame, statements: DataFrame) -> DataFrame:
    """(account_id, statement_id, period_end, block): one statement block each; rows without a statement make none.

    rows: statement_db_id and what ofx_transaction takes; statements: id, account_id, period_start,
    period_end, ending_balance, account_type, account_number_masked, currency.
    """
    t = rows.where("statement_db_id is not null").select("statement_db_id", "date", "id", ofx_transaction(F.col("id"), F.col("description"), F.col("merchant"), F.col("amount"), F.col("direction"), F.coalesce("posted_date", "date")).alias("x"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "id", "x"))), lambda r: r["x"]), "\n")  # the rows of a statement
    t = t.groupBy(F.col("statement_db_id").alias("id")).agg(listed.alias("list"))
    kind = F.lit("CHECKING")
    for k, v in OFX_ACCOUNTS.items():
        kind = F.when(F.lower("account_type") == k, v).otherwise(kind)
    ymd = lambda c: F.date_format(c, "yyyyMMdd")
    lines = [
        F.lit("<STMTRS>"), F.concat(F.lit("<CURDEF>"), F.coalesce("currency", F.lit("USD")), F.lit("</CURDEF>")),
        F.concat(F.lit("<BANKACCTFROM><ACCTID>"), F.regexp_replace("account_number_masked", r"\*", "0"), F.lit("</ACCTID><ACCTTYPE>"), kind, F.lit("</ACCTTYPE></BANKACCTFROM>")),
        F.concat(F.lit("<BANKTRANLIST><DTSTART>"), ymd("period_start"), F.lit("</DTSTART><DTEND>"), ymd("period_end"), F.lit("</DTEND>")), F.col("list"), F.lit("</BANKTRANLIST>"),
        F.concat(F.lit("<LEDGERBAL><BALAMT>"), F.coalesce("ending_balance", F.lit(0)).cast("decimal(14,2)").cast("string"), F.lit("</BALAMT><DTASOF>"), ymd("period_end"), F.lit("</DTASOF></LEDGERBAL>")), F.lit("</STMTRS>"),
    ]
    return statements.join(t, "id").select("account_id", F.col("id").alias("statement_id"), "period_end", F.concat_ws("\n", *lines).alias("block"))


def ofx_header(server_time: str) -> str:
    """The head of an OFX 2.2 file; server_time as yyyymmddhhmmss."""
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<?OFX OFXHEADER="200" VERSION="220" SECURITY="NONE" OLDFILEUID="NONE" NEWFILEUID="NONE"?>\n<OFX>\n<SIGNONMSGSRSV1><SONRS>'
        f"<STATUS><CODE>0</CODE><SEVERITY>INFO</SEVERITY></STATUS><DTSERVER>{server_time}</DTSERVER><LANGUAGE>ENG</LANGUAGE></SONRS></SIGNONMSGSRSV1>\n<BANKMSGSRSV1>"
    )


OFX_FOOTER = "</BANKMSGSRSV1>\n</OFX>"


def nested(statements: DataFrame, rows: DataFrame, version: str = "v2") -> DataFrame:
    """(key, document): JSON of one statement (v1) or of one account with all its statements' rows (v2).

    v2 is for accounts whose rows fit a document; account_lines has no such bound.

    statements: id, account_id, institution, account_type, account_number_masked, currency, period and
    balances; rows: statement_db_id, id, date, posted_date, description, merchant, amount, direction,
    category, subcategory, confidence.
    """
    item = F.struct("date", "id", "posted_date", "description", "merchant", "amount", "direction", "category", "subcategory", "confidence")
    per = rows.where("statement_db_id is not null").groupBy(F.col("statement_db_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("transactions"))
    s = statements.join(per, "id", "left").withColumn("transactions", F.coalesce("transactions", F.array().cast(per.schema["transactions"].dataType)))
    about = F.struct("institution", "account_type", "account_number_masked", "currency")
    if version == "v1":
        doc = F.struct(F.lit("v1").alias("schemaVersion"), about.alias("account"), F.struct("period_start", "period_end").alias("period"), F.struct("starting_balance", "ending_balance", "total_credits", "total_debits").alias("summary"), "transactions")
        return s.select(F.col("id").alias("key"), F.to_json(doc).alias("document"))
    key = F.struct("period_start", "id")
    a = s.groupBy("account_id").agg(
        F.first(about).alias("account"), F.min("period_start").alias("start"), F.max("period_end").alias("end"), F.min_by("starting_balance", key).alias("startingBalance"), F.max_by("ending_balance", key).alias("endingBalance"),
        F.sum("total_credits").alias("totalCredits"), F.sum("total_debits").alias("totalDebits"), F.count("*").alias("totalStatements"), F.array_sort(F.flatten(F.collect_list("transactions"))).alias("transactions"),
    )
    doc = F.struct(
        F.lit("v2").alias("schemaVersion"), "account", F.struct("start", "end").alias("statementPeriod"), F.struct("startingBalance", "endingBalance", "totalCredits", "totalDebits").alias("summary"),
        "totalStatements", F.size("transactions").alias("totalTransactions"), "transactions",
    )
    return a.select(F.col("account_id").alias("key"), F.to_json(doc).alias("document"))


def account_lines(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """(account_id, date, id, line): each account as JSON lines, a line that describes it (without date and id) and one for each of its rows.

    Rows without a statement are there too. No line grows with the account, so one that holds a third of
    all rows is written by many tasks.
    """
    text = lambda doc: F.to_json(doc, {"ignoreNullFields": "false"})
    double = lambda c: F.col(c).cast("double")
    key = F.struct("period_start", "id")
    n = rows.groupBy("account_id").agg(F.count("*").alias("totalTransactions"))
    about = [F.any_value(c).alias(c) for c in ("institution", "account_type", "account_number_masked", "currency")]
    a = statements.groupBy("account_id").agg(*about, F.min("period_start").alias("start"), F.max("period_end").alias("end"), F.min_by(double("starting_balance"), key).alias("startingBalance"), F.max_by(double("ending_balance"), key).alias("endingBalance"),
        F.sum("total_credits").cast("double").alias("totalCredits"), F.sum("total_debits").cast("double").alias("totalDebits"), F.count("*").alias("totalStatements"))
    a = a.join(n, "account_id", "full").withColumn("totalTransactions", F.coalesce("totalTransactions", F.lit(0))).withColumn("totalStatements", F.coalesce("totalStatements", F.lit(0)))
    head = F.struct(F.lit("v2").alias("schemaVersion"), "institution", "account_type", "account_number_masked", "currency", "start", "end", "startingBalance", "endingBalance", "totalCredits", "totalDebits", "totalStatements", "totalTransactions")
    item = F.struct(
        F.col("id").alias("transactionId"), F.col("statement_db_id").alias("statementId"), "date", F.col("posted_date").alias("postedDate"), "description", "merchant", double("amount").alias("amount"), "direction", "category", "subcategory", F.nanvl("confidence", F.lit(None).cast("double")).alias("confidence")
    )
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return a.select("account_id", none("date", "date"), none("string", "id"), text(head).alias("line")).unionByName(rows.select("account_id", "date", "id", text(item).alias("line")))


def write_lines(lines: DataFrame, path: str, by: str | None = None) -> None:
    """Text files of a `line` column in the order of date and id, also from one file to the next; one folder for each `by`.

    Files are cut by ranges of their order, so what is frequent is spread over several.
    """
    keys = [*([by] if by else []), "date", "id"]
    out = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if by:
        out.select(by, F.col("line").alias("value")).write.partitionBy(by).mode("overwrite").text(path)
    else:
        out.select(F.col("line").alias("value")).write.mode("overwrite").text(path)
