"""Statements from tokens with positions: rows, columns, header fields and transactions of pages.

An alternative to lines where the layout counts: tokens (file, page, str, x, y, width) become rows, and
rows are read by their place on the page. Only checking statements are printed so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.classify import extract
from ledgerloom.functions.scalars import parse_amount, parse_us_date
from ledgerloom.sources import files
from ledgerloom.sources import statement_lines as sl

# Offsets of columns from their heads, and the page's width.
DATE_LEFT, DATE_RIGHT, AMOUNT_LEFT, PAGE_WIDTH = 5.0, 60.0, 5.0, 612.0
DATE, MONEY = r"^\d{2}/\d{2}(?:/\d{2,4})?", r"-?[\d,]+\.\d{2}$"
ROW = rf"^(\d{{2}}/\d{{2}}(?:/\d{{2,4}})?)\s*(.+?)\s*({sl.AMOUNT})$"
# Section headers in the order in which they are tried.
SECTIONS = (
    ("deposits", r"deposits\s+and\s+(?:other\s+)?additions"), ("withdrawals", r"withdrawals\s+and\s+(?:other\s+)?subtractions|ATM\s+and\s+debit\s+card\s+subtractions"),
    ("other", r"other\s+subtractions"), ("checks", r"checks\s*$"), ("fees", r"service\s+fees"), ("none", r"daily\s+(?:ending\s+)?balance"),
)
#: Sections whose amounts are outflows.
OUTFLOWS = ("withdrawals", "checks", "fees", "other")
_MONEY = r".*?\$?([0-9,]+\.\d{2})"
FIELDS = {
    "starting_balance": rf"(?i)(?:Beginning|Starting|Previous)\s+balance{_MONEY}", "ending_balance": rf"(?i)(?:Ending|Closing|New)\s+balance{_MONEY}", "total_credits": rf"(?i)Total\s+deposits\s+and\s+other\s+additions{_MONEY}",
    "debits_card": rf"(?i)Total\s+ATM\s+and\s+debit\s+card\s+subtractions{_MONEY}", "debits_other": rf"(?i)Total\s+other\s+subtractions{_MONEY}", "debits_fees": rf"(?i)Total\s+service\s+fees{_MONEY}",
}


def sorted_items(rows: DataFrame) -> DataFrame:
    """Rows with their items from left to right."""
    by_x = F.array_sort(F.transform("items", lambda t: F.struct(t["x"].alias("x"), t["str"].alias("str"), t["width"].alias("width"))))
    return rows.withColumn("items", F.transform(by_x, lambda t: F.struct(t["str"].alias("str"), t["x"].alias("x"), t["width"].alias("width"))))


def rows_between(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Rows whose height on the page lies in a closed range."""
    return rows.where(F.col("y").between(low, high))


def rows_of_page(rows: DataFrame, page: int) -> DataFrame:
    return rows.where(F.col("page") == page)


def table_columns(rows: DataFrame) -> DataFrame:
    """(file, page, name, left, right): date, description and amount columns by the first row that heads a table of transactions."""
    text = F.lower("text")
    head = F.contains(text, F.lit("date")) & (F.contains(text, F.lit("description")) | F.contains(text, F.lit("transaction")))
    at = lambda word: F.get(F.filter("items", lambda t: F.contains(F.lower(t["str"]), F.lit(word))), F.lit(0))["x"]
    x = rows.where(head).withColumn("d", at("date")).withColumn("a", at("amount")).where("d is not null and a is not null")
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("page", "row"))).where("n = 1")
    col = lambda name, left, right: F.struct(F.lit(name).alias("name"), left.alias("left"), right.alias("right"))
    d, a = F.col("d"), F.col("a")
    columns = F.array(col("date", d - DATE_LEFT, d + DATE_RIGHT), col("description", d + DATE_RIGHT, a - AMOUNT_LEFT), col("amount", a - AMOUNT_LEFT, F.lit(PAGE_WIDTH)))
    return x.select("file", "page", F.explode(columns).alias("c")).select("file", "page", "c.*")


def row_triples(rows: DataFrame) -> DataFrame:
    """(file, page, row, date, description, amount): of rows that begin with a date the rightmost amount and what stands between."""
    texts = F.transform("items", lambda t: t["str"])
    day = F.regexp_extract(F.col("texts")[0], DATE, 0)
    places = F.filter(F.transform("texts", lambda t, i: F.when(t.rlike(MONEY), i)), lambda i: i.isNotNull())
    x = rows.withColumn("texts", texts).where(F.size("texts") > 0).withColumn("date", day).withColumn("last", F.array_max(places)).where("date != '' and last is not null")
    first = F.trim(F.substring(F.col("texts")[0], F.length("date") + 1, F.length(F.col("texts")[0])))
    rest = F.when(F.col("last") > 0, F.filter(F.concat(F.array(first), F.slice("texts", 2, F.greatest(F.col("last") - 1, F.lit(0)))), lambda t: t != "")).otherwise(F.array().cast("array<string>"))
    return x.select("file", "page", "row", "date", F.trim(F.array_join(rest, " ")).alias("description"), F.regexp_extract(F.col("texts")[F.col("last")], MONEY, 0).alias("amount"))


def headers(rows: DataFrame) -> DataFrame:
    """(file, account_number_masked, period_start, period_end, balances, totals, warnings): the last match of each field wins, printed outflows add up."""
    order = F.struct("page", "row")
    got = lambda pattern: extract(F.col("text"), pattern)
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), order))
    x = rows.select("file", "page", "row", "text", got(r"(?i)Account\s*#?\s*[\d\s]*(\d{4})").alias("account"), got(sl.FIELDS["period_start"]).alias("a"), got(sl.FIELDS["period_end"]).alias("b"), *[parse_amount(got(p)).alias(k) for k, p in FIELDS.items()])
    h = x.groupBy("file").agg(
        last(F.col("account")).alias("account"), last(F.col("a")).alias("a"), last(F.col("b")).alias("b"), *[last(F.col(k)).alias(k) for k in ("starting_balance", "ending_balance", "total_credits")],
        *[F.sum(F.col(k).cast("decimal(14,2)")).alias(k) for k in FIELDS if k.startswith("debits")],
    )
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    warnings = F.array_compact(F.array(F.when(F.col("account").isNull(), "no account number"), F.when(F.col("a").isNull(), "no statement period"), F.when(zero("starting_balance") == 0, "no beginning balance"), F.when(zero("ending_balance") == 0, "no ending balance")))
    return h.select(
        "file", F.concat(F.lit("****"), F.coalesce("account", F.lit("0000"))).alias("account_number_masked"), sl._long_day(F.col("a")).alias("period_start"), sl._long_day(F.col("b")).alias("period_end"), zero("starting_balance").alias("starting_balance"),
        zero("ending_balance").alias("ending_balance"), zero("total_credits").alias("total_credits"), (zero("debits_card") + zero("debits_other") + zero("debits_fees")).alias("total_debits"), warnings.alias("warnings"),
    )


def transactions(rows: DataFrame, head: DataFrame) -> DataFrame:
    """(file, page, row, section, date, description, amount, original_text): rows within sections; others are skipped.

    A row without a date goes on from the dated one above it, unless a header or a total comes between.
    """
    x = rows.select("file", "page", "row", F.trim("text").alias("text")).where("text != ''").join(head.select("file", "period_end"), "file")
    section = None
    for name, pattern in SECTIONS:
        hit = F.col("text").rlike("(?i)" + pattern)
        section = F.when(hit, name) if section is None else section.when(hit, name)
    dated, total = F.col("text").rlike(DATE), F.col("text").rlike(r"(?i)^Total\s+")
    x = x.withColumn("head", F.when(~dated & ~total, section)).withColumn("starts", dated | total | F.col("head").isNotNull())
    w = Window.partitionBy("file").orderBy("page", "row").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(w), F.lit("none"))).withColumn("g", F.sum(F.col("starts").cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("page", "row", "text")))
    x = x.groupBy("file", "g", "section", "period_end").agg(parts.alias("p")).where(F.col("p")[0]["text"].rlike(DATE) & (F.col("section") != "none"))
    x = x.select("file", "section", "period_end", F.col("p")[0]["page"].alias("page"), F.col("p")[0]["row"].alias("row"), F.array_join(F.transform("p", lambda r: r["text"]), " ").alias("text"))
    t = F.col("text")
    check = F.when(t.rlike(sl.CHECK_ROW), F.struct(F.regexp_extract(t, sl.CHECK_ROW, 1).alias("day"), F.concat(F.lit("Check #"), F.regexp_extract(t, sl.CHECK_ROW, 2)).alias("description"), F.regexp_extract(t, sl.CHECK_ROW, 3).alias("amount"), F.lit(True).alias("out")))
    plain = F.when(t.rlike(ROW), F.struct(F.regexp_extract(t, ROW, 1).alias("day"), F.trim(F.regexp_extract(t, ROW, 2)).alias("description"), F.regexp_extract(t, ROW, 3).alias("amount"), F.col("section").isin(*OUTFLOWS).alias("out")))
    x = x.withColumn("r", F.coalesce(check, plain)).where("r is not null")
    size = parse_amount(F.col("r.amount"))
    return x.select("file", "page", "row", "section", parse_us_date(F.col("r.day"), F.year("period_end")).alias("date"), F.col("r.description").alias("description"), F.when(F.col("r.out"), -F.abs(size)).otherwise(size).alias("amount"), F.col("text").alias("original_text"))


def statements(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements, transactions) of files of tokens."""
    rows = sorted_items(files.token_rows(tokens))
    head = headers(rows)
    found = transactions(rows, head)
    n = found.groupBy("file").agg(F.count("*").alias("transaction_count"))
    out = head.join(n, "file", "left").withColumn("transaction_count", F.coalesce("transaction_count", F.lit(0)))
    return out.withColumn("warnings", F.when(F.col("transaction_count") == 0, F.concat("warnings", F.array(F.lit("no transactions")))).otherwise(F.col("warnings"))), found
