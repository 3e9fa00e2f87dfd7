"""Statements from lines of text: account kind, header fields and transactions.

Lines have file, page, line_index and line. Sections and unfinished rows are carried by windows over a
file's lines, a file being the bound of what is ordered together; grammars are rows of patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.classify import extract
from ledgerloom.functions.scalars import parse_amount, parse_us_date

# What tells the kind of account, in lower case.
DECISIVE = (("advantage savings", "savings"), ("advantage plus banking", "checking"))
SIGNS = {
    "credit": ("credit card", "card member", "minimum payment", "credit limit", "available credit", "cash advance", "purchase apr", "billing period"),
    "savings": ("annual percentage yield", "interest paid year to date", "apy earned"),
    "checking": ("checks paid", "daily ending balance", "check number", "checkcard", "atm and debit card", "online and mobile banking", "service fees"),
    "deposit": ("deposits and other additions", "withdrawals and other subtractions", "atm and debit card subtractions", "other subtractions", "beginning balance", "ending balance"),
}
# Section headers by kind of account; "none" ends a section.
SECTIONS = {
    "checking": (
        ("deposits", r"deposits\s+and\s+(other\s+)?additions"),
        ("withdrawals", r"withdrawals\s+and\s+(other\s+)?subtractions|ATM\s+and\s+debit\s+card\s+subtractions"),
        ("checks", r"checks\s*$"),
        ("fees", r"service\s+fees"),
        ("none", r"daily\s+(ending\s+)?balance"),
    ),
    "savings": (
        ("deposits", r"deposits\s+and\s+(other\s+)?additions"),
        ("withdrawals", r"withdrawals\s+and\s+(other\s+)?subtractions|ATM\s+and\s+debit\s+card\s+subtractions|other\s+subtractions"),
        ("fees", r"service\s+fees"),
        ("none", r"daily\s+(ending\s+)?balance"),
    ),
    "credit": (
        ("payments", r"payments\s+and\s+other\s+credits"),
        ("purchases", r"purchases\s+and\s+adjustments"),
        ("fees", r"^fees|fees\s+charged"),
        ("interest", r"interest\s+charged"),
    ),
}
# Sections of outflows by kind, and what a statement's head prints.
NEGATIVE = {"checking": ("withdrawals", "checks", "fees"), "savings": ("withdrawals", "fees"), "credit": ("payments",)}
_DAY = r"[A-Za-z]+\s+\d{1,2},?\s+\d{4}"
FIELDS = {
    "account": r"(?im)Account\s*(?:number)?\s*[#:]?\s*[\d\s*]*?(\d{4})\s*$",
    "period_start": rf"(?i)({_DAY})\s+to\s+{_DAY}",
    "period_end": rf"(?i){_DAY}\s+to\s+({_DAY})",
    "starting_balance": rf"(?i)(?:Beginning|Starting|Previous)\s+balance\s*(?:on\s+{_DAY})?\s*[:\s$]*\$?([0-9,]+\.\d{{2}})",
    "ending_balance": rf"(?i)(?:Ending|Closing|New)\s+balance\s*(?:on\s+{_DAY})?\s*[:\s$]*\$?([0-9,]+\.\d{{2}})",
    "credits": r"(?i)Total\s+deposits\s+and\s+other\s+additions\s*-?\$?([0-9,]+\.\d{2})",
    "debits_card": r"(?i)Total\s+ATM\s+and\s+debit\s+card\s+subtractions\s*-?\$?([0-9,]+\.\d{2})",
    "debits_other": r"(?i)Total\s+other\s+subtractions\s*-?\$?([0-9,]+\.\d{2})",
    "debits_fees": r"(?i)Total\s+service\s+fees\s*-?\$?([0-9,]+\.\d{2})",
}
# What a credit card's statement prints; a closing day alone stands for the month before it.
CREDIT_FIELDS = {
    "account": r"(?im)(?:Account|Card)\s*(?:number|#|:)?.*?(\d{4})\s*$",
    "period_start": rf"(?i)(?:Statement|Billing)\s+period\s*[:\s]*({_DAY})\s*(?:to|-|through)",
    "period_end": rf"(?i)(?:Statement|Billing)\s+period\s*[:\s]*{_DAY}\s*(?:to|-|through)\s*({_DAY})",
    "closing": rf"(?i)(?:Statement\s+(?:closing\s+)?date|Closing\s+date)\s*[:\s]*({_DAY})",
    "starting_balance": r"(?i)(?:Previous|Prior|Last)\s+(?:statement\s+)?balance\s*[:\s$]*(-?[0-9,]+\.\d{2})",
    "ending_balance": r"(?i)(?:New|Current|Statement)\s+balance\s*[:\s$]*(-?[0-9,]+\.\d{2})",
    "credits": r"(?i)(?:Payments|Credits)(?:\s+and\s+(?:other\s+)?credits)?\s*[:\s$]*(-?[0-9,]+\.\d{2})",
    "debits": r"(?i)(?:Purchases|Charges)(?:\s+and\s+adjustments)?\s*[:\s$]*(-?[0-9,]+\.\d{2})",
}
# Amounts and the forms of printed rows.
AMOUNT = r"-?[0-9,]+\.\d{2}"
CHECK_ROW = rf"^(\d{{2}}/\d{{2}}/\d{{2}})\s*(\d{{1,6}})({AMOUNT})$"
ROWS = (rf"^(\d{{1,2}}/\d{{1,2}})\s+(.+?)\s+({AMOUNT})$", rf"^(\d{{1,2}}/\d{{1,2}}/\d{{2,4}})\s+(.+?)\s+({AMOUNT})$", rf"^(\d{{2}}/\d{{2}}/\d{{2}})(.+?)({AMOUNT})$")
MANY_CHECKS = rf"(\d{{2}}/\d{{2}}/\d{{2}})\s+(\d{{1,6}})\s+({AMOUNT})"
# Numbers that run into an amount: a ten-digit confirmation, a trace of 17 to 25 digits before at most four.
CONFIRMATION = r"(?i)(Confirmation#\s*\d{10})(\d*,?\d*\.\d{2})$"
TRACE = r"(\s\d{19,23})(\d{1,4}\.\d{2})$"
PERSON_CODE = r"(?i)^(.*Zelle.*Conf#\s*)(\S+)$"


def account_kind(text: Column) -> Column:
    """credit, savings, checking or unknown, by decisive names, then by counted signs."""
    t = F.lower(text)
    count = lambda k: F.size(F.filter(F.array(*[F.lit(w) for w in SIGNS[k]]), lambda w: F.contains(t, w)))
    credit, savings, checking, deposit = (count(k) for k in ("credit", "savings", "checking", "deposit"))
    out = None
    for word, kind in DECISIVE:
        hit = F.contains(t, F.lit(word))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    out = out.when((credit > checking + savings) & (credit >= 2), "credit")
    return out.when((deposit >= 2) & (savings > checking), "savings").when(deposit >= 2, "checking").otherwise("unknown")


def _long_day(text: Column) -> Column:
    tidy = F.regexp_replace(F.regexp_replace(text, ",", ""), r"\s+", " ")
    month = F.initcap(F.substring(F.split_part(tidy, F.lit(" "), F.lit(1)), 1, 3))
    return F.try_to_timestamp(F.concat_ws(" ", month, F.split_part(tidy, F.lit(" "), F.lit(2)), F.split_part(tidy, F.lit(" "), F.lit(3))), F.lit("MMM d yyyy")).cast("date")


def headers(lines: DataFrame) -> DataFrame:
    """(file, kind, account_number_masked, period_start, period_end, balances, totals, warnings) of each file.

    A file without a period has none, and a warning; it is up to the caller to supply one.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "line_index", "line"))), lambda x: x["line"])
    text = lines.groupBy("file").agg(F.array_join(ordered, "\n").alias("text"))
    text = text.withColumn("kind", account_kind(F.col("text")))
    f, c = ({k: extract(F.col("text"), p) for k, p in fields.items()} for fields in (FIELDS, CREDIT_FIELDS))
    card = F.col("kind") == "credit"
    pick = lambda k: F.when(card, c[k]).otherwise(f[k])
    money = lambda x: F.coalesce(parse_amount(x), F.lit(0.0))
    closing = _long_day(c["closing"])
    start = F.when(card, F.coalesce(_long_day(c["period_start"]), F.date_add(F.add_months(closing, -1), 1))).otherwise(_long_day(f["period_start"]))
    end = F.when(card, F.coalesce(_long_day(c["period_end"]), closing)).otherwise(_long_day(f["period_end"]))
    balances = [pick(k) for k in ("starting_balance", "ending_balance")]
    missing = [F.when(pick("account").isNull(), "no account number"), F.when(start.isNull(), "no statement period"), F.when(balances[0].isNull(), "no beginning balance"), F.when(balances[1].isNull(), "no ending balance")]
    debits = money(f["debits_card"]) + money(f["debits_other"]) + money(f["debits_fees"])
    return text.select(
        "file", F.when(F.col("kind") == "unknown", "checking").otherwise(F.col("kind")).alias("kind"), F.concat(F.lit("****"), F.coalesce(pick("account"), F.lit("0000"))).alias("account_number_masked"),
        start.alias("period_start"), end.alias("period_end"), money(balances[0]).alias("starting_balance"), money(balances[1]).alias("ending_balance"),
        F.when(card, F.abs(money(c["credits"]))).otherwise(money(f["credits"])).alias("total_credits"), F.when(card, F.abs(money(c["debits"]))).otherwise(debits).alias("total_debits"),
        F.array_compact(F.array(*missing, F.when(F.col("kind") == "unknown", "unknown account kind"))).alias("warnings"),
    )


def _by_kind(kind: Column, of) -> Column:
    out = None
    for k in SECTIONS:
        out = F.when(kind == k, of(k)) if out is None else out.when(kind == k, of(k))
    return out


def _section(line: Column, kind: Column) -> Column:
    def of(k: str) -> Column:
        out = None
        for name, pattern in SECTIONS[k]:
            hit = line.rlike("(?i)" + pattern)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return _by_kind(kind, of)


def transactions(lines: DataFrame, head: DataFrame) -> DataFrame:
    """(file, page, line_index, section, date, description, amount, original_text) of each transaction row.

    A dated row without an amount is finished by a later line that is only an amount, unless a header,
    a total or another row comes between. Amounts in sections of outflows are negative. A day without a
    year takes the year of the statement's end.
    """
    x = lines.join(head.select("file", "kind", "period_end"), "file")
    line = F.regexp_replace(F.col("line"), r"^(\d{2}/\d{2}/\d{2})([A-Za-z0-9])", "$1 $2")
    x = x.withColumn("text", line).withColumn("header", _section(F.col("line"), F.col("kind"))).withColumn("total", F.col("line").rlike(r"(?i)^Total\s+"))
    x = x.withColumn("header", F.when(F.col("total"), F.lit(None)).otherwise(F.col("header")))
    w = Window.partitionBy("file").orderBy("page", "line_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("none")))
    t = F.col("text")
    x = x.withColumn("only_amount", F.trim(t).rlike(rf"^{AMOUNT}$")).withColumn("ends", t.rlike(rf"{AMOUNT}$"))
    x = x.withColumn("open", t.rlike(r"^\d{2}/\d{2}/\d{2}.+$") & ~F.col("ends") & F.col("header").isNull() & ~F.col("total"))
    row = t.rlike(r"^\d{1,2}/\d{1,2}") & F.col("ends")
    event = F.when(F.col("open"), F.struct(F.lit(True).alias("open"), t.alias("text"), F.col("page").alias("page"), F.col("line_index").alias("at")))
    closed = F.struct(F.lit(False).alias("open"), t.alias("text"), F.col("page").alias("page"), F.col("line_index").alias("at"))
    event = event.when(F.col("header").isNotNull() | F.col("total") | row | F.col("only_amount"), closed)
    x = x.withColumn("last", F.last(event, ignorenulls=True).over(before))
    merges = F.col("only_amount") & F.coalesce(F.col("last.open"), F.lit(False))
    x = x.withColumn("page", F.when(merges, F.col("last.page")).otherwise(F.col("page"))).withColumn("line_index", F.when(merges, F.col("last.at")).otherwise(F.col("line_index")))
    x = x.withColumn("text", F.when(merges, F.concat("last.text", F.trim(t))).otherwise(t)).where(merges | row)
    return _rows(x.where(F.col("header").isNull() & ~F.col("total")))


def _rows(x: DataFrame) -> DataFrame:
    t = F.col("text")
    many = F.when((F.col("section") == "checks") & t.rlike(MANY_CHECKS), F.transform(F.arrays_zip(*[F.regexp_extract_all(t, F.lit(MANY_CHECKS), F.lit(i)).alias(n) for i, n in ((1, "d"), (2, "n"), (3, "a"))]), lambda c: F.struct(c["d"].alias("day"), F.concat(F.lit("Check #"), c["n"]).alias("description"), c["a"].alias("amount"))))
    glued = F.coalesce(*[F.when(t.rlike(p), F.regexp_replace(t, p, "$1 $2")) for p in (CONFIRMATION, TRACE)], _person(t), t)
    x = x.withColumn("glued", glued).withColumn("many", many)
    g = F.col("glued")
    check = F.when(t.rlike(CHECK_ROW), F.struct(F.regexp_extract(t, CHECK_ROW, 1).alias("day"), F.concat(F.lit("Check #"), F.regexp_extract(t, CHECK_ROW, 2)).alias("description"), F.regexp_extract(t, CHECK_ROW, 3).alias("amount")))
    plain = [F.when(g.rlike(p), F.struct(F.regexp_extract(g, p, 1).alias("day"), F.trim(F.regexp_extract(g, p, 2)).alias("description"), F.regexp_extract(g, p, 3).alias("amount"))) for p in ROWS]
    one = F.coalesce(check, *plain)
    x = x.withColumn("r", F.explode(F.coalesce("many", F.when(one.isNotNull(), F.array(one)))))
    size = parse_amount(F.col("r.amount"))
    negative = _by_kind(F.col("kind"), lambda k: F.col("section").isin(*NEGATIVE[k])) | F.startswith("r.description", F.lit("Check #")) & F.col("text").rlike(rf"{CHECK_ROW}|{MANY_CHECKS}")
    day = parse_us_date(F.col("r.day"), F.year("period_end"))
    return x.select("file", "page", "line_index", "section", day.alias("date"), F.col("r.description").alias("description"), F.when(negative, -F.abs(size)).otherwise(size).alias("amount"), F.col("text").alias("original_text"))


def _person(t: Column) -> Column:
    """A code that runs into an amount: all cuts behind the code's last letter; with thousands marks the least amount, else the largest."""
    tail = F.regexp_extract(t, PERSON_CODE, 2)
    cuts = F.transform(F.sequence(F.lit(7), F.lit(13)), lambda i: F.struct(F.substring(tail, F.lit(1), i - 1).alias("code"), F.substring(tail, i, F.length(tail)).alias("amount")))
    ok = F.filter(cuts, lambda c: c["code"].rlike(r"[A-Za-z]") & ~F.endswith(c["code"], F.lit(",")) & c["amount"].rlike(r"^-?\d{1,3}(?:,\d{3})*\.\d{2}$"))
    worth = F.transform(ok, lambda c: F.struct(F.abs(parse_amount(c["amount"])).alias("v"), F.contains(c["amount"], F.lit(",")).alias("comma"), c["code"].alias("code"), c["amount"].alias("amount")))
    worth = F.filter(worth, lambda c: c["v"] > 0)
    with_comma = F.filter(worth, lambda c: c["comma"])
    best = F.when(F.size(with_comma) > 0, F.array_min(with_comma)).when(F.size(worth) > 0, F.array_max(worth))
    return F.when(t.rlike(PERSON_CODE) & best.isNotNull(), F.concat(F.regexp_extract(t, PERSON_CODE, 1), best["code"], F.lit(" "), best["amount"]))


def statements(lines: DataFrame) -> DataFrame:
    """Headers with counts and totals of the rows found; printed totals win where there are any."""
    head = headers(lines)
    rows = transactions(lines, head)
    sums = rows.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.when(F.col("amount") > 0, F.col("amount").cast("decimal(14,2)")).otherwise(F.lit(0))).cast("double").alias("c"), F.sum(F.when(F.col("amount") < 0, -F.col("amount").cast("decimal(14,2)")).otherwise(F.lit(0))).cast("double").alias("d"))
    filled = lambda c, s: F.when(F.col(c) == 0, F.coalesce(s, F.lit(0.0))).otherwise(F.col(c))
    out = head.join(sums, "file", "left")
    warn = F.array_compact(F.array(F.when(F.col("n").isNull(), "no transactions")))
    return out.withColumns({"total_credits": filled("total_credits", F.col("c")), "total_debits": filled("total_debits", F.col("d")), "transaction_count": F.coalesce("n", F.lit(0)), "warnings": F.concat("warnings", warn)}).drop("n", "c", "d")


def within_period(rows: DataFrame, head: DataFrame) -> DataFrame:
    """Rows within their statement's period; a period that lacks a bound keeps all."""
    x = rows.join(head.select("file", "period_start", "period_end"), "file")
    ok = F.col("period_start").isNull() | F.col("period_end").isNull() | F.col("date").between(F.col("period_start"), F.col("period_end"))
    return x.where(ok).drop("period_start", "period_end")


# ---- other grammars ----

DATED = r"^(\d{2}/\d{2}(?:/\d{2,4})?)\s*"
#: What goes on from a dated line: lower case, a place, or a short line.
GOES_ON = r"^[a-z]|^[A-Z]{2,}\s+[A-Z]{2}\s*$|^[A-Z0-9].{0,58}$"


def merged_lines(lines: DataFrame) -> DataFrame:
    """(file, page, line_index, date, description, amount, original_text): dated lines with what goes on from them.

    The description is all text of the row, the amount the last one in it. Lines before any date, and
    long ones that carry neither date nor amount, are left out.
    """
    x = lines.withColumn("t", F.trim("line")).where("t != ''")
    x = x.withColumn("dated", F.col("t").rlike(DATED)).withColumn("a", extract(F.col("t"), rf"({AMOUNT})$"))
    w = Window.partitionBy("file").orderBy("page", "line_index")
    x = x.withColumn("g", F.sum(F.col("dated").cast("int")).over(w)).where((F.col("g") > 0) & (F.col("dated") | F.col("a").isNotNull() | F.col("t").rlike(GOES_ON)))
    told = F.when(F.col("dated") | F.col("t").rlike(GOES_ON), F.col("t")).otherwise(F.trim(F.regexp_replace("t", rf"{AMOUNT}$", "")))
    parts = F.array_sort(F.collect_list(F.struct("page", "line_index", told.alias("t"), "a")))
    rows = x.groupBy("file", "g").agg(parts.alias("p"))
    texts = F.filter(F.transform("p", lambda r: r["t"]), lambda s: s != "")
    amounts = F.filter(F.transform("p", lambda r: r["a"]), lambda a: a.isNotNull())
    first = F.col("p")[0]
    return rows.select("file", first["page"].alias("page"), first["line_index"].alias("line_index"), F.regexp_extract(first["t"], DATED, 1).alias("date"), F.array_join(texts, " ").alias("description"), parse_amount(F.try_element_at(amounts, F.lit(-1))).alias("amount"), F.array_join(texts, "\n").alias("original_text"))


# A printed list of account activity.
DETAILS_KIND = r"(?i)Online Banking \| Deposit \| Print Transaction Details"
DETAILS_TYPES = "Debit Card|Transfer|Other|Check|Deposit|Virtual Card|Bank Charge|Credit"
DETAILS_ROW = rf"(?i)^(\d{{2}}/\d{{2}}/\d{{4}})\s+(.+?)\s+({DETAILS_TYPES})\s+(-?\$?[\d,]+\.\d{{2}})$"
DETAILS_PLAIN = r"^(\d{2}/\d{2}/\d{4})\s+(.+?)\s+(-?\$?[\d,]+\.\d{2})$"
DETAILS_SKIP = r"(?i)^Cleared$|^Pending$|^Posting date|^Transactions$|^View:|^https://|^\d+/\d+$|^\d{1,2}/\d{1,2}/\d{2},\s+\d{1,2}:\d{2}\s+[AP]M"
DETAILS_HEADS = r"(?i)^(Posting|Transactions|View|Balance|Showing)"


def is_details(text: Column) -> Column:
    """Whether a file's text is a list of account activity rather than a statement."""
    return text.rlike(DETAILS_KIND)


def details_rows(lines: DataFrame) -> DataFrame:
    """(file, page, line_index, date, description, type, amount, original_text) of a list of account activity.

    A row takes the short lines after it that are no heads; amounts keep their sign.
    """
    x = lines.withColumn("t", F.trim("line")).where("t != ''").where(~F.col("t").rlike(DETAILS_SKIP))
    t = F.col("t")
    cut = lambda p, d, s, k, a: F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, d).alias("day"), F.trim(F.regexp_extract(t, p, s)).alias("text"), F.regexp_extract(t, p, k).alias("type") if k else F.lit(None).cast("string").alias("type"), F.regexp_extract(t, p, a).alias("amount")))
    x = x.withColumn("row", F.coalesce(cut(DETAILS_ROW, 1, 2, 3, 4), cut(DETAILS_PLAIN, 1, 2, 0, 3)))
    w = Window.partitionBy("file").orderBy("page", "line_index")
    x = x.withColumn("g", F.sum(F.col("row").isNotNull().cast("int")).over(w)).where("g > 0")
    on = F.col("row").isNull() & ~t.rlike(r"^\d{2}/\d{2}/\d{4}") & ~t.rlike(r"\$[\d,]+\.\d{2}") & (F.length(t) < 50) & ~t.rlike(DETAILS_HEADS)
    parts = F.array_sort(F.collect_list(F.struct("page", "line_index", "row", "t")))
    rows = x.where(F.col("row").isNotNull() | on).groupBy("file", "g").agg(parts.alias("p"))
    head, rest = F.col("p")[0], F.transform(F.slice("p", 2, F.size("p")), lambda r: r["t"])
    return rows.select(
        "file", head["page"].alias("page"), head["line_index"].alias("line_index"), parse_us_date(head["row"]["day"], F.lit(None).cast("int")).alias("date"), F.array_join(F.concat(F.array(head["row"]["text"]), rest), " ").alias("description"),
        head["row"]["type"].alias("type"), parse_amount(head["row"]["amount"]).alias("amount"), F.array_join(F.concat(F.array(head["t"]), rest), " | ").alias("original_text"),
    )


def details_balance(rows: DataFrame, ending: DataFrame) -> DataFrame:
    """(file, starting_balance, ending_balance, total_credits, total_debits): the start is reckoned back from a known end, 0 without one."""
    sums = rows.groupBy("file").agg(F.sum(F.when(F.col("amount") > 0, F.col("amount").cast("decimal(14,2)")).otherwise(F.lit(0))).alias("c"), F.sum(F.when(F.col("amount") < 0, -F.col("amount").cast("decimal(14,2)")).otherwise(F.lit(0))).alias("d"))
    x = sums.join(ending.select("file", F.col("ending_balance").cast("decimal(14,2)").alias("e")), "file", "left").withColumn("e", F.coalesce("e", F.lit(0)))
    start = F.when(F.col("e") > 0, F.col("e") - F.col("c") + F.col("d")).otherwise(F.lit(0))
    return x.select("file", start.cast("double").alias("starting_balance"), F.col("e").cast("double").alias("ending_balance"), F.col("c").cast("double").alias("total_credits"), F.col("d").cast("double").alias("total_debits"))
