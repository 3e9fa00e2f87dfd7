"""Classification of bank lines: category rules, channels, references, merchants, export types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.category_rules import FEED_CATEGORIES, OLDER_RULES, RULES, entries
from ledgerloom.functions.literals import matches
from ledgerloom.functions.scalars import even_spaces

# Channels by pattern, first match first; `section` names the statement section that also decides.
CHANNELS = (
    ("ONLINE_BANKING_TRANSFER", "transfer_from_sav", r"Online Banking transfer from SAV.*?Confirmation#\s*(\d+)", None),
    ("ONLINE_BANKING_TRANSFER", "transfer_to_sav", r"Online Banking transfer to SAV.*?Confirmation#\s*(\d+)", None),
    ("ONLINE_BANKING_TRANSFER", None, r"Online Banking (transfer|payment).*?Confirmation#\s*(\d+)", None),
    ("ATM_DEPOSIT", None, r"BKOFAMERICA\s+ATM\s+#?(\d+)\s+.*?DEPOSIT", None),
    ("ATM_WITHDRAWAL", None, r"ATM\s+#?(\d+)?.*?(WITHDRWL|WITHDRAWAL)", None),
    ("ZELLE", "person", r"Zelle", None),
    ("FINANCIAL_CENTER_DEPOSIT", None, r"(FINANCIAL CENTER|BRANCH)\s+DEPOSIT", None),
    ("CHECK", None, r"^(Check\s*#?\s*)?(\d{1,6})$|CHECK\s*#?\s*(\d+)", "checks"),
    ("FEE", None, r"SERVICE\s+FEE|MONTHLY\s+MAINTENANCE|OVERDRAFT|NSF\s+FEE|RETURNED\s+ITEM", "service_fees"),
    ("CHECKCARD", None, r"CHECKCARD\s+\d{4}", None),
    ("PURCHASE", None, r"^(PURCHASE|POS)\s+", None),
    ("ATM_WITHDRAWAL", None, r"BKOFAMERICA\s+ATM\s+#?(\d+)", None),
)
PERSON = r"Zelle\s+(?:payment|transfer)\s+(?:from|to)\s+(.+?)\s+Conf#\s*\w+"
# References by name, channels they belong to, and pattern.
REFERENCES = (
    ("card_trace", ("CHECKCARD",), r"(\d{17,25})$"),
    ("confirmation", ("ONLINE_BANKING_TRANSFER",), r"(?i)Confirmation#?\s*(\d+)"),
    ("person_confirmation", ("ZELLE",), r"(?i)Conf#\s*(\w+)"),
    ("atm_id", ("ATM_DEPOSIT", "ATM_WITHDRAWAL"), r"(?i)ATM\s+#?(\d{6,12})"),
    ("check_number", ("CHECK",), r"(?i)(?:Check\s*#?\s*|^)(\d{1,6})(?:\s|$)"),
)
# Export types by words of the description in upper case, first match first.
CSV_TYPES = (
    ("ATM", ("ATM",)),
    ("Transfer", ("ZELLE", "TRANSFER", "XFER", "WIRE")),
    ("Deposit", ("DEPOSIT", "DIRECT DEP", "PAYROLL")),
    ("Fee", ("FEE", "SERVICE CHARGE")),
    ("Interest", ("INTEREST",)),
    ("Purchase", ("CHECKCARD", "PURCHASE", "POS")),
    ("Payment", ("PAYMENT", "BILL PAY", "ACH")),
)
OFX_TYPES = (
    ("ATM", ("ATM", "CASH WITHDRAWAL")),
    ("XFER", ("ZELLE", "TRANSFER", "XFER", "WIRE")),
    ("DEP", ("DEPOSIT", "DIRECT DEP", "PAYROLL")),
    ("FEE", ("FEE", "SERVICE CHARGE", "MONTHLY MAINTENANCE", "OVERDRAFT")),
    ("INT", ("INTEREST",)),
    ("POS", ("CHECKCARD", "PURCHASE", "POS", "DEBIT CARD")),
    ("PAYMENT", ("PAYMENT", "BILL PAY", "ACH", "AUTOPAY")),
)
OFX_CHECK = r"CHECK\s*#?\s*(\d+)|^(\d{1,6})\s*$"
# States, brands and marks of merchants' lines.
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
BRANDS = (
    ("AMZN", "Amazon"), ("AMAZON", "Amazon"), ("STARBUCKS", "Starbucks"), ("SBUX", "Starbucks"), ("MCDONALD", "McDonald's"), ("WALMART", "Walmart"), ("WAL-MART", "Walmart"), ("TARGET", "Target"),
    ("COSTCO", "Costco"), ("UBER", "Uber"), ("LYFT", "Lyft"), ("DOORDASH", "DoorDash"), ("GRUBHUB", "Grubhub"), ("NETFLIX", "Netflix"), ("SPOTIFY", "Spotify"), ("APPLE", "Apple"), ("GOOGLE", "Google"),
    ("PAYPAL", "PayPal"), ("VENMO", "Venmo"), ("ZELLE", "Zelle"),
)
ONLINE = r"\.COM\b|\.NET\b|\.ORG\b|\*[A-Z0-9]+|AMZN|AMAZON|PAYPAL|GOOGLE\s*\*|NETFLIX|SPOTIFY|UBER\s*\*?EATS|DOORDASH|GRUBHUB|INSTACART"
NETWORKS = (("VISA", r"\bVISA\b"), ("MASTERCARD", r"\bMASTERCARD\b"), ("AMEX", r"\bAMEX\b|\bAMERICAN\s*EXPRESS\b"), ("DISCOVER", r"\bDISCOVER\b"))
PHONE = r"\b(\d{3}[-.]?\d{3}[-.]?\d{4})\b"
LINE_PREFIXES = (r"^CHECKCARD\s+\d{4}\s+", r"^PURCHASE\s+", r"^POS\s+", r"^DEBIT\s+", r"^RECURRING\s+", r"^PREAUTHORIZED\s+")
LINE_SUFFIXES = (r"\s+\d{17,25}$", r"\s+CARD\s+\d{4}$")

UNCATEGORIZED = "Uncategorized"


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _choice(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """One CASE in the given order."""
    out = None
    for when, then in cases:
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(otherwise)


def _rule_place(description: Column, channel: Column | None) -> tuple[Column, list[tuple]]:
    text = F.lower(F.trim(even_spaces(description)))
    rules = sorted(entries(RULES, 8), key=lambda r: int(r[1]))
    cases = []
    for i, r in enumerate(rules):
        hit = matches(text, r[5])
        if r[6]:
            hit &= ~matches(text, r[6])
        if r[7] and channel is not None:
            hit &= channel.isNull() | channel.isin(*r[7].split())
        cases.append((hit, F.lit(i)))
    return _choice(cases, F.lit(len(rules))), [(r[2], r[3], float(r[4]), r[0]) for r in rules]


def _older_place(description: Column) -> tuple[Column, list[tuple]]:
    text = F.lower(F.trim(even_spaces(description)))
    rules = entries(OLDER_RULES, 4)
    return _choice([(matches(text, r[3]), F.lit(i)) for i, r in enumerate(rules)], F.lit(len(rules))), [(r[0], r[1], float(r[2]), str(i)) for i, r in enumerate(rules)]


def categorize(description: Column, channel: Column | None = None) -> Column:
    """A struct of category, subcategory, confidence, rule_id by the rules, as one CASE over the rule's place.

    A rule's channels restrict it only where a channel is given. Over tables with_category is faster.
    """
    return _picked(*_rule_place(description, channel))


def categorize_older(description: Column) -> Column:
    """The same by the older rules, which have no ids; a rule is named by its place."""
    return _picked(*_older_place(description))


def with_category(df: DataFrame, description: str, channel: str | None = None, older: bool = False) -> DataFrame:
    """df with category, subcategory, confidence and rule_id.

    The text is tidied and the rule found in projections of their own, so that each happens once a row.
    """
    df = df.withColumn("_line", F.lower(F.trim(even_spaces(F.col(description)))))
    place, rows = _older_place(F.col("_line")) if older else _rule_place(F.col("_line"), F.col(channel) if channel else None)
    df = df.withColumn("_place", place).withColumn("_rule", _picked(F.col("_place"), rows))
    return df.select(*[c for c in df.columns if c not in ("_line", "_place", "_rule")], "_rule.*")


def _picked(place: Column, rows: list[tuple[str, str, float, str | None]]) -> Column:
    """The rule at that place; the place behind the last one means none."""
    rows = [*rows, (UNCATEGORIZED, "", 0.5, None)]
    of = lambda i: F.array(*[F.lit(r[i] or None) for r in rows])[place]
    return F.struct(of(0).alias("category"), of(1).cast("string").alias("subcategory"), of(2).alias("confidence"), of(3).cast("string").alias("rule_id"))


def rules_table(spark: SparkSession) -> DataFrame:
    """(rule_id, priority, category, subcategory, confidence, pattern, exclusion, channels) of every rule; channels are set apart by blanks."""
    rows = [(r[0], int(r[1]), r[2], r[3], float(r[4]), r[5], r[6] or None, r[7] or None) for r in entries(RULES, 8)]
    return spark.createDataFrame(rows, "rule_id string, priority int, category string, subcategory string, confidence double, pattern string, exclusion string, channels string")


def rule(rule_id: str) -> list[str] | None:
    """The rule of an id; None if there is none."""
    return next((r for r in entries(RULES, 8) if r[0] == rule_id), None)


def by_rules(df: DataFrame, description: str, rules: list[tuple[str, int, str, str, float, str, str, str]]) -> DataFrame:
    """with_category() by rules of one's own, each (id, priority, category, subcategory, confidence, pattern, exclusion, channels)."""
    rules = sorted(rules, key=lambda r: r[1])
    text = F.col("_line")
    hits = [(matches(text, r[5]) & ~matches(text, r[6]) if r[6] else matches(text, r[5]), F.lit(i)) for i, r in enumerate(rules)]
    place = _choice(hits, F.lit(len(rules))) if hits else F.lit(0)
    return df.withColumn("_line", F.lower(F.trim(even_spaces(F.col(description))))).withColumn("_place", place).withColumn("_rule", _picked(F.col("_place"), [(r[2], r[3], float(r[4]), r[0]) for r in rules])).select(*df.columns, "_rule.*")


def recategorized(rows: DataFrame, learned: str = "learned") -> DataFrame:
    """rows, with category, subcategory and confidence of the struct `learned` (also source) where that is a learned one and better.

    Only results whose source is ml or hybrid count, and only for rows that are uncategorized or less sure.
    """
    new = lambda c: F.col(f"{learned}.{c}")
    better = F.coalesce(new("source").isin("ml", "hybrid") & ((F.col("category") == UNCATEGORIZED) | (new("confidence") > F.col("confidence"))), F.lit(False))
    changed = {c: F.when(better, new(c)).otherwise(F.col(c)) for c in ("category", "subcategory", "confidence")}
    return rows.withColumns(changed | {"recategorized": better}).drop(learned)


def feed_category(primary: Column, detailed: Column) -> Column:
    """A struct of category, subcategory, confidence: by the detailed feed category, else the primary; null if neither is known."""
    rows = {r[0]: r[1:] for r in entries(FEED_CATEGORIES, 4)}
    known = F.create_map(*[x for k, r in rows.items() for x in (F.lit(k), F.struct(F.lit(r[0]).alias("category"), F.lit(r[1] or None).cast("string").alias("subcategory"), F.lit(float(r[2])).alias("confidence")))])
    return F.coalesce(F.try_element_at(known, F.coalesce(detailed, F.lit(""))), F.try_element_at(known, F.coalesce(primary, F.lit(""))))


def channel(description: Column, section: Column | None = None) -> Column:
    """A struct of type and subtype."""
    text = F.trim(even_spaces(description))
    cases = []
    for kind, sub, pattern, by_section in CHANNELS:
        hit = text.rlike("(?i)" + pattern)
        if by_section and section is not None:
            hit |= F.coalesce(section == by_section, F.lit(False))
        subtype = F.lit(sub).cast("string")
        if sub == "person":
            who = extract(text, "(?i)" + PERSON)
            subtype = F.concat(F.lit("payment_"), F.when(F.contains(F.lower(text), F.lit("from")), "from").otherwise("to"), F.lit("_"), F.trim(who))
        cases.append((hit, F.struct(F.lit(kind).alias("type"), subtype.alias("subtype"))))
    return _choice(cases, F.struct(F.lit("OTHER").alias("type"), F.lit(None).cast("string").alias("subtype")))


def bank_reference(description: Column, kind: Column) -> Column:
    """A struct of references; each only for its channels."""
    text = even_spaces(description)
    return F.struct(*[F.when(kind.isin(*kinds), extract(text, pattern)).alias(name) for name, kinds, pattern in REFERENCES])


def _by_words(description: Column, table: tuple) -> list[tuple[Column, Column]]:
    text = F.upper(description)
    out = []
    for name, words in table:
        hit = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            hit |= F.contains(text, F.lit(w))
        out.append((hit, F.lit(name)))
    return out


def csv_type(description: Column, direction: Column) -> Column:
    check = F.contains(F.upper(description), F.lit("CHECK")) & description.rlike(r"\d")
    return _choice([(check, F.lit("Check")), *_by_words(description, CSV_TYPES)], F.when(direction == "credit", "Credit").otherwise("Debit"))


def ofx_type(description: Column, direction: Column) -> Column:
    """A struct of the type and, for checks, the number. Fees that come in are credits."""
    text = F.upper(description)
    number = F.coalesce(extract(text, OFX_CHECK, 1), extract(text, OFX_CHECK, 2))
    kind = _choice([(number.isNotNull(), F.lit("CHECK")), *_by_words(description, OFX_TYPES)], F.when(direction == "credit", "CREDIT").otherwise("DEBIT"))
    kind = F.when((kind == "FEE") & (direction != "debit"), "CREDIT").otherwise(kind)
    return F.struct(kind.alias("type"), number.alias("check_number"))


def with_merchant(df: DataFrame, description: str) -> DataFrame:
    """df with name, normalized_name, city, state, phone, online and network of its bank lines.

    The steps are projections of their own: one nested expression would repeat each step many times over.
    """
    states = "|".join(STATES)
    slash, end = rf"\b([A-Z][A-Za-z\s]+)/({states})\b", rf"\b([A-Z][A-Za-z\s]+)\s+({states})\s*$"
    fixes = "|".join(f"(?:{p})" for p in LINE_SUFFIXES)
    text, rest, name = F.col("_text"), F.col("_rest"), F.col("name")
    out = df.withColumn("_text", F.trim(even_spaces(F.col(description))))
    for p in LINE_PREFIXES:
        out = out.withColumn("_text", F.regexp_replace("_text", "(?i)" + p, ""))
    out = out.withColumn("_text", F.trim(F.regexp_replace("_text", "(?i)" + fixes, "")))
    tail = F.substring(F.rtrim(text), -2, 2).isin(*STATES)
    out = out.withColumn("_at", F.when(F.contains(text, F.lit("/")) & text.rlike(slash), 1).when(tail & text.rlike(end), 2).otherwise(0))
    place = lambda group: F.when(F.col("_at") == 1, F.regexp_extract(text, slash, group)).when(F.col("_at") == 2, F.regexp_extract(text, end, group))
    out = out.withColumns({"city": F.trim(place(1)), "state": place(2), "phone": extract(text, PHONE)})
    out = out.withColumn("_rest", F.trim(F.when(F.col("_at") == 1, F.regexp_replace(text, slash, "")).when(F.col("_at") == 2, F.regexp_replace(text, end, "")).otherwise(text)))
    out = out.withColumn("_rest", F.when(rest == "", text).otherwise(rest))
    out = out.withColumn("_rest", F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\d{2}/\d{2}|\*+\d+", ""), r"\s{2,}", " "), PHONE, "")))
    words = F.trim(F.regexp_replace(F.array_join(F.slice(F.split(rest, r"\s+"), 1, 5), " "), r"[^A-Za-z0-9\s&'.\-#]", ""))
    out = out.withColumns({"_lead": F.trim(F.regexp_extract(rest, r"(?i)^([A-Z][A-Z0-9\s&'.\-#]+?)(?:\s+\d|$)", 1)), "_words": words})
    out = out.withColumn("name", F.when(F.length("_lead") > 2, F.col("_lead")).when(F.length("_words") > 2, F.col("_words")))
    out = out.withColumn("_upper", F.upper("name"))
    brand = _choice([(F.contains(F.col("_upper"), F.lit(k)), F.lit(v)) for k, v in BRANDS], F.initcap(F.regexp_replace(name, r"\s+", " ")))
    line = F.col("_line")
    network = _choice([(matches(line, p), F.lit(n)) for n, p in NETWORKS], F.lit(None).cast("string"))
    out = out.withColumn("_line", F.upper(description))
    out = out.withColumns({"normalized_name": F.when(name.isNotNull(), brand), "online": matches(line, ONLINE), "network": network})
    return out.drop("_line", "_text", "_at", "_rest", "_lead", "_words", "_upper")
