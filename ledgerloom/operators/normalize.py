"""Statement rows in the ledger's terms: sign and direction by section, cleaned text, ids, flags, categories.

Rows have date, amount (as printed), description and section; everything is a column expression, so a
table of any size is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import classify

# Sections of statements under the name that rows keep; others are none.
SECTIONS = {"deposits": "deposits", "atm_debit": "atm_debit", "withdrawals": "atm_debit", "other_subtractions": "other_subtractions", "checks": "checks", "service_fees": "service_fees", "fees": "service_fees"}
# Sections of outflows, the trace number at a line's end, and what marks a subscription.
OUTFLOWS = ("atm_debit", "other_subtractions", "checks", "service_fees")
TRACE_NUMBER = r"[\s\p{Z}]+\d{17,25}$"
SUBSCRIPTIONS = ("netflix", "spotify", "hulu", "disney", "hbo", r"apple\s*(music|tv|one)", r"youtube\s*premium", r"amazon\s*prime", "audible")
FEES = ("Fees", "Bank", 0.95)
UNVERIFIED = "****0000"


def schema_section(section: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return F.try_element_at(known, section)


def direction(amount: Column, section: Column, credit_card: Column) -> Column:
    """credit or debit. A card's printed amount is a debit unless negative; elsewhere the section decides, then the sign."""
    by_sign = lambda up, down: F.when(amount >= 0, up).otherwise(down)
    by_section = F.when(F.coalesce(section, F.lit("")).isin(*OUTFLOWS), "debit").when(F.coalesce(section, F.lit("")) == "deposits", "credit").otherwise(by_sign("credit", "debit"))
    return F.when(credit_card, by_sign("debit", "credit")).otherwise(by_section)


def signed(amount: Column, direction_: Column) -> Column:
    return F.when(direction_ == "debit", -F.abs(amount)).otherwise(F.abs(amount))


def clean(description: Column) -> Column:
    """Without a trace number at its end, blanks collapsed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(description, TRACE_NUMBER, ""), r"[\s\p{Z}]{2,}", " "), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def plain_number(amount: Column) -> Column:
    """A decimal without zeros at its end, as it stands in an id."""
    return F.regexp_replace(F.regexp_replace(amount.cast("decimal(14,2)").cast("string"), "0+$", ""), r"\.$", "")


def row_key(statement: Column, day: Column, amount: Column, text: Column) -> Column:
    """32 hex digits over statement, day, amount and cleaned text."""
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(statement, F.lit("")), day.cast("string"), plain_number(amount), text), 256), 1, 32)


def flags(channel: Column, description: Column) -> dict[str, Column]:
    """What a row is besides its category; false where it is not."""
    subscribed = F.coalesce(description.rlike("(?i)" + "|".join(SUBSCRIPTIONS)), F.lit(False))
    return {
        "is_transfer": channel.isin("ZELLE", "ONLINE_BANKING_TRANSFER"), "is_cash_withdrawal": channel == "ATM_WITHDRAWAL", "is_cash_deposit": channel.isin("ATM_DEPOSIT", "FINANCIAL_CENTER_DEPOSIT"),
        "is_subscription": subscribed, "is_recurring": subscribed,
    }


def rationale(rule_id: Column) -> Column:
    return F.when(rule_id.isNull(), "No matching rule found").otherwise(F.concat(F.lit("Matched rule: "), rule_id))


def normalized(rows: DataFrame) -> DataFrame:
    """Rows with amount, direction, section, clean description, key, channel, category, rationale and flags.

    rows: id, statement, date, amount, description, section, credit_card. Categories are found by the
    rules with the row's channel, over the text without its trace number.
    """
    x = rows.withColumn("channel", classify.channel(F.col("description"), F.col("section"))["type"])
    x = x.withColumn("text", F.trim(F.regexp_replace("description", TRACE_NUMBER, "")))
    x = classify.with_category(x.withColumn("channel_", F.col("channel")), "text", "channel_").drop("channel_", "text")
    side = direction(F.col("amount"), F.col("section"), F.col("credit_card"))
    x = x.withColumn("direction", side).withColumn("amount", signed(F.col("amount"), F.col("direction"))).withColumn("text", clean(F.col("description")))
    x = x.withColumn("row_key", row_key(F.col("statement"), F.col("date"), F.col("amount"), F.col("text")))
    return x.select(
        "id", "date", F.col("amount").cast("double").alias("amount"), "direction", F.col("text").alias("description"), schema_section(F.col("section")).alias("section"), "row_key", "channel",
        "category", "subcategory", "confidence", "rule_id", rationale(F.col("rule_id")).alias("rationale"), *[v.alias(k) for k, v in flags(F.col("channel"), F.col("description")).items()],
    )


def flat(rows: DataFrame) -> DataFrame:
    """Rows by the older rules: direction by the sign alone, and whatever stands among the fees is a bank fee."""
    x = classify.with_category(rows, "description", older=True)
    side = direction(F.col("amount"), F.lit(None).cast("string"), F.col("credit_card"))
    fee = F.coalesce(F.col("section") == "fees", F.lit(False))
    forced = lambda i, c: F.when(fee, FEES[i]).otherwise(F.col(c))
    return x.select("id", "date", signed(F.col("amount"), side).cast("double").alias("amount"), side.alias("direction"), "description", forced(0, "category").alias("category"), forced(1, "subcategory").alias("subcategory"), forced(2, "confidence").alias("confidence"))


def strict_warnings(statements: DataFrame) -> DataFrame:
    """(id, warning) of statements: account_number_masked, period and balances, totals, transaction_count."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(14,2)")
    reckoned = zero("starting_balance") + zero("total_credits") - F.abs(zero("total_debits"))
    found = F.array_compact(F.array(
        F.when(F.coalesce("account_number_masked", F.lit(UNVERIFIED)) == UNVERIFIED, "STRICT: Account number could not be verified"),
        F.when(F.col("period_start").isNull() | F.col("period_end").isNull(), "STRICT: Statement period could not be verified"),
        F.when((zero("starting_balance") == 0) & (zero("ending_balance") == 0), "STRICT: Both starting and ending balances are zero"),
        F.when(F.coalesce("transaction_count", F.lit(0)) == 0, "STRICT: No transactions were parsed"),
        F.when(F.abs(reckoned - zero("ending_balance")) > 0.01, F.concat(F.lit("STRICT: Balance mismatch - calculated "), plain_number(reckoned), F.lit(", reported "), plain_number(zero("ending_balance")))),
    ))
    return statements.select("id", F.explode(found).alias("warning"))


# Kinds of rows of an activity list by words, first match first.
DETAIL_WORDS = (("Debit Card", ("debit card", "purchase")), ("Transfer", ("transfer", "zelle")), ("Check", ("check ",)), ("Deposit", ("deposit", "atm")), ("Bank Charge", ("fee", "charge")), ("Virtual Card", ("virtual card",)))


def detail_type(description: Column) -> Column:
    text = F.lower(description)
    out = None
    for name, words in DETAIL_WORDS:
        hit = F.contains(text, F.lit(words[0]))
        for w in words[1:]:
            hit |= F.contains(text, F.lit(w))
        if name == "Check":
            hit |= text.rlike(r"check\s+\d+")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def detail_section(kind: Column, amount: Column) -> Column:
    """The section a row of an activity list would stand in, by its kind and sign."""
    k = F.lower(kind)
    return (
        F.when(F.contains(k, F.lit("fee")) | F.contains(k, F.lit("charge")), "fees").when(k == "check", "checks")
        .when((k == "deposit") | ((k == "transfer") & (amount >= 0)), "deposits").when(amount < 0, "withdrawals").otherwise("other")
    )
