"""Reports of holdings, liabilities, identity and account numbers as a feed delivers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holding_gains(holdings: DataFrame, securities: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each holding with its security and account, gain and, where there is a cost above 0, gain in per cent.

    holdings: account_id, security_id, quantity, value, cost_basis. Unknown securities and accounts leave
    nulls.
    """
    x = holdings.join(securities.select("security_id", F.col("name").alias("security"), "ticker"), "security_id", "left").join(accounts.select("account_id", F.col("name").alias("account")), "account_id", "left")
    gain = F.col("value") - F.col("cost_basis")
    return x.withColumn("gain", gain).withColumn("gain_percent", F.when(F.col("cost_basis") > 0, F.round(gain / F.col("cost_basis") * 100, 2)))


def holding_totals(gains: DataFrame) -> DataFrame:
    """(account_id, value, cost, gain): a null cost counts as 0."""
    cost = F.coalesce(F.sum("cost_basis"), F.lit(0))
    return gains.groupBy("account_id").agg(F.sum("value").alias("value"), cost.alias("cost")).withColumn("gain", F.col("value") - F.col("cost"))


def liability_report(liabilities: DataFrame, accounts: DataFrame) -> DataFrame:
    """Liabilities with account names; of several rates the highest, which an empty array lacks.

    liabilities: account_id, kind, balance, aprs array<struct<type,percentage>>, next_payment, next_due.
    """
    rate = F.array_max(F.transform("aprs", lambda a: a["percentage"]))
    return liabilities.join(accounts.select("account_id", F.col("name").alias("account"), "mask"), "account_id", "left").withColumn("highest_apr", rate).drop("aprs")


def masked(number: Column, shown: int = 4) -> Column:
    """All but the last digits as asterisks; short numbers wholly."""
    n = F.length(number)
    return F.when(n <= shown, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - shown), F.substring(number, -shown, shown)))


def owners(identity: DataFrame) -> DataFrame:
    """(account_id, name, email, phone): a row per owner; the primary address and number first, else any."""
    x = identity.select("account_id", F.explode("owners").alias("o"))
    return x.select("account_id", F.array_join("o.names", ", ").alias("name"), _first("o.emails").alias("email"), _first("o.phones").alias("phone"))


def _first(column: str) -> Column:
    c = F.col(column)
    return F.coalesce(F.try_element_at(F.filter(c, lambda x: x["primary"]), F.lit(1))["data"], F.try_element_at(c, F.lit(1))["data"])


def feed_rows(raw: DataFrame, column: str = "value") -> DataFrame:
    """Feed transactions from JSON lines; fields of another type are null instead of an error."""
    schema = """transaction_id string, account_id string, amount double, iso_currency_code string, date string, authorized_date string, name string, merchant_name string, merchant_entity_id string, payment_channel string,
    pending boolean, pending_transaction_id string, personal_finance_category struct<primary:string,detailed:string,confidence_level:string>, location struct<city:string,region:string,country:string,lat:double,lon:double>"""
    x = raw.select(F.from_json(column, schema).alias("t")).select("t.*").where("transaction_id is not null")
    return x.select("*", F.col("date").try_cast("date").alias("day"), "personal_finance_category.primary", "personal_finance_category.detailed", "location.city", "location.region").drop("date", "personal_finance_category", "location").withColumnRenamed("day", "date")


def account_rows(raw: DataFrame, column: str = "value") -> DataFrame:
    """Feed accounts from JSON lines, with their balances; a missing currency is USD."""
    schema = "account_id string, item_id string, name string, official_name string, type string, subtype string, mask string, balances struct<available:double,current:double,limit:double,iso_currency_code:string>"
    x = raw.select(F.from_json(column, schema).alias("t")).select("t.*").where("account_id is not null")
    balances = [F.col(f"balances.{c}").alias(n) for c, n in (("available", "balance_available"), ("current", "balance_current"), ("limit", "balance_limit"))]
    return x.select("account_id", "item_id", "name", "official_name", "type", "subtype", "mask", *balances, F.coalesce("balances.iso_currency_code", F.lit("USD")).alias("iso_currency_code"))


def holding_rows(raw: DataFrame, column: str = "value") -> DataFrame:
    """Holdings from JSON lines as holding_gains takes them."""
    schema = "account_id string, security_id string, quantity double, institution_value double, institution_price double, cost_basis double, iso_currency_code string"
    x = raw.select(F.from_json(column, schema).alias("t")).select("t.*").where("account_id is not null and security_id is not null")
    return x.select("account_id", "security_id", "quantity", F.coalesce("institution_value", F.col("quantity") * F.col("institution_price")).alias("value"), "cost_basis", "iso_currency_code")


def investment_rows(raw: DataFrame, first: Column | None = None, last: Column | None = None, column: str = "value") -> DataFrame:
    """Investment transactions from JSON lines, those of a closed range of days if one is given."""
    schema = "investment_transaction_id string, account_id string, security_id string, date string, name string, quantity double, amount double, price double, fees double, type string, subtype string, iso_currency_code string"
    x = raw.select(F.from_json(column, schema).alias("t")).select("t.*").where("investment_transaction_id is not null").withColumn("date", F.col("date").try_cast("date"))
    x = x.where(F.col("date") >= first) if first is not None else x
    return x.where(F.col("date") <= last) if last is not None else x


def earliest_days(feed: DataFrame) -> DataFrame:
    """(account_id, first_day): how far back each feed account reaches."""
    return feed.groupBy("account_id").agg(F.min("date").alias("first_day"))


def document_rows(spark, path: str) -> DataFrame:
    """Transactions of nested v2 documents: a row each with its account's mask and kind."""
    d = spark.read.schema("accounts array<struct<account:struct<institution:string,accountType:string,accountNumberMasked:string>,transactions:array<struct<transactionId:string,date:string,description:string,merchant:string,amount:double,direction:string,category:string,confidence:double>>>>").option("multiLine", True).json(path)
    a = d.select(F.explode("accounts").alias("a"))
    return a.select("a.account.accountType", "a.account.accountNumberMasked", F.explode("a.transactions").alias("t")).select("accountType", "accountNumberMasked", "t.*").withColumn("date", F.col("date").try_cast("date"))
