"""Cash flow, income and tax reports over ledger rows, for each owner at once.

Rows need: owner, date, description, amount, direction (credit or debit), category, subcategory. Every
report aggregates by owner and a calendar or category key; no owner's rows are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import quarter_end, quarter_label, quarter_start, round_half_up

# Words and categories of transfers, income and taxes.
TRANSFER_WORDS = ("transfer from", "transfer to", "xfer from", "xfer to", "online banking transfer")
TRANSFER_CATEGORIES = ("Transfer",)
TRANSFER_SUBCATEGORIES = ("Transfer", "Internal Transfer", "Internal", "Zelle", "Venmo", "Wire", "ACH")
TAX_DEDUCTIBLE = {
    "Business": ("Office Supplies", "Software", "Equipment", "Professional Services"),
    "Health": ("Medical", "Pharmacy", "Healthcare", "Insurance"),
    "Education": ("Tuition", "Books", "Courses"),
    "Professional Services": ("Legal", "Accounting", "Consulting"),
    "Charitable": ("Donation", "Charity"),
}
TAX_INCOME = ("Income", "Financial")
TAX_INCOME_SUBCATEGORIES = ("Salary", "Interest", "Dividend", "Rental Income", "Business Income")
TAX_REVIEW = ("Business", "Professional Services", "Education")


def is_transfer() -> Column:
    text = F.lower("description")
    out = F.lit(False)
    for w in TRANSFER_WORDS:
        out |= F.contains(text, F.lit(w))
    in_ = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    return F.coalesce(out, F.lit(False)) | in_("category", TRANSFER_CATEGORIES) | in_("subcategory", TRANSFER_SUBCATEGORIES)


def flows(rows: DataFrame) -> DataFrame:
    """Rows with transfer, income and expense (exact decimals; 0 where neither)."""
    size = F.abs("amount")
    out = rows.withColumn("transfer", is_transfer())
    part = lambda d: F.when(~F.col("transfer") & (F.col("direction") == d), size).otherwise(F.lit(0))
    return out.withColumns({"income": part("credit"), "expense": part("debit")})


def quarterly_cash_flow(rows: DataFrame) -> DataFrame:
    """Income, expenses, net and count of each owner's quarters, transfers left out."""
    d = F.col("date")
    q = flows(rows).where(~F.col("transfer")).groupBy("owner", quarter_start(d).alias("start_date"))
    q = q.agg(F.sum("income").alias("i"), F.sum("expense").alias("e"), F.count("*").alias("transaction_count"))
    s = F.col("start_date")
    return q.select("owner", quarter_label(s).alias("quarter"), "start_date", quarter_end(s).alias("end_date"), F.col("i").cast("double").alias("total_income"), F.col("e").cast("double").alias("total_expenses"), (F.col("i") - F.col("e")).cast("double").alias("net_cash_flow"), "transaction_count")


def income_and_expenses(rows: DataFrame) -> DataFrame:
    """One row per owner: totals, net, transfers left out, first and last day."""
    t = flows(rows).groupBy("owner").agg(
        F.sum("income").alias("i"), F.sum("expense").alias("e"), F.sum(F.when(F.col("transfer"), F.abs("amount")).otherwise(F.lit(0))).alias("x"), F.min("date").alias("period_start"), F.max("date").alias("period_end")
    )
    return t.select("owner", F.col("i").cast("double").alias("total_income"), F.col("e").cast("double").alias("total_expenses"), (F.col("i") - F.col("e")).cast("double").alias("net_income"), F.col("x").cast("double").alias("excluded_transfers"), "period_start", "period_end")


def by_category(rows: DataFrame, flow: str) -> DataFrame:
    """(owner, category, total) of income or expense; a null category is a group."""
    which = "credit" if flow == "income" else "debit"
    return flows(rows).where(~F.col("transfer") & (F.col("direction") == which)).groupBy("owner", "category").agg(F.sum(flow).cast("double").alias("total"))


def category_map(rows: DataFrame, flow: str) -> DataFrame:
    """(owner, totals): the same as one map per owner; its size is that of the set of categories."""
    t = by_category(rows, flow).where("category is not null")
    return t.groupBy("owner").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "total")))).alias("totals"))


def monthly_breakdown(rows: DataFrame) -> DataFrame:
    m = flows(rows).where(~F.col("transfer")).groupBy("owner", F.trunc("date", "month").alias("month"))
    return m.agg(F.sum("income").cast("double").alias("income"), F.sum("expense").cast("double").alias("expenses"))


def income_streaks(rows: DataFrame) -> DataFrame:
    """(owner, months): the longest run of present months with income; a month without rows does not break it."""
    m = monthly_breakdown(rows).withColumn("got", F.col("income") > 0)
    order = Window.partitionBy("owner").orderBy("month")
    island = F.row_number().over(order) - F.row_number().over(Window.partitionBy("owner", "got").orderBy("month"))
    runs = m.withColumn("island", island).groupBy("owner", "got", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("owner").agg(F.coalesce(F.max(F.when(F.col("got"), F.col("n"))), F.lit(0)).alias("months"))


def _mean(c: str) -> Column:
    """A mean whose sum is exact, so that it doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(20,2)")).cast("double") / F.count("*")


def lender_summary(rows: DataFrame) -> DataFrame:
    """Income stability of each owner: means, variation, streak, regularity and score from 0 to 100."""
    m = monthly_breakdown(rows)
    stats = m.groupBy("owner").agg(_mean("income").alias("avg_income"), _mean("expenses").alias("avg_expenses"), F.stddev_pop("income").alias("sd"), F.count("*").alias("months"))
    variation = F.when(F.col("months") > 1, F.col("sd") / F.when(F.col("avg_income") == 0, 1.0).otherwise(F.col("avg_income"))).otherwise(F.lit(0.0))
    regular = m.join(stats.select("owner", "avg_income"), "owner").groupBy("owner").agg(F.count_if(F.col("income") > F.col("avg_income") * 0.5).alias("regular"))
    earned = flows(rows).where(~F.col("transfer") & (F.col("direction") == "credit"))
    sources = earned.groupBy("owner").agg(F.countDistinct("category").alias("sources"))
    repeated = earned.groupBy("owner", F.floor(F.abs("amount") + 0.5).alias("a")).agg(F.count("*").alias("n")).groupBy("owner").agg(F.max("n").alias("most"))
    streak = income_streaks(rows).withColumnRenamed("months", "streak")
    out = stats.withColumn("variation", variation).join(regular, "owner").join(streak, "owner").join(sources, "owner", "left").join(repeated, "owner", "left")
    score = F.greatest(F.lit(0.0), 100 - F.col("variation") * 100) * 0.4 + F.least(F.lit(100.0), F.col("streak") / F.col("months") * 100) * 0.3 + F.col("regular") / F.col("months") * 100 * 0.3
    return out.select(
        "owner",
        round_half_up(F.col("avg_income"), 2).alias("average_income"),
        round_half_up(F.col("avg_expenses"), 2).alias("average_expenses"),
        round_half_up(F.col("variation"), 4).alias("income_variation"),
        F.floor(F.round(score, 6) + 0.5).cast("bigint").alias("stability_score"),
        F.col("streak").alias("consecutive_months"),
        F.col("months").alias("total_months"),
        F.coalesce("sources", F.lit(0)).alias("income_sources"),
        F.coalesce(F.col("most") >= 3, F.lit(False)).alias("regular_income"),
        round_half_up(F.col("avg_income") * 12, 2).alias("annual_income"),
    )


def tax_relevance() -> Column:
    """income, deductible, review or neutral by category and subcategory."""
    cat, sub = F.coalesce("category", F.lit("")), F.coalesce("subcategory", F.lit(""))
    out = F.when(cat.isin(*TAX_INCOME) & sub.isin(*TAX_INCOME_SUBCATEGORIES), "income")
    for c, subs in TAX_DEDUCTIBLE.items():
        out = out.when((cat == c) & sub.isin("", *subs), "deductible")
    return out.when(cat.isin(*TAX_REVIEW), "review").otherwise("neutral")


def tax_rows(rows: DataFrame) -> DataFrame:
    """Rows of each owner's last year, without transfers, with their relevance."""
    last = rows.groupBy("owner").agg(F.max(F.year("date")).alias("tax_year"))
    return flows(rows).join(last, "owner").where((F.year("date") == F.col("tax_year")) & ~F.col("transfer")).withColumn("relevance", tax_relevance())


def tax_categories(rows: DataFrame) -> DataFrame:
    t = tax_rows(rows).groupBy("owner", "tax_year", "category", "subcategory", "relevance")
    return t.agg(F.sum(F.abs("amount")).cast("double").alias("total_amount"), F.count("*").alias("transaction_count"))


def tax_buckets(rows: DataFrame) -> DataFrame:
    """One row per owner: taxable income and deductible expenses by bucket."""
    t = tax_rows(rows)
    deduct = F.when(F.col("relevance") == "deductible", F.col("expense")).otherwise(F.lit(0))
    bucket = F.when(F.col("category") == "Business", "business").when(F.col("category") == "Health", "medical").when(F.col("category") == "Charitable", "charitable").when(F.col("category") == "Professional Services", "professional").otherwise("other")
    part = lambda b: F.sum(F.when(bucket == b, deduct).otherwise(F.lit(0))).cast("double").alias(b)
    taxable = F.sum(F.when(F.col("relevance") == "income", F.col("income")).otherwise(F.lit(0))).cast("double").alias("taxable_income")
    return t.groupBy("owner", "tax_year").agg(taxable, F.sum(deduct).cast("double").alias("deductible"), *[part(b) for b in ("business", "medical", "charitable", "professional", "other")])


def places(rows: DataFrame, group: str, day: str, id_: str) -> DataFrame:
    """(id, group, place): each row's place in its group by day, then id.

    Each day is ordered by itself and the counts of the days before are added, so no task orders a group.
    """
    per_day = rows.groupBy(group, day).agg(F.count("*").alias("n"))
    before = per_day.select(F.col(group).alias("_g"), F.col(day).alias("_d"), (F.sum("n").over(Window.partitionBy(group).orderBy(day)) - F.col("n")).alias("before"))
    inside = rows.withColumn("k", F.row_number().over(Window.partitionBy(group, day).orderBy(id_)))
    return inside.join(before, F.col(group).eqNullSafe(F.col("_g")) & F.col(day).eqNullSafe(F.col("_d"))).select(id_, group, (F.col("k") + F.col("before")).alias("place"))


def combined(rows: DataFrame) -> DataFrame:
    """(owner, report, item, value): net cash flow by quarter, income and expenses, and the streak of months with income."""
    quarters = quarterly_cash_flow(rows).select("owner", F.lit("quarterly_cash_flow").alias("report"), F.col("quarter").alias("item"), F.col("net_cash_flow").alias("value"))
    totals = income_and_expenses(rows)
    items = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in ("total_income", "total_expenses", "net_income")])
    sums = totals.select("owner", F.lit("income_vs_expenses").alias("report"), F.explode(items).alias("x")).select("owner", "report", "x.*")
    streak = income_streaks(rows).select("owner", F.lit("lender_summary").alias("report"), F.lit("consecutive_months").alias("item"), F.col("months").cast("double").alias("value"))
    return quarters.unionByName(sums).unionByName(streak)
