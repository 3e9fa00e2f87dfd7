"""Recurring payments: groups of like descriptions at regular intervals.

Groups are keyed by owner, merchant key and direction. Interval statistics come from counts, sums and
sums of squares of day differences; the differences need one window over a group's days, which are
counted beforehand, so a group is as long as the calendar, not as its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import merchant_key, pattern_hash, round_half_up

MIN_OCCURRENCES, MAX_VARIATION, MANY = 2, 0.3, 6
FIXED_BELOW, NEARLY_FIXED_BELOW = 0.01, 0.05
# Frequency, least and most days between, days to the next, payments a month.
FREQUENCIES = (
    ("weekly", 5, 9, 7, 4.33),
    ("bi-weekly", 12, 16, 14, 2.17),
    ("monthly", 26, 35, 30, 1.0),
    ("quarterly", 85, 100, 91, 1 / 3),
    ("semi-annual", 170, 200, 182, 1 / 6),
    ("annual", 350, 380, 365, 1 / 12),
)
# Words of subscription services.
SUBSCRIPTION_WORDS = (
    "netflix", "spotify", "hulu", "disney", "hbo", "amazon prime", "apple", "google", "microsoft", "adobe", "dropbox", "icloud", "youtube",
    "audible", "kindle", "paramount", "peacock", "crunchyroll", "gym", "fitness", "planet fitness", "la fitness", "ymca",
    "insurance", "geico", "progressive", "state farm", "allstate", "att", "verizon", "tmobile", "t-mobile", "comcast", "xfinity", "spectrum",
    "openai", "chatgpt", "github", "notion", "slack", "zoom", "patreon", "substack", "medium",
)
SUBSCRIPTION_CATEGORIES = ("Entertainment", "Utilities")


def _frequency(mean: Column, variation: Column, column: int) -> Column:
    out = F.when(variation > 0.4, F.lit(None))
    for row in FREQUENCIES:
        out = out.when(mean.between(row[1], row[2]), F.lit(row[column]))
    return out


def _steps(value: Column, steps: tuple[tuple[float, float], ...]) -> Column:
    out = F.lit(0.0)
    for below, score in reversed(steps):
        out = F.when(value < below, score).otherwise(out)
    return out


def patterns(rows: DataFrame) -> DataFrame:
    """One row per recurring pattern of each owner.

    rows: owner, id, date, description, amount, direction, category, subcategory. Keys shorter than
    three characters make no pattern. First and last rows of equal days are told apart by id.
    """
    keyed = rows.withColumn("merchant_key", merchant_key(F.col("description"))).where((F.length("merchant_key") >= 3) & F.col("date").isNotNull())
    group = ["owner", "merchant_key", "direction"]
    size = F.abs("amount").cast("double")
    first = F.min_by(F.struct("description", "category", "subcategory"), F.struct("date", "id"))
    sums = keyed.groupBy(*group).agg(
        F.count("*").alias("n"), (F.sum(F.abs("amount")).cast("double") / F.count("*")).alias("avg_amount"), F.stddev_pop(size).alias("sd_amount"), F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), first.alias("first")
    ).where(F.col("n") >= MIN_OCCURRENCES)
    days = keyed.groupBy(*group, "date").agg(F.count("*").alias("k"))
    # k rows of a day add k-1 intervals of 0 and one from the day before.
    step = F.datediff("date", F.lag("date").over(Window.partitionBy(*group).orderBy("date")))
    gaps = days.withColumn("step", step).groupBy(*group).agg(F.sum("step").alias("s"), F.sum(F.col("step") * F.col("step")).alias("ss"), (F.sum("k") - 1).alias("m"), (F.count("*") - 1).alias("steps"))
    out = sums.join(gaps, group)
    mean = F.coalesce("s", F.lit(0)) / F.col("m")
    out = out.withColumn("mean", mean).withColumn("sd", F.when(F.col("m") < 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.coalesce("ss", F.lit(0)) / F.col("m") - F.col("mean") * F.col("mean")))))
    out = out.withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(1.0)).where((F.round("cv", 9) <= MAX_VARIATION) | (F.col("n") >= MANY))
    out = out.withColumn("amount_cv", F.when(F.col("avg_amount") > 0, F.col("sd_amount") / F.col("avg_amount")).otherwise(0.0))
    m, cv, acv = F.round("mean", 9), F.round("cv", 9), F.round("amount_cv", 9)
    out = out.withColumn("frequency", F.coalesce(_frequency(m, cv, 0), F.lit("irregular")))
    regular = F.col("frequency") != "irregular"
    text = F.lower("first.description")
    word = F.lit(False)
    for w in SUBSCRIPTION_WORDS:
        word |= F.contains(text, F.lit(w))
    subscription = (word | F.coalesce(F.col("first.category").isin(*SUBSCRIPTION_CATEGORIES), F.lit(False))) & (acv < NEARLY_FIXED_BELOW) & regular
    score = F.lit(0.5)
    for least in (3, 6, 12):
        score += F.when(F.col("n") >= least, 0.1).otherwise(0.0)
    score += _steps(cv, ((0.1, 0.1), (0.2, 0.05))) + _steps(acv, ((0.01, 0.1), (0.05, 0.05))) + F.when(regular, 0.05).otherwise(0.0)
    ahead = _frequency(m, cv, 3)
    return out.select(
        "owner", "merchant_key", "direction", F.concat(F.lit("rec_"), F.col("direction"), F.lit("_"), pattern_hash(F.col("merchant_key"))).alias("pattern_id"), "frequency",
        F.round("mean", 1).alias("interval_days"), round_half_up(F.col("avg_amount")).alias("average_amount"), F.round("amount_cv", 4).alias("amount_variation"), (acv < FIXED_BELOW).alias("fixed_amount"),
        F.col("first.category").alias("category"), F.col("first.subcategory").alias("subcategory"), F.col("n").alias("occurrences"), "first_seen", "last_seen",
        F.date_add("last_seen", ahead.cast("int")).alias("expected_next"), F.least(F.lit(1.0), F.round(score, 2)).alias("confidence"), subscription.alias("subscription"),
    )


def summary(found: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per owner with patterns: how many, of what kind, and what debits cost a month and a year."""
    months = F.lit(1.0)
    for name, *_, a_month in FREQUENCIES:
        months = F.when(F.col("frequency") == name, a_month).otherwise(months)
    cost = F.when(F.col("direction") == "debit", F.col("average_amount") * months).otherwise(0.0)
    counts = [F.count_if(F.col("frequency") == f).alias("n_" + f.replace("-", "_")) for f in [*[x[0] for x in FREQUENCIES], "irregular"]]
    per = found.groupBy("owner").agg(F.count("*").alias("patterns"), F.sum("occurrences").alias("recurring"), F.sum(cost).alias("monthly"), F.count_if("subscription").alias("subscriptions"), *counts)
    total = rows.groupBy("owner").agg(F.count("*").alias("rows"))
    out = per.join(total, "owner").withColumn("share", round_half_up(F.col("recurring") / F.col("rows") * 100)).withColumn("annual", round_half_up(F.col("monthly") * 12)).withColumn("monthly", round_half_up(F.round("monthly", 6)))
    return out.drop("rows")


def flagged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, pattern_id, subscription) of the rows that belong to a pattern."""
    keyed = rows.withColumn("merchant_key", merchant_key(F.col("description")))
    return keyed.join(found.select("owner", "merchant_key", "direction", "pattern_id", "subscription"), ["owner", "merchant_key", "direction"]).select("id", "pattern_id", "subscription")
