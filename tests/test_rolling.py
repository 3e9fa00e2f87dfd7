import random
from datetime import date, timedelta
from decimal import Decimal

from ledgerloom.operators.rolling import trailing
from pyspark.sql import functions as F

D0 = date(2024, 2, 20)


def naive(rows, lengths=(7, 30)):
    out = {}
    for e in {r[0] for r in rows if r[0] and r[1]}:
        mine = [(t, v) for a, t, v in rows if a == e and t]
        day = min(t for t, _ in mine)
        while day <= max(t for t, _ in mine):
            sums = []
            for n in lengths:
                inside = [v or Decimal(0) for t, v in mine if day - timedelta(n - 1) <= t <= day]
                sums += [sum(inside, Decimal(0)), len(inside)]
            out[e, day] = sums
            day += timedelta(1)
    return out


def check(spark, rows, lengths=(7, 30)):
    df = spark.createDataFrame(rows, "acc string, day date, v decimal(14,2)")
    got = trailing(df, "acc", "day", F.col("v"), lengths).collect()
    assert {(r.acc, r.day): [x for n in lengths for x in (r[f"total_{n}"], r[f"rows_{n}"])] for r in got} == naive(rows, lengths)
    for r in got:
        for n in lengths:
            assert abs(float(r[f"avg_{n}"]) - float(r[f"total_{n}"]) / n) < 1e-6


def test_random_against_naive(spark):
    rnd = random.Random(2)
    rows = [(f"a{rnd.randrange(4)}", D0 + timedelta(rnd.randrange(140)), Decimal(rnd.randrange(-9999, 9999)) / 100) for _ in range(160)]
    check(spark, rows)
    check(spark, rows, (1, 5))


def test_hot_account_single_day_and_nulls(spark):
    rows = [("hot", D0 + timedelta(i % 3), Decimal(1)) for i in range(3000)] + [("one", D0, Decimal("2.50")), ("n", D0, None), (None, D0, Decimal(1)), ("x", None, Decimal(1))]
    check(spark, rows)


def test_empty(spark):
    assert trailing(spark.createDataFrame([], "acc string, day date, v decimal(14,2)"), "acc", "day", F.col("v")).count() == 0


def test_far_days_fill_the_span(spark):
    rows = [("a", date(2020, 1, 1), Decimal(1)), ("a", date(2024, 1, 1), Decimal(2))]
    check(spark, rows)
