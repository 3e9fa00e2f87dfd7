import random
from datetime import date, timedelta

from ledgerloom.operators.coverage import rows_in_gaps, uncovered
from ledgerloom.operators.intervals import periods_and_gaps
from pyspark.sql import functions as F

D0 = date(2024, 1, 1)


def d(n):
    return D0 + timedelta(n)


def brute(rows):
    out = []
    for a in {r[0] for r in rows if r[0] is not None}:
        days = {x for e, s, t in rows if e == a and s is not None and t is not None for x in range((s - D0).days, (t - D0).days + 1)}
        if not days:
            continue
        run = None
        for x in range(min(days), max(days) + 2):
            kind = "period" if x in days else "gap"
            if run and (run[0] != kind or x > max(days)):
                out.append((a, run[0], d(run[1]), d(x - 1)))
                run = None
            if run is None and x <= max(days):
                run = (kind, x)
    return sorted(out)


def found(spark, rows, schema="account string, a date, b date"):
    df = spark.createDataFrame(rows, schema)
    return sorted(tuple(r) for r in periods_and_gaps(df, "account", "a", "b").collect())


def test_random_against_days(spark):
    rnd = random.Random(5)
    rows = [(f"x{rnd.randrange(6)}", d(s := rnd.randrange(300)), d(s + rnd.randrange(-4, 25))) for _ in range(150)]
    assert found(spark, rows) == brute(rows)


def test_hot_entity_repeats_and_nesting(spark):
    rows = [("hot", d(i % 50), d(i % 50 + 1)) for i in range(2000)] + [("hot", d(60), d(80)), ("hot", d(65), d(70))] * 3
    assert found(spark, rows) == brute(rows)


def test_nulls_backward_adjacent_and_empty(spark):
    rows = [("a", d(0), d(4)), ("a", d(5), d(9)), ("a", None, d(3)), ("a", d(1), None), (None, d(1), d(2)), ("b", d(9), d(1)), ("a", d(11), d(11))]
    assert found(spark, rows) == [("a", "gap", d(10), d(10)), ("a", "period", d(0), d(9)), ("a", "period", d(11), d(11))]
    assert found(spark, []) == []


def test_extra_columns_with_inner_names(spark):
    rows = [("a", d(0), d(4), 1, 2, "x"), ("a", d(8), d(9), 3, 4, "y")]
    assert len(found(spark, rows, "account string, a date, b date, k int, e int, side string")) == 3


def test_uncovered_window(spark):
    df = spark.createDataFrame([("a", d(5), d(9)), ("a", d(20), d(25)), ("b", d(0), d(40)), ("c", d(30), d(35))], "e string, s date, t date")
    w = [F.lit(d(0)), F.lit(d(30))]
    got = sorted(tuple(r) for r in uncovered(df, "e", "s", "t", *w).collect())
    # A range that begins on the window's last day leaves a gap up to that day.
    assert got == [("a", d(0), d(4)), ("a", d(10), d(19)), ("a", d(26), d(30)), ("c", d(0), d(30))]
    rows = spark.createDataFrame([(1, "a", d(12)), (2, "a", d(22)), (3, "b", d(3)), (4, "c", d(30))], "id int, acc string, day date")
    gaps = uncovered(df, "e", "s", "t", *w).withColumnRenamed("e", "acc")
    assert sorted(r.id for r in rows_in_gaps(rows, "acc", "day", gaps).collect()) == [1, 4]
