import math
import random

import pytest
from ledgerloom.llm.mixing import mix, plan, shares, thresholds

DOCS, TARGETS = "id bigint, source string, n_tokens int, at string, u string, copies string", "source string, target_weight double, max_repeats int"


def corpus(spark, seed=1, sizes=None):
    rnd = random.Random(seed)
    rows, i = [], 0
    for source, n in (sizes or {"web": 3000, "law": 200, "chat": 900, None: 50, "other": 40}).items():
        for _ in range(n):
            rows.append((i, source, rnd.randrange(0, 400), "x", "y", "z"))
            i += 1
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_repeats(spark):
    t = spark.createDataFrame([("web", 2.0, 1), ("law", 1.0, 4), ("chat", 1.0, 2), ("missing", 5.0, 3), ("zero", 0.0, 1)], TARGETS)
    m = mix(corpus(spark), t)
    got = {r.source: r for r in shares(m, t).collect()}
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    for s, want, cap in (("web", 0.5, 1), ("law", 0.25, 4), ("chat", 0.25, 2)):
        assert abs(got[s].actual_share - want) < 0.01 and got[s].most_copies <= cap and abs(got[s].target_share - want) < 1e-9
    assert got["missing"].tokens == got["zero"].tokens == 0
    rows = m.collect()
    assert len({(r.id, r.copy) for r in rows}) == len(rows) and {r.source for r in rows} == {"web", "law", "chat"}


def test_same_on_every_run_and_shuffled(spark):
    t = spark.createDataFrame([("web", 1.0, 2), ("chat", 1.0, 2)], TARGETS)
    a = [(r.id, r.copy) for r in mix(corpus(spark), t).collect()]
    b = [(r.id, r.copy) for r in mix(corpus(spark).repartition(7), t).collect()]
    assert a == b and a != sorted(a)
    assert {(r.id, r.copy) for r in mix(corpus(spark), t, seed=3).collect()} != set(a)


def test_total_beyond_the_caps_uses_all(spark):
    t = spark.createDataFrame([("law", 1.0, 3)], TARGETS)
    m = mix(corpus(spark), t, total=1e12)
    assert m.count() == 600


def test_nulls_and_empty(spark):
    t = spark.createDataFrame([(None, 1.0, 1), ("web", None, 2), ("law", float("nan"), 1), ("chat", 1.0, None)], TARGETS)
    got = {r.source: r.records for r in shares(mix(corpus(spark), t), t).collect()}
    assert got["web"] == got["law"] == 0 and got["chat"] > 0
    assert mix(corpus(spark).limit(0), t).count() == 0
    assert mix(corpus(spark), t.limit(0)).count() == 0


def test_hot_source(spark):
    t = spark.createDataFrame([("web", 1.0, 2), ("law", 3.0, 5)], TARGETS)
    got = {r.source: r.actual_share for r in shares(mix(corpus(spark, sizes={"web": 20000, "law": 60}), t), t).collect()}
    assert abs(got["law"] - 0.75) < 0.02


@pytest.mark.parametrize("rate", [0.0, 0.3, 2.5, 40.0])
def test_thresholds_are_the_poisson_distribution(rate):
    got = thresholds(rate, 5)
    want, s = [], 0.0
    for k in range(5):
        s += math.exp(-rate) * rate**k / math.factorial(k)
        want.append(min(s, 1))
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))
    assert thresholds(math.inf, 3) == [0.0] * 3


def test_plan_keeps_rates_finite_where_caps_allow(spark):
    docs = corpus(spark).select("id", "source", "n_tokens")
    t = spark.createDataFrame([("web", 1.0, 2), ("chat", 1.0, 2)], TARGETS)
    rows = {r["source"]: r for r in plan(docs, t, total=50_000)}
    assert all(0 < r["rate"] < 2 for r in rows.values())


def test_as_many_sources_as_there_are(spark):
    """20,000 sources, a third of all tokens in one: every one gets its share."""
    n = 20_000
    small = spark.range(5 * n).selectExpr("id", "concat('s', id % 20000) as source", "cast(20 + id % 7 as int) as n_tokens")
    docs = small.unionByName(spark.range(5 * n, 5 * n + n // 2).selectExpr("id", "'big' as source", "100 as n_tokens"))
    t = spark.range(n).selectExpr("concat('s', id) as source", "cast(1 as double) as target_weight", "3 as max_repeats").unionByName(spark.createDataFrame([("big", float(n), 2)], TARGETS))
    got = {r.source: r for r in shares(mix(docs, t), t).collect()}
    assert len(got) == n + 1 and abs(got["big"].actual_share - 0.5) < 0.005
    assert sum(r.records for s, r in got.items() if s != "big") > n / 2 and max(r.most_copies for r in got.values()) <= 3
    assert max(abs(r.actual_share - r.target_share) for r in got.values()) < 0.005
