import random
from datetime import date, timedelta
from decimal import Decimal

import numpy as np
import pytest
from ledgerloom.llm.label_model import fit
from ledgerloom.llm.linkage import Rules, candidates, common_words, features, feed_payments, kinds, ledger_rows, link, own_lines

LEDGER = "id string, account_id string, date date, amount decimal(14,2), direction string, description string, class string, cents string"
ACCOUNTS = "id string, institution string, account_type string, account_number_masked string"
FEED = "feed_seq bigint, transaction_id string, account_id string, amount decimal(14,2), date date, authorized_date date, name string, merchant_name string, pending boolean, pending_transaction_id string, city string, region string, day string"
FEED_ACCOUNTS = "account_id string, institution_name string, type string, subtype string, mask string"
NAMES = ["Amber Otter", "Blue Falcon", "Copper Magpie", "Dusky Heron", "Ember Walnut", "Gilded Thimble", "Hazel Quarry", "Ivory Beacon", "Juniper Loom", "Lucky Anchor", "Maple Grove", "Olive Sparrow"]
KINDS = ["Cafe", "Books", "Pharmacy", "Hardware", "Market"]


@pytest.fixture(scope="module")
def planted():
    """Two accounts; their payments are in the ledger, the feed or both, with copies, pending rows and redeliveries."""
    rnd = random.Random(11)
    ledger, feed, truth, seq = [], [], set(), 0
    for acc in ("A", "B"):
        for i in range(160):
            day = date(2024, 1, 1) + timedelta(rnd.randrange(300))
            cents = rnd.randrange(300, 20000)
            name = f"{rnd.choice(NAMES)} {rnd.choice(KINDS)}"
            in_ledger, in_feed = rnd.random() < 0.85, rnd.random() < 0.85
            ids = []
            if in_ledger:
                text = f"CHECKCARD {day:%m%d} {name.upper()} {rnd.randrange(9999)} OAKMIRE WA"
                for c in range(1 + (rnd.random() < 0.15)):
                    ids.append(f"l{acc}{i:03}{c}")
                    ledger.append((ids[-1], acc, day, Decimal(-cents) / 100, "debit" if c == 0 else " DEBIT", text if c == 0 else text.lower() + ".", "c", "d"))
            if in_feed:
                shown = cents if rnd.random() < 0.93 else round(cents / 1.15)
                fday = day - timedelta(rnd.choice([0, 0, 0, 1, 1, 2, 3]))
                pend = rnd.random() < 0.15
                fids = [f"f{acc}{i:03}"] + [f"p{acc}{i:03}"] * pend
                row = lambda fid, p, n: (n, fid, "F" + acc, Decimal(shown) / 100, fday, None, name if rnd.random() < 0.8 else name.upper(), name if rnd.random() < 0.7 else None, p, fids[1] if pend and not p else None, None, None, "x")  # noqa: B023, E731
                if pend:
                    seq += 1
                    feed.append(row(fids[1], True, seq))
                for _ in range(1 + (rnd.random() < 0.1)):
                    seq += 1
                    feed.append(row(fids[0], False, seq))
                truth |= {(a, b) for a in ids for b in fids}
    accounts = [("A", "First Bank", "checking", "****1111"), ("B", "First Bank", "checking", "****2222"), ("C", "First Bank", "checking", "****3333")]
    feed_accounts = [("FA", "FIRST BANK, N.A.", "depository", "checking", "1111"), ("FB", "First Bk", "depository", None, "3333"), ("FC", "Other", "credit", "credit card", None)]
    return ledger, accounts, feed, feed_accounts, truth


def run(spark, ledger, accounts, feed, feed_accounts):
    t = [spark.createDataFrame(rows, s) for rows, s in ((ledger, LEDGER), (accounts, ACCOUNTS), (feed, FEED), (feed_accounts, FEED_ACCOUNTS))]
    return link(*t).collect()


def test_planted_pairs(spark, planted):
    *tables, truth = planted
    rows = run(spark, *tables)
    got = {(r.ledger_id, r.plaid_transaction_id) for r in rows}
    assert len(got) == len(rows) and all(0.5 <= r.confidence <= 1 for r in rows)
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.97


def test_empty_tables_and_nulls(spark, planted):
    ledger, accounts, feed, feed_accounts, _ = planted
    assert run(spark, [], accounts, feed, feed_accounts) == []
    assert run(spark, ledger, accounts, [], feed_accounts) == []
    holes = [("n1", None, None, None, None, None, None, None), ("n2", "A", date(2024, 1, 1), None, "debit", None, None, None)]
    gaps = [(10**6, "n", "FA", None, None, None, None, None, None, None, None, None, None), (10**6 + 1, None, None, Decimal(1), date(2024, 1, 1), None, None, None, True, None, None, None, None)]
    got = {(r.ledger_id, r.plaid_transaction_id) for r in run(spark, ledger + holes, accounts + [("D", None, None, None)], feed + gaps, feed_accounts + [("FD", None, None, None, None)])}
    assert not any(a.startswith("n") or b == "n" for a, b in got) and len(got) > 200


@pytest.mark.parametrize("masked", [True, False])
def test_accounts_that_pay_whole_amounts_only(spark, planted, masked):
    ledger, accounts, feed, feed_accounts, truth = planted
    whole = lambda x: Decimal(round(x))
    ledger = [(*r[:3], whole(r[3]), *r[4:]) for r in ledger]
    feed = [(*r[:3], whole(r[3]), *r[4:]) for r in feed]
    if not masked:
        feed_accounts = [(*r[:4], None) for r in feed_accounts]
    got = {(r.ledger_id, r.plaid_transaction_id) for r in run(spark, ledger, accounts, feed, feed_accounts)}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95


def fares(n):
    """n equal fares of one account within three days, in both tables, beside a year of other payments."""
    day = lambda i: date(2024, 3, 1) + timedelta(i % 3)
    ledger = [(f"f{i:05}", "A", day(i), Decimal("-2.75"), "debit", f"CHECKCARD {1000 + i} CITY TRAM", "c", "d") for i in range(n)]
    feed = [(i, f"t{i:05}", "FA", Decimal("2.75"), day(i), None, "City Tram", "City Tram", False, None, None, None, "x") for i in range(n)]
    return ledger, feed


def test_equal_fares_grow_linearly_and_each_is_taken_once(spark, planted):
    _, accounts, _, feed_accounts, _ = planted
    seen = {}
    for n in (300, 600):
        ledger, feed = fares(n)
        t = [spark.createDataFrame(r, s) for r, s in ((ledger, LEDGER), (feed, FEED), (accounts, ACCOUNTS))]
        payments, _ = feed_payments(t[1])
        a, b = features(own_lines(ledger_rows(t[0]), t[0]), payments.replace("FA", "A", "account_id"))
        assert a.count() == b.count() == n
        seen[n] = candidates(kinds(a, "l_key", "class"), kinds(b, "p_key", "payment")).count()
    assert seen[300] == seen[600] <= 9  # three days on either side
    ledger, feed = fares(300)
    rows = run(spark, ledger, accounts, feed[:290], feed_accounts)
    assert len(rows) == len({r.ledger_id for r in rows}) == len({r.plaid_transaction_id for r in rows}) == 290


def test_windows_are_parameters(spark, planted):
    ledger, accounts, feed, feed_accounts, truth = planted
    late = [(*r[:2], r[2] + timedelta(20), *r[3:]) for r in ledger]
    tables = [spark.createDataFrame(rows, s) for rows, s in ((late, LEDGER), (accounts, ACCOUNTS), (feed, FEED), (feed_accounts, FEED_ACCOUNTS))]
    got = {(r.ledger_id, r.plaid_transaction_id) for r in link(*tables, Rules(days_behind=25)).collect()}
    assert len(got & truth) / len(truth) > 0.9
    assert len(link(*tables).collect()) < len(got) / 2


def test_common_words_are_learned(spark):
    names = [f"{a} {b}" for a in ("Amber", "Blue", "Copper", "Dusky", "Ember", "Gilded") for b in ("Otter", "Falcon", "Heron")]
    feed = [(i, f"t{i}", "FA", Decimal(1), date(2024, 1, 1), None, "x", f"{n} {k}", False, None, None, None, "x") for i, (n, k) in enumerate((n, k) for n in names for k in ("Books", "Grill"))]
    ledger = [(f"l{i}", "A", date(2024, 1, 1), Decimal(1), "debit", f"KAARTBETALING {r[7]} UTRECHT", "c", "d") for i, r in enumerate(feed)]
    payments, _ = feed_payments(spark.createDataFrame(feed, FEED))
    assert common_words(spark.createDataFrame(ledger, LEDGER), payments) == ["books", "grill", "kaartbetaling", "utrecht"]
    assert common_words(spark.createDataFrame([], LEDGER), payments) == []


def test_label_model_learns_accuracies_and_correlations():
    rnd = np.random.default_rng(3)
    n = 40_000
    y = rnd.random(n) < 0.4
    says = lambda acc: np.where(rnd.random(n) < acc, y, ~y).astype(int)
    a, b, c = says(0.9), says(0.8), says(0.7)
    twin = np.where(rnd.random(n) < 0.95, c, 1 - c)  # errs together with c
    votes = np.stack([a, b, c, twin], axis=1)
    votes[rnd.random(n) < 0.2, 1] = 2  # abstains
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    start = np.where(patterns[:, 0] == 1, 0.7, 0.3)
    model = fit(patterns, counts.astype(float), [2, 3, 2, 2], start, [-1, 2, -1, -1])
    p = model.posterior(patterns)[inverse.ravel()]
    assert abs(model.prior[1] - 0.4) < 0.05
    assert ((p > 0.5) == y).mean() > 0.9
    assert 3 in model.parent or model.parent[3] == 2 or model.parent[2] == 3
    assert abs(((p > 0.5) == y).mean() - np.maximum(p, 1 - p).mean()) < 0.03  # calibrated


def test_no_plan_holds_the_whole_linkage(spark, planted, monkeypatch):
    """The driver keeps a running plan several times: none has more than 25 exchanges, the last one, which had 43, only 6."""
    from ledgerloom.llm import linkage

    size = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    sizes, cut = [], linkage.cut_lineage
    monkeypatch.setattr(linkage, "cut_lineage", lambda df: (sizes.append(size(df)), cut(df))[1])
    ledger, accounts, feed, feed_accounts, truth = planted
    out = link(spark.createDataFrame(ledger, LEDGER), spark.createDataFrame(accounts, ACCOUNTS), spark.createDataFrame(feed, FEED), spark.createDataFrame(feed_accounts, FEED_ACCOUNTS))
    assert size(out) <= 6 and max(sizes) <= 25


def test_hot_classes_of_copies_lose_no_pair(spark, planted, monkeypatch):
    from ledgerloom.llm import linkage

    ledger, accounts, feed, feed_accounts, truth = planted
    frames = [spark.createDataFrame(*x) for x in ((ledger, LEDGER), (accounts, ACCOUNTS), (feed, FEED), (feed_accounts, FEED_ACCOUNTS))]
    pairs = lambda: sorted(map(tuple, link(*frames).collect()))
    cold, hot = pairs(), linkage.hot_classes
    monkeypatch.setattr(linkage, "hot_classes", lambda rows: hot(rows, 1))
    assert hot(ledger_rows(frames[0]), 1).count() > 0 and pairs() == cold
