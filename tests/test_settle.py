import random
from datetime import timedelta
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from ledgerloom.functions.edits import Texts, distances
from ledgerloom.operators import reconcile as rc
from ledgerloom.operators import settle

from tests.test_reconcile import D0, edit, frames, left, right

PLANS = ("reconcile_matches", "match_breakdown", "merge_stats", "enrich_warnings", "match_payloads", "merge_union", "reconcile_summary", "enrich_with_feed", "merge_accounts_created")


def test_distances_are_those_of_the_plain_matrix():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abcé 1\U0001f600") for _ in range(rnd.choice([0, 1, 5, 20, 63, 64, 65, 128, 129]))) for _ in range(60)]
    p, q = np.array([[rnd.randrange(60) for _ in range(300)] for _ in range(2)])
    assert distances(Texts(texts), p, q).tolist() == [edit(texts[i], texts[j]) for i, j in zip(p, q)]


def test_the_least_distance_is_never_too_great():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aab 1é\U0001f600Z") for _ in range(rnd.choice([0, 1, 8, 40]))) for _ in range(60)]
    p, q = np.array([[rnd.randrange(60) for _ in range(300)] for _ in range(2)])
    least, true = Texts(texts).fewest(p, q), distances(Texts(texts), p, q)
    assert (least <= true).all() and (least > 0).sum() > 200 and Texts(["", "abc"]).fewest(np.array([0, 1]), np.array([1, 1])).tolist() == [3, 0]


def test_texts_of_other_characters_are_not_compared(monkeypatch):
    """Characters that letters() doesn't count rule texts out, too."""
    compared = []
    monkeypatch.setattr(settle, "distances", lambda texts, p, q: (compared.extend(zip(p.tolist(), q.tolist())), distances(texts, p, q))[1])
    rows = [("a", k, 0, f"{k}{i}", 5.0, text, text) for k, own in ((0, ("αβγδεζηθικ", "жзийклмно")), (1, ("אבגדהוזחטי", "жзийклмнα"))) for i, text in enumerate(own)]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["account", "side", "day", "id", "amount", "text1", "text2"])
    rules = {"days": rc.DAYS, "share": rc.AMOUNT_SHARE, "likeness": rc.LIKENESS, "alike": rc.ALIKE, "floor": rc.FLOOR, "points": rc.POINTS}
    got = [r for x in settle.settled(iter([batch]), ["account", "left_id", "right_id", "l_date", "r_date", "confidence", "match_type"], **rules) for r in x.to_pylist()]
    assert [(r["left_id"], r["right_id"], r["match_type"]) for r in got] == [("00", "10", "amount_date"), ("01", "11", "fuzzy")]
    assert len(compared) == 1


def busy(rnd, n, side):
    """Few days, amounts and texts, so that left rows take what others want; some are null."""
    names, amounts = ["Blue Cafe", "Blue Caffe", "Amber Books", "Amber Book Co", "Copper Fuel", "Q", ""], ["5.00", "5.04", "10.00", "0.00", "10.05", None]
    out = []
    for i in range(n):
        row = list(side(f"{side.__name__[0]}{i:03}", rnd.randrange(9), rnd.choice(amounts) or "0.00", rnd.choice(names), rnd.choice([*names, None]), rnd.choice("abc")))
        if rnd.random() < 0.1:
            row[rnd.choice([2, 3])] = None
        out.append(tuple(row))
    return out


@pytest.mark.parametrize("pairs", [1, 300, 10**6])
def test_held_and_joined_accounts_give_the_same(spark, monkeypatch, pairs):
    rnd = random.Random(pairs)
    monkeypatch.setattr(settle, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(settle, "ROWS_AT_ONCE", 50)
    a, b = (rc._side(x, k) for x, k in zip(frames(spark, busy(rnd, 150, left), busy(rnd, 140, right)), ("left", "right")))
    table = lambda x, k, n: [(r.account, n, r[f"{k}_date"] and (r[f"{k}_date"] - D0).days, r[f"{'left' if k == 'l' else 'right'}_id"], r[f"{k}_amount"], r[f"{k}1"], r[f"{k}2"]) for r in x.collect()]
    rows = sorted([*table(a, "l", 0), *table(b, "r", 1)], key=lambda r: (r[0], r[2] is None, r[2] or 0, r[3]))
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 40]), types)], names=["account", "side", "day", "id", "amount", "text1", "text2"]) for i in range(0, len(rows), 40)]
    rules = {"days": rc.DAYS, "share": rc.AMOUNT_SHARE, "likeness": rc.LIKENESS, "alike": rc.ALIKE, "floor": rc.FLOOR, "points": rc.POINTS}
    names = ["account", "left_id", "right_id", "l_date", "r_date", "confidence", "match_type"]
    held = {(r["left_id"], r["right_id"], r["confidence"], r["match_type"]) for x in settle.settled(iter(batches), names, **rules) for r in x.to_pylist()}
    joined = {(r.left_id, r.right_id, r.confidence, r.match_type) for r in rc._settled(a, b, rc.DAYS, rc.AMOUNT_SHARE, rc.LIKENESS, most=0).collect()}
    assert held == joined and len(held) > 80


def test_copies_of_an_id_are_taken_once(spark):
    a = [left("1", amount="5.00"), left("1", amount="6.00"), left("2", amount="5.00")]
    b = [right("x", 1, "5.00"), right("x", 2, "5.00"), right("y", 1, "6.00")]
    sides = [rc._side(x, k) for x, k in zip(frames(spark, a, b), ("left", "right"))]
    got = [sorted((r.left_id, r.right_id) for r in rc._settled(*sides, rc.DAYS, rc.AMOUNT_SHARE, rc.LIKENESS, most).collect()) for most in (10**9, 0)]
    assert got[0] == got[1] == [("1", "x"), ("2", "y")]


def test_a_held_account_joins_no_pairs(spark, monkeypatch):
    """Rows of a busy account, 2 million pairs of near days: none is made by a join."""
    monkeypatch.setattr(rc, "_scored", lambda *x: 1 / 0)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(12))
    a = [left(f"l{i:04}", rnd.randrange(7), f"{rnd.randrange(1, 10**6)}.00", x := word(), x) for i in range(1500)]
    b = [right(f"r{i:04}", (a[i][2] - D0).days + 1, str(a[i][3]), "zz", "zz") for i in range(1500)]
    found = rc.matches(*frames(spark, a, b))
    assert found.count() == 1500 and found.where("substr(left_id, 2) = substr(right_id, 2) and match_type = 'amount_date'").count() > 1400


@pytest.mark.parametrize("name", PLANS)
def test_queries_make_no_pairs_by_joins(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(rc, "_scored", lambda *x: 1 / 0)
    lines = "id string, account_id string, date date, posted_date date, amount decimal(14,2), direction string, description string, merchant string, category string, confidence double"
    feed = "feed_seq bigint, transaction_id string, account_id string, date date, authorized_date date, amount decimal(14,2), name string, merchant_name string, pfc_primary string, pfc_detailed string, pending boolean"
    for table, data, schema in (
        ("accounts", [("a", "Meadow Bank", "checking", "****1234")], "id string, institution string, account_type string, account_number_masked string"),
        ("plaid_accounts", [("f", "Meadow Bank", "depository", "checking", "1234"), ("g", "Else", "depository", "savings", "99")], "account_id string, institution_name string, type string, subtype string, mask string"),
        ("ledger_transactions", [("l", "a", D0, None, Decimal("-5.25"), "debit", "BLUE CAFE", None, None, None), ("m", "a", D0, None, Decimal("-9.00"), "debit", "RED", None, None, None)], lines),
        ("plaid_transactions", [(1, "x", "f", D0 + timedelta(1), None, Decimal("5.25"), "Blue Caffe", None, None, None, False), (2, "y", "g", D0, None, Decimal("1.00"), "Q", None, None, None, False)], feed),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    from ledgerloom.plans.registry import QUERIES
    import ledgerloom.plans.reconciled  # noqa: F401

    rows = QUERIES[name](spark, str(tmp_path)).collect()
    want = {"reconcile_matches": 1, "match_breakdown": 1, "merge_stats": 1, "enrich_warnings": 2, "match_payloads": 1, "merge_union": 3, "reconcile_summary": 1, "enrich_with_feed": 2, "merge_accounts_created": 1}
    assert len(rows) == want[name]
    if name in ("reconcile_matches", "match_breakdown", "match_payloads"):
        assert rows[0].match_type == "fuzzy"


@pytest.mark.parametrize("name", ["merge_stats", "enrich_warnings", "merge_union", "reconcile_summary"])
def test_queries_without_differences_note_none(spark, folder, monkeypatch, name):
    from ledgerloom.plans.registry import QUERIES
    import ledgerloom.plans.reconciled  # noqa: F401

    monkeypatch.setattr(rc, "_noted", lambda *x: 1 / 0)
    assert QUERIES[name](spark, folder).count() > 0


def test_taken_rows_leave_in_the_tasks(spark):
    """Both ways of settling leave out what is taken, an account that is taken whole too, and rows meet no matches by id."""
    a = [left("1", amount="5.00"), left("2", amount="5.00"), left("3", account="b")]
    b = [right("x", 1, "5.00"), right("y", 2, "5.00"), right("z", account="b")]
    taken = spark.createDataFrame([("a", "1", "x"), ("b", "3", "z")], "account string, left_id string, right_id string")
    sides = [rc._side(x, k) for x, k in zip(frames(spark, a, b), ("left", "right"))]
    few, large = (rc._settled(*sides, rc.DAYS, rc.AMOUNT_SHARE, rc.LIKENESS, most, taken) for most in (10**9, 0))
    assert [[(r.left_id, r.right_id) for r in x.collect()] for x in (few, large)] == [[("2", "y")]] * 2
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
