import random
from datetime import date, timedelta
from decimal import Decimal

from ledgerloom.operators import reconcile as rc
from pyspark.sql import functions as F

LEFT = "id string, account string, date date, amount decimal(14,2), description string, merchant string, category string, confidence double, posted_date date"
RIGHT = "id string, account string, date date, amount decimal(14,2), name string, merchant_name string, authorized_date date, cat string"
D0 = date(2024, 1, 15)


def left(i, day=0, amount="50.00", text="STARBUCKS STORE 12345", merchant="Starbucks", account="a", category="Dining", confidence=0.8):
    return (i, account, D0 + timedelta(day), Decimal(amount), text, merchant, category, confidence, None)


def right(i, day=0, amount="50.00", name="STARBUCKS", merchant="Starbucks", account="a"):
    return (i, account, D0 + timedelta(day), Decimal(amount), name, merchant, D0, "Travel")


def frames(spark, a, b):
    return spark.createDataFrame(a, LEFT), spark.createDataFrame(b, RIGHT)


def run(spark, a, b):
    return {r.left_id: (r.right_id, r.match_type, round(r.confidence, 2)) for r in rc.matches(*frames(spark, a, b)).collect()}


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def like(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    return 1.0 if a == b else 0.0 if not a or not b else 1 - edit(a, b) / max(len(a), len(b))


def brute(a, b):
    """All pairs, then in order of left rows the best free right row: exact ones first."""

    def score(x, y):
        if x[1] != y[1]:
            return 0, ""
        p, q = float(x[3]), abs(float(y[3]))
        near = p == q or (p and q and abs(p - q) / ((abs(p) + abs(q)) / 2) <= 0.01)
        gap = abs((x[2] - y[2]).days)
        lm, rm = x[5] or x[4], y[5] or y[4]
        s = max(like(lm, rm), like(lm, y[4]), like(x[4], y[4]), like(x[4], rm))
        c = (0.4 if p == q else 0.3 if near else 0) + (0.3 if gap == 0 else 0.2 if gap <= 3 else 0) + (0.3 if s >= 0.9 else 0.2 if s >= 0.6 else 0)
        kind = "exact" if p == q and gap == 0 and s >= 0.9 else "fuzzy" if near and gap <= 3 and s >= 0.6 else "amount_date" if near and gap <= 3 else "amount_only"
        return c, kind

    a, b = sorted(a, key=lambda r: (r[2], r[0])), sorted(b, key=lambda r: (r[2], r[0]))
    used, out = set(), {}
    for only_exact in (True, False):
        for x in a:
            if x[0] in out:
                continue
            best = None
            for y in b:
                c, kind = score(x, y)
                if y[0] not in used and c >= 0.5 and (best is None or c > best[0]):
                    best = (c, kind, y[0])
            if best and (not only_exact or best[1] == "exact"):
                out[x[0]] = (best[2], best[1], round(best[0], 2))
                used.add(best[2])
    return out


def test_literal_expectations(spark):
    assert run(spark, [left("1")], [right("x")]) == {"1": ("x", "exact", 1.0)}
    assert run(spark, [left("1")], [right("x", day=1)])["1"][1] == "fuzzy"
    assert run(spark, [left("1", amount="100.00", merchant="Aaaa", text="Aaaa")], [right("x", 5, "500.00", "Zzzz", "Zzzz")]) == {}
    a = [left("1", amount="50.00"), left("2", amount="75.00"), left("3", amount="100.00", merchant="Qqqq", text="Qqqq")]
    b = [right("x", amount="50.00"), right("y", amount="75.00"), right("z", 9, "200.00", "Zzzz", "Zzzz")]
    found = rc.matches(*frames(spark, a, b))
    s = rc.summary(*frames(spark, a, b), found).first()
    assert (s.matched, s.total_left, s.total_right, s.exact) == (2, 3, 3, 2) and abs(s.match_rate - 2 / 3) < 1e-9
    assert [r.id for r in rc.unmatched(frames(spark, a, b)[1], found, "right").collect()] == ["z"]


def test_random_against_all_pairs(spark):
    rnd = random.Random(6)
    names = ["Blue Cafe", "Blue Caffe", "Amber Books", "Amber Book Co", "Copper Fuel", "Q"]
    pick = lambda: rnd.choice(["5.00", "5.04", "10.00", "0.00", "99.99", "100.50"])
    a = [left(f"l{i:02}", rnd.randrange(14), pick(), n := rnd.choice(names), rnd.choice([n, None]), rnd.choice("ab")) for i in range(45)]
    b = [right(f"r{i:02}", rnd.randrange(14), pick(), n := rnd.choice(names), rnd.choice([n.upper(), None]), rnd.choice("ab")) for i in range(45)]
    assert run(spark, a, b) == brute(a, b)


def test_one_for_one_among_many_equals(spark):
    a = [left(f"l{i:02}") for i in range(30)]
    b = [right(f"r{i:02}") for i in range(20)]
    got = run(spark, a, b)
    assert len(got) == 20 and {v[0] for v in got.values()} == {f"r{i:02}" for i in range(20)} and set(got) == {f"l{i:02}" for i in range(20)}


def test_passes_and_rounds_give_the_same(spark):
    rnd = random.Random(9)
    edges = {(f"l{rnd.randrange(40):02}", f"r{rnd.randrange(40):02}") for _ in range(240)}
    rows = [("a", l, r, round(rnd.choice([0.5, 0.6, 0.7, 0.9]), 1), D0 + timedelta(int(l[1:]) % 7), D0 + timedelta(int(r[1:]) % 5)) for l, r in sorted(edges)]  # noqa: E741
    # A chain: every left row would rather have what the one before it takes.
    rows += [("b", f"c{i:03}", f"d{j:03}", 0.9 - 0.1 * (j - i + 1), D0, D0) for i in range(200) for j in (i - 1, i) if j >= 0]
    df = spark.createDataFrame(rows, "account string, left_id string, right_id string, confidence double, l_date date, r_date date")
    got = [sorted((r.left_id, r.right_id) for r in rc.assign(df, most).collect()) for most in (10**6, 300, 0)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 200
    assert rc.assign(df.limit(0)).count() == 0


def test_an_account_of_many_edges_takes_one_pass(spark, monkeypatch):
    monkeypatch.setattr(rc, "_by_rounds", lambda edges: 1 / 0)
    n = F.col("id")
    df = spark.range(700 * 300).select(F.lit("a").alias("account"), F.format_string("l%03d", F.floor(n / 300)).alias("left_id"), F.format_string("r%03d", n % 300).alias("right_id"), F.lit(0.5).alias("confidence"), F.lit(D0).alias("l_date"), F.lit(D0).alias("r_date"))
    assert sorted((r.left_id, r.right_id) for r in rc.assign(df).collect()) == [(f"l{i:03}", f"r{i:03}") for i in range(300)]


def test_letters_rule_out_no_similar_texts(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aabe 17#é") for _ in range(rnd.randrange(14)))
    texts = [(x := word(), "".join(rnd.choice("ab1 ") if rnd.random() < 0.2 else c for c in x)) for _ in range(400)] + [("", ""), ("a", ""), (None, "a")]
    from ledgerloom.functions.scalars import letters, similarity_from
    import pyarrow as pa

    bits = [letters(pa.array([t[i] for t in texts], pa.string())).to_pylist() for i in (0, 1)]
    df = spark.createDataFrame([(*t, *b) for t, b in zip(texts, zip(*bits))], "p string, q string, p_letters bigint, q_letters bigint").selectExpr("*", "length(p) p_length", "length(q) q_length")
    for r in df.select("p", "q", similarity_from("p", "q", 0.6, True).alias("fast"), similarity_from("p", "q", 0.6).alias("slow")).collect():
        assert r.fast == r.slow == (like(r.p, r.q) if r.p is not None and (r.p == r.q or like(r.p, r.q) >= 0.6) else 0.0) or r.p is None or r.p != r.p.strip() or r.q != r.q.strip()


def test_nulls_and_empty(spark):
    hole = ("n", "a", None, None, None, None, None, None, None)
    assert run(spark, [hole, left("1")], [right("x"), ("m", "a", None, None, None, None, None, None)]) == {"1": ("x", "exact", 1.0)}
    assert run(spark, [], [right("x")]) == {} and run(spark, [left("1")], []) == {}


def test_merge_and_enrich(spark):
    a, b = frames(spark, [left("1", confidence=0.6), left("2", 20, confidence=0.9)], [right("x"), right("y", 40, "7.00")])
    found = rc.matches(a, b)
    mapping = F.struct(F.col("cat").alias("category"), F.lit(None).cast("string").alias("subcategory"))
    rows = {r.id: r for r in rc.merged(a, b, found, mapping).collect()}
    assert rows["1"].category == "Travel" and rows["1"].confidence == 0.7 and rows["1"].origin == "both" and rows["2"].category == "Dining" and rows["plaid_y"].origin == "feed"
    e = {r.id: r for r in rc.enriched(a, b, found, replace_merchant=True).collect()}
    assert e["1"].feed_id == "x" and e["2"].feed_id is None and e["2"].merchant == "Starbucks"


def test_own_account_among_equal_masks(spark):
    """Least ids belong to strangers: another bank's account (f, g), another user's of the same bank (h)."""
    accounts = spark.createDataFrame(
        [("a1", "Harbor Bank", "checking", "****1234"), ("a2", "Meadow Credit Union", "CHECKING", "****1234"), ("a3", "Meadow Credit Union", "checking", "****7777"), ("a4", "Meadow Credit Union", "checking", "****7777"), ("a5", "Other", "savings", "****1234")],
        "id string, institution string, account_type string, account_number_masked string",
    )
    feed_accounts = spark.createDataFrame(
        [("f", "MEADOW C.U.", "depository", "checking", "1234"), ("g", "Harbor", "depository", "checking", "1234"), ("h", "Meadow Credit Union", "depository", "checking", "7777"), ("i", "Elsewhere", "depository", "savings", "1234"), ("j", "Meadow", "depository", "checking", None)],
        "account_id string, institution_name string, type string, subtype string, mask string",
    )
    ledger = spark.createDataFrame([("a3", D0, Decimal("-5.25"), "debit"), ("a4", D0, Decimal("-9.75"), " Debit"), ("a4", D0 + timedelta(40), Decimal("8.10"), "credit")], "account string, date date, amount decimal(14,2), direction string")
    feed = spark.createDataFrame([("h", D0 + timedelta(2), Decimal("9.75")), ("h", D0 + timedelta(41), Decimal("-8.10")), ("h", D0, Decimal("5.25"))], "feed_account string, date date, amount decimal(14,2)")
    got = {r.feed_account: r.account for r in rc.linked_accounts(accounts, feed_accounts, ledger, feed).collect()}
    assert got == {"f": "a2", "g": "a1", "h": "a4", "i": "a5"}
    assert {tuple(r) for r in rc.accounts_of_mask(accounts, feed_accounts).where("feed_account = 'f'").collect()} == {("f", "a1", False), ("f", "a2", True)}


def test_registered_matches_use_the_own_account(spark, tmp_path):
    account = "id string, institution string, account_type string, account_number_masked string"
    feed_account = "account_id string, institution_name string, type string, subtype string, mask string"
    lines = "id string, account_id string, date date, posted_date date, amount decimal(14,2), direction string, description string, merchant string, category string, confidence double"
    rows = "feed_seq bigint, transaction_id string, account_id string, date date, authorized_date date, amount decimal(14,2), name string, merchant_name string, pfc_primary string, pfc_detailed string, pending boolean"
    for name, data, schema in (
        ("accounts", [("a1", "Harbor Bank", "checking", "****1234"), ("a2", "Meadow Bank", "checking", "****1234")], account),
        ("plaid_accounts", [("f", "Meadow Bank", "depository", "checking", "1234")], feed_account),
        ("ledger_transactions", [("l", "a2", D0, None, Decimal("-5.25"), "debit", "BLUE CAFE", None, None, None)], lines),
        ("plaid_transactions", [(1, "x", "f", D0, None, Decimal("5.25"), "Blue Cafe", None, None, None, False)], rows),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    from ledgerloom.plans.reconciled import reconcile_matches

    assert [(r.left_id, r.right_id) for r in reconcile_matches(spark, str(tmp_path)).collect()] == [("l", "x")]
