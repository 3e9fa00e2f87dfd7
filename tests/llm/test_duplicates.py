import random
import re
from datetime import date, datetime
from decimal import Decimal

from ledgerloom.llm import format_duplicates as dup
from ledgerloom.llm import survivor
from ledgerloom.llm.components import roots

SCHEMA = "id string, account_id string, date date, amount decimal(14,2), direction string, description string, merchant string, category string, raw string, confidence double, created_at timestamp, class string, root string"


def line(i, text, amount="5.00", direction="debit", account="a", day=1, **k):
    return (i, account, date(2024, 1, day), Decimal(amount) if amount else None, direction, text, k.get("merchant"), k.get("category"), k.get("raw"), k.get("confidence"), k.get("at", datetime(2024, 1, 1)), "own", "own")


def classes(spark, rows, carry=None):
    return dup.classed(spark.createDataFrame(rows, SCHEMA), "id", dup.ledger_cell(), "description", carry)


def pairs(spark, rows, hot=dup.HOT_COPIES):
    return sorted(tuple(r) for r in dup.copy_pairs(classes(spark, rows), hot).collect())


def test_layout_only(spark):
    rows = [line("1", "POS PURCHASE; BLUE CAFE; TERM 5"), line("2", " pos purchase  blue cafe term 5. "), line("3", "TERM 5|BLUE CAFE|POS PURCHASE", "-5.00", " Debit"), line("4", "POS PURCHASE BLUE CAFE TERM 6"), line("5", "BLUE POS PURCHASE CAFE TERM 5")]
    assert pairs(spark, rows) == [("1", "2"), ("1", "3"), ("2", "3")]


def test_labelled_fields_move(spark):
    a = "HALDEN SCHOOLS DES:SALARY ID:22 INDN:NERYS OKANVAR CO ID:55 PPD"
    b = "HALDEN SCHOOLS CO ID:55 PPD DES:SALARY INDN:NERYS OKANVAR ID:22"
    assert pairs(spark, [line("1", a), line("2", b), line("3", a.replace("22", "23"))]) == [("1", "2")]


def test_copy_of_a_copy(spark):
    # 2 and 4 meet only by way of 1 and 3: an order of fields in 1-3, stripped separators in 2 and 4.
    rows = [line("1", "A;B C;D"), line("2", "ABCD"), line("3", "D;A;B C"), line("4", "d a b c")]
    assert len(pairs(spark, rows)) == 6


def test_other_cells_nulls_and_empty_texts(spark):
    rows = [line("1", "x"), line("2", "x", day=2), line("3", "x", "6.00"), line("4", "x", direction="credit"), line("5", "x", account="b"), line("6", None), line("7", None), line("8", ""), line("9", " -. "), line("n", "x", None), line("m", "X", None)]
    assert pairs(spark, rows) == [("6", "7"), ("8", "9"), ("m", "n")]
    assert pairs(spark, []) == []


def test_hot_class_is_salted_and_whole(spark):
    rows = [line(f"{i:03}", "SAME; LINE" if i % 2 else "line|same") for i in range(120)] + [line("z", "other")]
    assert len(pairs(spark, rows, hot=10)) == 120 * 119 // 2 == len(pairs(spark, rows))
    got = {r.id: r.copies for r in dup.collapse(classes(spark, rows), hot=10).collect()}
    assert got == {"000": 120, "z": 1} == {r.id: r.copies for r in dup.collapse(classes(spark, rows)).collect()}


def test_very_long_text(spark):
    t = "word " * 40_000
    assert pairs(spark, [line("1", t), line("2", t.upper()), line("3", t + "x")]) == [("1", "2")]


def test_random_against_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(150):
        parts = [rnd.choice(["AB", "A B", "ab"]), rnd.choice(["C", "c"]), rnd.choice(["DE", "D-E"])]
        rnd.shuffle(parts)
        rows.append(line(f"{i:03}", rnd.choice(["; ", "|", " ", " ; "]).join(parts), rnd.choice(["1.00", "-1.00", "2.00"])))
    norm = lambda t: re.sub(r"[^a-z0-9]", "", t.lower())
    keys = {r[0]: (abs(r[3]), norm(r[5]), tuple(sorted(map(norm, re.split("[;|]", r[5]))))) for r in rows}
    group = {i: i for i in keys}
    changed = True
    while changed:
        changed = False
        for a, x in keys.items():
            for b, y in keys.items():
                if x[0] == y[0] and (x[1] == y[1] or x[2] == y[2]) and group[a] < group[b]:
                    group[b] = group[a]
                    changed = True
    want = sorted((a, b) for a in keys for b in keys if a < b and group[a] == group[b])
    assert pairs(spark, rows) == want


def test_roots_of_long_chains(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("x", "y"), ("y", "x"), ("q", "q"), (None, "x")]
    got = {r.node: r.root for r in roots(spark.createDataFrame(chain, "a string, b string"), "a", "b").collect()}
    assert got == {f"n{i:03}": "n000" for i in range(1, 61)} | {"y": "x"}


# ---- survivors ----


def best(spark, rows):
    members = classes(spark, rows, survivor.carried(survivor.ledger_fields()))
    return {(r.group_id, r.field_name): r.source_id for r in survivor.best_fields(members, ["merchant", "category", "raw"]).collect()}


def test_order_of_preference(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [
        line("1", "x", merchant='{"a": "v", "b": "TBD", "c": false}', category="Uncategorized", raw='{"p": 0}', confidence=0.9, at=day(1)),
        line("2", "X", merchant='{"a": "v", "b": "w", "c": null}', category="Dining", raw='{"p": 0}', confidence=0.9, at=day(3)),
        line("3", "x.", merchant='{"a": "v", "b": "w"}', category="Food", raw='{"p": "n/a"}', confidence=None, at=day(9)),
        line("9", "alone", merchant='{"a": "v"}'),
    ]
    assert best(spark, rows) == {("1", "merchant"): "2", ("1", "category"): "2", ("1", "raw"): "2"}


def test_no_value_no_row_and_broken_json(spark):
    rows = [line("1", "x", merchant="{broken", category=" ", raw="[1]"), line("2", "x", merchant='{"a": "--", "b": " "}', category="n/a", raw=None, confidence=float("nan"))]
    assert best(spark, rows) == {}
    assert best(spark, []) == {}


def test_full_ties_go_to_the_least_id(spark):
    rows = [line(i, "x", category="A", confidence=0.5) for i in ("3", "1", "2")]
    assert best(spark, rows) == {("1", "category"): "1"}


def test_values_pivot_back(spark):
    rows = [line("2", "x", category="A", confidence=0.5), line("1", "x", category="B", confidence=0.5), line("3", "x", category="A", confidence=0.4)]
    df = spark.createDataFrame(rows, SCHEMA)
    members = dup.classed(df, "id", dup.ledger_cell(), "description", survivor.carried(survivor.ledger_fields()))
    found = survivor.best_fields(members, ["merchant", "category", "raw"])
    assert [tuple(r) for r in found.collect()] == [("1", "category", "2")]
    row = survivor.survivors(df, "id", found, ["merchant", "category", "raw"]).first()
    assert row.merchant is None and row.category == "A"


def test_votes_decide_equal_ranks(spark):
    """Two rows of equal rank: the value for which more copies vote."""
    rows = [line("1", "x", category="B", confidence=0.5), line("2", "x", category="A", confidence=0.5), line("3", "x", category="A", confidence=0.4)]
    assert best(spark, rows)["1", "category"] == "2"


def test_group_without_values_keeps_its_record(spark):
    """A group in which no copy holds a value gives a record of nulls; a line without copies gives none."""
    rows = [line("2", "x", category=" "), line("1", "x"), line("4", "y", category="A"), line("3", "y"), line("9", "alone", category="A")]
    df = spark.createDataFrame(rows, SCHEMA)
    members = dup.classed(df, "id", dup.ledger_cell(), "description", survivor.carried(survivor.ledger_fields()))
    fields = ["merchant", "category", "raw"]
    found = survivor.best_fields(members, fields)
    assert sorted(map(tuple, survivor.survivors(df, "id", found, fields, members).collect()), key=str) == [("1", None, None, None), ("3", None, "A", None)]


def test_registered_survivors_hold_every_group(spark, tmp_path):
    from ledgerloom.llm.queries import p5_survivors

    spark.createDataFrame([line("2", "x"), line("1", "x")], SCHEMA).write.parquet(f"{tmp_path}/ledger_transactions.parquet")
    assert [tuple(r) for r in p5_survivors(spark, str(tmp_path)).collect()] == [("1", None, None, None)]


def voted(spark, rows):
    df = spark.createDataFrame([(*r, rule, st) for r, rule, st in rows], SCHEMA + ", rule_id string, statement_db_id string")
    fields = survivor.ledger_fields()
    members = dup.classed(df, "id", dup.ledger_cell(), "description", survivor.carried(fields, source=survivor.ledger_source(df)))
    best = survivor.voted_fields(members, ["merchant", "category", "raw"])
    return {(r.group_id, r.field_name): r.source_id for r in best.collect()}, df, members, fields


def test_votes_of_many_outweigh_a_single_one(spark):
    day = lambda n: datetime(2024, 1, n)
    rows = [(line(str(i), "x", category="Food", confidence=0.3, at=day(i)), "card-1", None) for i in (1, 2, 3)] + [(line("4", "X.", category="Fuel", confidence=0.9, at=day(4)), "card-2", None)]
    assert voted(spark, rows)[0] == {("1", "category"): "3"}


def test_old_votes_and_distrusted_sources_weigh_less(spark):
    old, new = datetime(2020, 1, 1), datetime(2024, 1, 1)
    rows = [(line("1", "x", category="Food", at=old), "card-1", None), (line("2", "x", category="food ", at=old), "card-1", None), (line("3", "x", category="Fuel", at=new), "card-1", None)]
    assert voted(spark, rows)[0] == {("1", "category"): "3"}
    # A source whose values no other copy ever confirms loses against one whose values are confirmed.
    rows = [(line(f"{g}{i}", f"row {g}", category=f"C{g}", at=new), "ach-1", "s") for g in "abcd" for i in (1, 2)]
    rows += [(line(f"{g}3", f"row {g}", category=f"{g}", at=new), "check-1", None) for g in "abcd"]
    rows += [(line("z1", "last", category="A", confidence=0.1, at=new), "ach-2", "t"), (line("z2", "last", category="B", confidence=0.9, at=new), "check-3", None)]
    assert voted(spark, rows)[0]["z1", "category"] == "z1"


def test_attributes_vote_whatever_their_order(spark):
    rows = [(line("1", "x", merchant='{"a": "V", "b": "w"}', confidence=0.1), None, None), (line("2", "x", merchant='{"b": "W", "a": " v"}', confidence=0.2), None, None), (line("3", "x", merchant='{"a": "q", "b": "w"}', confidence=0.9), None, None)]
    got, df, members, fields = voted(spark, [*rows, (line("9", "alone", merchant='{"a": "q"}', category="n/a"), None, None)])
    assert got == {("1", "merchant"): "2"}
    one = survivor.single_records(df, "id", members, {k: v[0] for k, v in fields.items()}).collect()
    assert [tuple(r) for r in one] == [("9", '{"a": "q"}', None, None)]
    assert voted(spark, [])[0] == {}


def test_members_of_hot_and_other_classes(spark):
    rows = [line(f"{i:03}", "SAME; LINE" if i % 2 else "line|same") for i in range(60)] + [line("y", "two"), line("x", "TWO"), line("z", "other")]
    want = sorted([(f"{i:03}", "000", 60) for i in range(60)] + [("x", "x", 2), ("y", "x", 2), ("z", "z", 1)])
    for hot in (10, dup.HOT_COPIES):
        assert sorted(tuple(r)[:3] for r in dup.copies(classes(spark, rows), hot).collect()) == want
