import json
from datetime import date, datetime, timedelta
from decimal import Decimal

from ledgerloom.operators.schema_drift import changes, consistent_rows, leaf_type, meaning, promote, union_schema, wide_table, with_previous

T0 = datetime(2024, 1, 1)


def table(spark, docs, source="s"):
    rows = [(f"r{i}", source, T0 + timedelta(hours=30 * i), x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(docs)]
    return spark.createDataFrame(rows, "id string, source string, at timestamp, doc string")


def diff(spark, *docs):
    got = changes(table(spark, docs), "id", "source", "at", "doc").collect()
    return sorted((r.id, r.field_path, r.change_kind) for r in got)


def test_added_removed_nested(spark):
    a = {"x": 1, "l": [{"p": 1, "q": "u"}, {"p": 2}]}
    b = {"x": 1, "l": [{"p": 1}, {"p": 2, "new": True}]}
    assert diff(spark, a, b) == [("r1", "l[].new", "added"), ("r1", "l[].q", "removed")]


def test_key_order_and_values_are_no_change(spark):
    assert diff(spark, {"a": 1, "b": {"c": 2, "d": 3}}, {"b": {"d": 4, "c": 2.0}, "a": 7}) == []


def test_renamed_moved_and_retyped(spark):
    a = {"total": 12.5, "acc": [{"amount": 3.10, "on": "2024-05-01"}, {"amount": 4, "on": "2024-05-02"}]}
    b = {"sum": "12.50", "list": [{"amount": 3.1, "on": 20240501}, {"amount": 4, "on": 20240502}]}
    assert diff(spark, a, b) == [
        ("r1", "list[].amount", "renamed"), ("r1", "list[].on", "renamed"), ("r1", "list[].on", "retyped"), ("r1", "sum", "renamed"), ("r1", "sum", "retyped"),
    ]


def test_retyped_in_place_needs_the_same_meaning(spark):
    assert diff(spark, {"a": True, "v": "v2"}, {"a": "true", "v": 2}) == [("r1", "a", "retyped"), ("r1", "v", "retyped")]
    assert diff(spark, {"a": 5}, {"a": "other"}) == []
    assert diff(spark, {"a": 5}, {"a": 5.0}) == []
    assert diff(spark, {"a": [None, 5]}, {"a": [None, "5"]}) == [("r1", "a[]", "retyped")]


def test_null_fields_are_renamed_only_to_their_own_name(spark):
    assert diff(spark, {"a": {"memo": None}}, {"b": {"memo": None}}) == [("r1", "b.memo", "renamed")]
    assert diff(spark, {"a": None}, {"b": None}) == [("r1", "a", "removed"), ("r1", "b", "added")]


def test_nearest_name_wins_among_equal_values(spark):
    got = diff(spark, {"startBalance": 5, "endBalance": 5}, {"start_balance": 5, "end_balance": 5})
    assert got == [("r1", "end_balance", "renamed"), ("r1", "start_balance", "renamed")]


def test_renames_leave_no_pair_of_equal_values_over(spark):
    """(ab, abx) is best, and both other fields are nearer to it than to each other."""
    assert diff(spark, {"ab": 5, "abpqrs": 5}, {"abx": 5, "abuvwxyz": 5}) == [("r1", "abuvwxyz", "renamed"), ("r1", "abx", "renamed")]
    got = diff(spark, {f"f{i}": 0 for i in range(6)}, {f"g{'h' * i}": 0 for i in range(5)})
    assert [k for *_, k in got].count("renamed") == 5 and [k for *_, k in got].count("removed") == 1


def test_broken_null_and_scalar_documents_are_left_out(spark):
    assert diff(spark, {"a": 1}, '{"a": ', None, "5", {"b": 2}) == [("r4", "a", "removed"), ("r4", "b", "added")]
    assert diff(spark) == []


def test_union_schema_and_table(spark):
    df = table(spark, [{"a": 1, "b": "x", "d": "2024-01-02"}, {"a": 2.5, "b": None, "e": []}, {"a": None, "c": True, "d": "2024-01-03"}])
    got = {r.path: (r.type, r.documents) for r in union_schema(df, "doc").collect()}
    assert got == {"a": ("number", 3), "b": ("string", 2), "c": ("boolean", 1), "d": ("date", 2)}
    rows = {(r.id, r.path): r.value for r in consistent_rows(df, "id", "doc").collect()}
    assert rows["r0", "a"] == "1.0" and rows["r1", "b"] is None and rows["r2", "c"] == "true" and rows["r2", "d"] == "2024-01-03"


def test_previous_across_days_and_ties(spark):
    rows = [("a", "s", T0), ("b", "s", T0), ("c", "s", T0 + timedelta(days=3)), ("d", "t", T0), ("e", None, T0)]
    got = {r.id: r.prev for r in with_previous(spark.createDataFrame(rows, "id string, g string, t timestamp"), "id", "g", "t").collect()}
    assert got == {"a": None, "b": "a", "c": "b", "d": None}


def test_meaning_and_lattice():
    assert meaning("1,234.50") == meaning(1234.5) and meaning("5") == meaning(5.0) and meaning("true") == meaning(True) and meaning(None) is None
    assert meaning("abc") == "abc" and meaning("") == ""
    assert promote("integer", "number") == "number" and promote("null", "date") == "date" and promote("date", "number") == "string"


def test_deep_and_long_documents(spark):
    deep = '{"a": ' * 200 + "1" + "}" * 200
    long = {"t": "x" * 300_000}
    assert diff(spark, deep, deep) == [] and diff(spark, long, {**long, "n": 1}) == [("r1", "n", "added")]


def test_numbers_stay_exact(spark):
    df = table(spark, ['{"a": 12345678901234567890.12, "b": 9223372036854775808, "c": 7, "l": [{"x": 1}, {"x": 2.50}]}', '{"a": 1, "b": 2, "c": 8, "z": 1e300, "l": [{"x": null}]}'])
    rows = {(r.id, r.path, r.position): r for r in consistent_rows(df, "id", "doc").collect()}
    assert rows["r0", "a", 0].as_number == Decimal("12345678901234567890.12") and rows["r0", "a", 0].value == "12345678901234567890.12"
    assert rows["r0", "b", 0].as_number == 2**63 and rows["r1", "b", 0].value == "2.0" and rows["r0", "c", 0].as_integer == 7 and rows["r1", "z", 0].as_real == 1e300
    assert rows["r0", "l[].x", 1].as_number == Decimal("2.5") and rows["r1", "l[].x", 0].value is None


def test_wide_table_is_typed(spark):
    df = table(spark, [{"a": 1, "d": "2024-01-02", "l": [{"x": 1.5}, {"x": 2}], "k.v w": True}, {"a": 2.25, "d": None, "n": None}, "broken", None])
    wide = wide_table(df, "id", "doc")
    assert dict(wide.dtypes) == {"id": "string", "a": "decimal(38,12)", "d": "date", "k.v w": "boolean", "l[].x": "array<decimal(38,12)>", "n": "string"}
    assert sorted(tuple(r) for r in wide.collect()) == [("r0", Decimal(1), date(2024, 1, 2), True, [Decimal("1.5"), Decimal(2)], None), ("r1", Decimal("2.25"), None, None, None, None)]
    assert wide_table(df.limit(0), "id", "doc").columns == ["id"]


def test_wide_table_of_names_that_differ_in_case(spark, tmp_path):
    df = table(spark, [{"l": [{"subCategory": "a"}], "ID": 7}, {"l": [{"subcategory": "b"}], "Id": True}])
    wide_table(df, "id", "doc").write.parquet(f"{tmp_path}/wide")
    rows = spark.read.parquet(f"{tmp_path}/wide")
    assert rows.columns == ["id", "ID (2)", "Id (3)", "l[].subCategory", "l[].subcategory (2)"]
    assert sorted(tuple(r) for r in rows.collect()) == [("r0", 7, None, ["a"], None), ("r1", None, True, None, ["b"])]


def test_lattice_is_one():
    kinds = ["null", "boolean", "integer", "number", "real", "date", "string"]
    for a in kinds:
        for b in kinds:
            assert promote(a, b) == promote(b, a) and all(promote(promote(a, b), c) == promote(a, promote(b, c)) for c in kinds)
    assert [leaf_type(x) for x in (None, True, 5, 2**63, 5.5, 1e300, "2024-01-02", "x")] == ["null", "boolean", "integer", "number", "number", "real", "date", "string"]
