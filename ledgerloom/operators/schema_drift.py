"""JSON documents whose fields drift between runs.

Headers (leaf path, type, signature of the values) are read from all documents in parallel and folded
through a type-promotion lattice into one union schema, and documents are cast to it. Each document is
compared with the one before it of its source, and the ordered differences are logged.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage

LEAVES = "array<struct<path:string,type:string,kind:string,sig:bigint,blank:boolean>>"
#: The lattice of leaf types: what each can hold, the narrower first. A field takes the first type that holds
#: all it was seen with. number is exact, with as many digits as WHOLE and FRACTION; real is any other.
HOLDS = {
    "null": {"null"},
    "boolean": {"null", "boolean"},
    "integer": {"null", "integer"},
    "number": {"null", "integer", "number"},
    "real": {"null", "integer", "number", "real"},
    "date": {"null", "date"},
    "string": {"null", "boolean", "integer", "number", "real", "date", "string"},
}
WHOLE, FRACTION = 26, 12
SQL_TYPES = {"null": "string", "boolean": "boolean", "integer": "bigint", "number": f"decimal({WHOLE + FRACTION},{FRACTION})", "real": "double", "date": "date", "string": "string"}
#: The type among string, number and boolean that JSON itself has.
JSON_KIND = {"null": "", "boolean": "boolean", "integer": "number", "number": "number", "real": "number", "date": "string", "string": "string"}
_DATE, _NUMBER, _VERSION = re.compile(r"\d{4}-\d\d-\d\d"), re.compile(r"[-+]?(\d[\d,]*\.?\d*|\.\d+)([eE][-+]?\d+)?"), re.compile(r"[vV](\d+(\.\d+)?)")
#: Values a worker remembers the meaning of before it forgets all.
REMEMBERED = 100_000


class Number(str):
    """A JSON number as it was written."""

    __slots__ = ()


def promote(a: str, b: str) -> str:
    """The least upper bound of two leaf types."""
    return a if a == b else next(t for t, held in HOLDS.items() if a in held and b in held)


def promoted(kinds: Column) -> Column:
    """The least upper bound of an array of leaf types."""
    return F.coalesce(*[F.when(F.size(F.array_except(kinds, F.array(*map(F.lit, sorted(held))))) == 0, t) for t, held in HOLDS.items()])


def number_text(raw: str) -> str:
    """A number without thousands marks, exponent, leading and trailing zeros; exact."""
    raw = raw.replace(",", "").lstrip("+")
    if "e" in raw or "E" in raw:
        d = Decimal(raw).normalize()
        return format(d, "f") if -400 < d.adjusted() < 400 else str(d)
    sign, raw = ("-", raw[1:]) if raw[:1] == "-" else ("", raw)
    whole, _, rest = raw.partition(".")
    whole, rest = whole.lstrip("0") or "0", rest.rstrip("0")
    return sign + whole + "." + rest if rest else "0" if whole == "0" else sign + whole


def _native(value: object) -> object:
    return Number(repr(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def meaning(value: object) -> str | None:
    """What a leaf says, whatever JSON type it has: 5, 5.0 and "5.00" say the same, as do true and "true",
    "2024-03-01" and 20240301, "v2" and 2. None for null."""
    value = _native(value)
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Number):
        return number_text(value) if _NUMBER.fullmatch(value) else str(value)
    text = value.strip()
    if text[:1].isalpha():
        if text.lower() in ("true", "false"):
            return text.lower()
        return number_text(m[1]) if (m := _VERSION.fullmatch(text)) else text
    if _DATE.fullmatch(text):
        return text.replace("-", "")
    bare = text.lstrip("$€£¥").replace(" ", "")
    return number_text(bare) if _NUMBER.fullmatch(bare) else text


def leaf_type(value: object) -> str:
    value = _native(value)
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, Number):
        text = number_text(value) if _NUMBER.fullmatch(value) else "e"
        whole, point, rest = text.lstrip("-").partition(".")
        if "E" in text or not whole.isdigit() or len(whole) > WHOLE or len(rest) > FRACTION:
            return "real"
        return "integer" if not point and "." not in value and -(2**63) <= int(text) < 2**63 else "number"
    return "date" if _DATE.fullmatch(value) else "string"


def _walk(node: object, path: str, out: dict[str, list]) -> None:
    todo = [(node, path)]
    while todo:  # no recursion: documents may be nested deeply
        node, path = todo.pop()
        if isinstance(node, dict):
            todo += reversed([(v, f"{path}.{k}" if path else k) for k, v in node.items()])
        elif isinstance(node, list):
            inner = f"{path}[]"
            todo += reversed([(v, inner) for v in node])
        else:
            out.setdefault(path, []).append(node)


def leaves_of(text: str | None) -> dict[str, list] | None:
    """path -> values in their order; None if the text is null or no JSON object or array."""
    try:
        doc = json.loads(text, parse_int=Number, parse_float=Number, parse_constant=Number) if text is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(doc, (dict, list)):
        return None
    leaves: dict[str, list] = {}
    _walk(doc, "", leaves)
    return leaves


_said: dict[tuple[type, object], tuple[str, str]] = {}


def _read(value: object) -> tuple[str, str]:
    """(type, meaning) of a leaf, remembered; the meaning of null is a mark of its own."""
    key = (value.__class__, value)
    if (known := _said.get(key)) is None:
        if len(_said) >= REMEMBERED:
            _said.clear()
        known = _said[key] = (leaf_type(value), "\x00" if value is None else meaning(value))
    return known


def header(text: str | None) -> list[tuple] | None:
    """The leaves of one document; None if it is null or no JSON object or array."""
    leaves = leaves_of(text)
    if leaves is None:
        return None
    out = []
    for path in sorted(leaves):
        read = [_read(v) for v in leaves[path]]
        types = {t for t, _ in read}
        kind = functools.reduce(promote, types)
        classes = {JSON_KIND[t] for t in types} - {""}
        sig = hashlib.blake2b("\x01".join([m for _, m in read]).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        out.append((path, kind, "|".join(sorted(classes)), int.from_bytes(sig, "big", signed=True), not classes))
    return out


def headers(df: DataFrame, id_: str, document: str) -> DataFrame:
    """(id, leaves) of each row whose document is JSON; leaves are sorted by path."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = pd.DataFrame({"id": b["id"], "leaves": [header(t) for t in b["document"]]})
            yield b[b["leaves"].notna()]

    kind = dict(df.dtypes)[id_]
    return df.select(F.col(id_).alias("id"), F.col(document).alias("document")).mapInPandas(read, f"id {kind}, leaves {LEAVES}")


def folded(seen: DataFrame) -> DataFrame:
    """(path, type, documents) of rows (path, type, n): the fold of each path's types."""
    return seen.groupBy("path").agg(F.collect_set("type").alias("kinds"), F.sum("n").alias("documents")).select("path", promoted(F.col("kinds")).alias("type"), "documents")  # as many kinds as HOLDS has, at most


def union_schema(df: DataFrame, document: str) -> DataFrame:
    """(path, type, documents): every leaf path of all documents with its promoted type.

    Types are folded on each partition first; a row per distinct path and type leaves it.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], int] = {}
        for b in batches:
            for text in b["document"]:
                for path, values in (leaves_of(text) or {}).items():
                    kind = "null"
                    for v in values:
                        kind = promote(kind, _read(v)[0])
                    seen[path, kind] = seen.get((path, kind), 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["path", "type", "n"])

    seen = df.select(F.col(document).alias("document")).mapInPandas(read, "path string, type string, n bigint")
    return folded(seen.groupBy("path", "type").agg(F.sum("n").alias("n")))


def typed_leaves(df: DataFrame, id_: str, document: str) -> DataFrame:
    """(id, leaves) of each JSON document, with the values' texts; cut off from its lineage, so documents are read once."""

    def said(v: object) -> str | None:
        return None if v is None else ("true" if v else "false") if isinstance(v, bool) else meaning(v) if isinstance(v, Number) else v

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["document"]):
                leaves = leaves_of(text)
                if leaves is None:
                    continue
                out = []
                for path, values in leaves.items():
                    kind = "null"
                    for v in values:
                        kind = promote(kind, _read(v)[0])
                    out.append((path, kind, [said(v) for v in values]))
                rows.append((key, out))
            yield pd.DataFrame(rows, columns=["id", "leaves"])

    kind = dict(df.dtypes)[id_]
    docs = df.select(F.col(id_).alias("id"), F.col(document).alias("document")).mapInPandas(read, f"id {kind}, leaves array<struct<path:string,type:string,said:array<string>>>")
    return cut_lineage(docs)


def schema_of(leaves: DataFrame) -> DataFrame:
    """The union schema of typed leaves or headers, as union_schema gives it."""
    return folded(leaves.select(F.explode("leaves").alias("x")).groupBy("x.path", "x.type").agg(F.count("*").alias("n")))


def cast(text: Column, type_: str) -> Column:
    """A leaf's text in a type of the lattice."""
    return text.try_cast(SQL_TYPES[type_])


def consistent_rows(df: DataFrame, id_: str, document: str) -> DataFrame:
    """(id, path, type, position, value, as_boolean, as_integer, as_number, as_real, as_date): all documents as one table in the union schema.

    Each leaf is a row; type is its path's in the union schema, and of the as_ columns the one of that
    type holds its value, numbers exactly. value is the value's text, also for strings: numbers without
    thousands marks and with a point unless the type is integer, dates as yyyy-mm-dd, booleans as true or
    false. position counts the elements of arrays in their order. A field that a document lacks has no
    row there; a null leaf has null values.
    """
    docs = typed_leaves(df, id_, document)
    rows = docs.select("id", F.explode("leaves").alias("x")).select("id", "x.path", F.posexplode("x.said").alias("position", "said"))
    typed = rows.join(schema_of(docs).select("path", "type"), "path")
    pointed = F.when(F.col("type").isin("number", "real") & ~F.contains("said", F.lit(".")), F.concat("said", F.lit(".0"))).otherwise(F.col("said"))
    own = [F.when(F.col("type") == t, cast(F.col("said"), t)).alias(f"as_{t}") for t in ("boolean", "integer", "number", "real", "date")]
    return typed.select("id", "path", "type", "position", pointed.alias("value"), *own)


def column_names(paths: list[str], id_: str) -> list[str]:
    """A name for each path; as Spark takes names that differ in case alone for one, the second such path is named with (2), and so on."""
    taken, names = {id_.lower()}, []
    for path in paths:
        name, n = path, 1
        while name.lower() in taken:
            n += 1
            name = f"{path} ({n})"
        taken.add(name.lower())
        names.append(name)
    return names


def wide_table(df: DataFrame, id_: str, document: str) -> DataFrame:
    """(id, a column for each path): all documents as one table with a typed column for each field.

    A path with [] is an array of its type, in the order of the elements; other paths are values of their
    type. Fields that a document lacks are null. The union schema's paths become the table's columns, so
    it is collected: as many rows as the table has columns. They are named as column_names() says.
    """
    docs = typed_leaves(df, id_, document)
    columns = sorted(schema_of(docs).collect(), key=lambda r: r["path"])
    said = docs.select("id", F.map_from_entries(F.transform("leaves", lambda x: F.struct(x["path"], x["said"]))).alias("m"))
    value = lambda r: F.transform(F.col("m")[r["path"]], lambda v: cast(v, r["type"]))
    names = column_names([r["path"] for r in columns], id_)
    return said.select(F.col("id").alias(id_), *[(value(r) if "[]" in r["path"] else F.get(value(r), F.lit(0))).alias(name) for r, name in zip(columns, names)])


def with_previous(df: DataFrame, id_: str, group: str, at: str) -> DataFrame:
    """(id, prev): for each row the id of the row before it in its group by time, then id; null for the first.

    A group is ordered day by day, then over its days, so that no task sorts a whole group that holds a
    large part of all rows. Rows without group or time have no place in an order and are left out.
    """
    rows = df.select(F.col(id_).alias("id"), F.col(group).alias("g"), F.col(at).alias("t"), F.to_date(at).alias("day")).where("g is not null and t is not null")
    inside = rows.withColumn("prev", F.lag("id").over(Window.partitionBy("g", "day").orderBy("t", "id")))
    last = rows.groupBy("g", "day").agg(F.max_by("id", F.struct("t", "id")).alias("last"))
    before = last.select("g", "day", F.lag("last").over(Window.partitionBy("g").orderBy("day")).alias("before"))
    return inside.join(before, ["g", "day"]).select("id", F.coalesce("prev", "before").alias("prev"))


def _name(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(path, r"\."), -1), r"[^A-Za-z0-9]", ""))


def _one_for_one(cand: DataFrame) -> DataFrame:
    """Candidates that are the best of both their fields, then the best of what is left, until nothing is."""
    by_new, by_old = Window.partitionBy("id", "x.path"), Window.partitionBy("id", "y.path")
    best = (F.col("rank") == F.min("rank").over(by_new)) & (F.col("rank") == F.min("rank").over(by_old))
    while True:
        cand = cand.withColumn("hit", best)
        gone = F.max("hit").over(by_new) | F.max("hit").over(by_old)
        cand = cut_lineage(cand.withColumn("gone", gone).where(F.col("hit") | ~F.col("gone")).drop("gone"))
        # A pair that was taken stands alone from then on; the rest are still to be decided.
        if cand.where(~F.col("hit")).isEmpty():
            return cand.drop("hit")


def changes(df: DataFrame, id_: str, group: str, at: str, document: str) -> DataFrame:
    """(id, field_path, change_kind) of each document against the one before it in its group.

    change_kind is added, removed, renamed (under the new path) or retyped. Values alone that differ,
    the order of keys, and documents that are no JSON (left out before comparing) are no change. Where
    several removed fields could have become an added one, the nearest name wins, one for one. A field
    that is null throughout is renamed only to a field of the same last name.
    """
    heads = cut_lineage(headers(df, id_, document))  # read again for order, new and old
    usable = df.select(F.col(id_).alias("id"), F.col(group).alias("g"), F.col(at).alias("t")).join(heads.select("id", "leaves"), "id")
    # Where the fold had to promote a field across JSON's own types; elsewhere none can have changed.
    drifted = heads.select(F.explode("leaves").alias("x")).where("not x.blank").groupBy("x.path").agg((F.min("x.kind") != F.max("x.kind")).alias("drifts")).where("drifts").select("path")
    order = with_previous(usable, "id", "g", "t").where("prev is not null")
    both = order.join(heads.withColumnRenamed("leaves", "new"), "id").join(heads.select(F.col("id").alias("prev"), F.col("leaves").alias("old")), "prev")
    # Most leaves are as before: only what differs goes on.
    both = both.select("id", F.array_except("new", "old").alias("n"), F.array_except("old", "new").alias("o"), "new", "old").where("size(n) + size(o) > 0")
    lost = F.filter("o", lambda y: ~F.exists("n", lambda x: x["path"] == y["path"]))
    fresh = F.filter("n", lambda x: ~F.exists("o", lambda y: y["path"] == x["path"]))
    said = lambda x, y: (x["sig"] == y["sig"]) & (x["kind"] != y["kind"]) & (x["kind"] != "") & (y["kind"] != "")
    retyped = F.transform(F.filter("n", lambda x: F.exists("o", lambda y: (y["path"] == x["path"]) & said(x, y))), lambda x: x["path"])
    both = cut_lineage(both.select("id", lost.alias("lost"), fresh.alias("fresh"), retyped.alias("retyped")))  # read for candidates, differences and types

    # Candidates for renaming: an added and a removed leaf that say the same.
    cand = both.select("id", "lost", F.explode("fresh").alias("x")).select("id", "x", F.explode(F.filter("lost", lambda y: y["sig"] == F.col("x.sig"))).alias("y"))
    a, b = F.col("x.path"), F.col("y.path")
    cand = cand.where(~F.col("x.blank") | (_name(a) == _name(b)))
    near = F.levenshtein(_name(a), _name(b)) / F.greatest(F.length(_name(a)), F.length(_name(b)), F.lit(1)) + F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) / 10
    cand = cand.select("id", "x", "y", F.struct(near.alias("far"), a.alias("a"), b.alias("b")).alias("rank"))
    pairs = _one_for_one(cand)
    types_too = F.array_compact(F.array(F.lit("renamed"), F.when(said(F.col("x"), F.col("y")), F.lit("retyped"))))
    renamed = pairs.groupBy("id").agg(F.collect_list(F.struct(a.alias("new"), b.alias("old"), types_too.alias("kinds"))).alias("renamed"))  # at most a document's fields

    done = both.join(renamed, "id", "left")
    was = F.coalesce("renamed", F.array().cast("array<struct<new:string,old:string,kinds:array<string>>>"))
    row = lambda path, kind: F.struct(path.alias("field_path"), kind.alias("change_kind"))
    added = F.transform(F.filter("fresh", lambda x: ~F.exists(was, lambda r: r["new"] == x["path"])), lambda x: row(x["path"], F.lit("added")))
    removed = F.transform(F.filter("lost", lambda y: ~F.exists(was, lambda r: r["old"] == y["path"])), lambda y: row(y["path"], F.lit("removed")))
    moved = F.flatten(F.transform(was, lambda r: F.transform(r["kinds"], lambda k: row(r["new"], k))))
    out = done.select("id", F.explode(F.concat(added, removed, moved)).alias("c")).select("id", "c.field_path", "c.change_kind")
    kept = both.select("id", F.explode("retyped").alias("path")).join(drifted, "path", "left_semi").select("id", F.col("path").alias("field_path"), F.lit("retyped").alias("change_kind"))
    return out.unionByName(kept).withColumnRenamed("id", id_)
