"""One surviving record for each group of copies, chosen field by field.

Fields are unpivoted to long rows. Each row votes for its normalised value with its source's trust
times a decay by age times the value's completeness; votes of equal values add up, the winner is taken
and winners are pivoted back. A source's trust is learned: the share of its values that another copy
confirms.

`best_fields` gives the row whose value is best by completeness, then confidence, then time, as p5_found
demands; a sum of votes cannot express that order, since many poor copies would outvote one complete
one, so there votes decide what is tied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import format_duplicates as dup
from ledgerloom.session import cut_lineage

# Words that only say that a value is missing or unknown. Marks without any letter or digit do so too.
MISSING_WORDS = (
    "null", "none", "nil", "nan", "na", "n a", "unknown", "unk", "undefined", "missing", "tbd", "tba", "tbc", "unavailable",
    "not available", "not applicable", "not known", "not provided", "not specified", "unspecified", "no data", "no value", "empty", "blank",
)
UNCATEGORIZED = ("uncategorized", "uncategorised")
#: Days in which a vote loses half of its weight.
HALF_LIFE_DAYS = 180.0


def holds(value: Column, also_missing: tuple[str, ...] = ()) -> Column:
    """Whether a string is a value: not null, blank, a mark or a word for a missing one."""
    word = F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{M}\p{N}]+", " "))
    return value.isNotNull() & (word != "") & ~word.isin(*MISSING_WORDS, *also_missing)


def attributes_held(json: Column) -> Column:
    """How many attributes of a JSON object hold a value; 0 for null, broken or other JSON. false and 0 are values."""
    parsed = F.from_json(json, "map<string,string>")
    nested_empty = lambda v: v.rlike(r"^\s*(\{\s*\}|\[\s*\])\s*$")
    return F.coalesce(F.size(F.filter(F.map_values(parsed), lambda v: holds(v) & ~nested_empty(v))), F.lit(0))


def attributes_text(json: Column) -> Column:
    """The attributes of a JSON object that hold a value, without case or layout, whatever their order."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    said = F.transform(F.filter(entries, lambda e: holds(e["value"])), lambda e: F.concat_ws("=", e["key"], F.trim(F.regexp_replace(F.lower(e["value"]), r"[\s\p{Z}]+", " "))))
    return F.array_join(F.array_sort(said), "\u0001")


def ledger_fields() -> dict[str, tuple[Column, Column]]:
    """field -> (its completeness, its normalised value's hash) of a ledger row."""
    return {
        "merchant": (attributes_held(F.col("merchant")), F.xxhash64(attributes_text(F.col("merchant")))),
        "category": (holds(F.col("category"), UNCATEGORIZED).cast("int"), F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce("category", F.lit(""))), r"[\s\p{Z}]+", " ")))),
        "raw": (attributes_held(F.col("raw")), F.xxhash64(attributes_text(F.col("raw")))),
    }


def ledger_source(ledger: DataFrame) -> Column:
    """Where a row's values come from: the family of the rule that set them, and whether a statement stands behind it. Columns that are absent count as null."""
    col = lambda c: F.col(c) if c in ledger.columns else F.lit(None).cast("string")
    family = F.coalesce(F.regexp_extract(col("rule_id"), r"^([A-Za-z]+)", 1), F.lit(""))
    return F.concat(F.when(family == "", "none").otherwise(F.lower(family)), F.when(col("statement_db_id").isNull(), "").otherwise("+statement"))


def carried(fields: dict[str, tuple[Column, Column]], confidence: str = "confidence", created: str = "created_at", source: Column | None = None) -> dict[str, Column]:
    """What choosing needs of each row: small columns only, never the values. source: only for votes."""
    out = {f"{k}__held": v[0] for k, v in fields.items()} | {f"{k}__hash": v[1] for k, v in fields.items()}
    out |= {} if source is None else {"source__": source}
    return out | {"confidence__": F.nanvl(confidence, F.lit(None).cast("double")), "created__": F.col(created)}


def _long(members: DataFrame, fields: list[str], *also: str) -> DataFrame:
    """A row for each field that holds a value of each row of a class of two rows or more."""
    rows = dup.marked(members)
    entries = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}__held").alias("held"), F.col(f"{f}__hash").alias("value")) for f in fields])
    both = dup.with_lines(rows, dup.lines(rows, {"newest": "created__"}).where("copies > 1"))
    long = both.select(F.col("representative").alias("group_id"), "id", "confidence__", "created__", "newest", *also, F.explode(entries).alias("x"))
    return long.select("*", "x.*").drop("x").where("held > 0")


def best_fields(members: DataFrame, fields: list[str], trust: Column | None = None, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """(group_id, field_name, source_id) for each class of two rows or more and each field any copy holds.

    members: id, class and the carried columns. group_id is the class's least id. Null confidence is
    lowest; equal rows in all respects go to the least id.
    """
    long = _long(members, fields).withColumn("trust", trust if trust is not None else F.lit(1.0))
    age = (F.col("newest").cast("double") - F.col("created__").cast("double")) / 86400
    vote = F.col("trust") * F.pow(F.lit(2.0), -F.coalesce(age, F.lit(0.0)) / half_life_days)
    rank = F.struct("held", "confidence__", "created__")
    # Of equal ranks the least id: the minimum id among the rows of the best rank of a value.
    by_value = long.groupBy("group_id", "field_name", "value", rank.alias("rank")).agg(F.min("id").alias("id"), F.sum(vote).alias("votes"))
    per_value = by_value.groupBy("group_id", "field_name", "value").agg(F.max("rank").alias("rank"), F.max_by("id", "rank").alias("id"), F.round(F.sum("votes"), 9).alias("votes"))
    best = per_value.groupBy("group_id", "field_name", "rank", "votes").agg(F.min("id").alias("id")).groupBy("group_id", "field_name")
    return best.agg(F.max_by("id", F.struct("rank", "votes")).alias("source_id")).select("group_id", "field_name", "source_id")


def voted_fields(members: DataFrame, fields: list[str], half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """(group_id, field_name, source_id) for each class of two rows or more and each field any copy holds, by votes.

    members: as in best_fields, and source__. A row's vote for its value is its source's trust times
    2 ** (-age in half lives, from the group's newest row) times the number of attributes it holds. A
    source's trust is (c + 1) / (n + 2), where another copy confirms c of its n values. Of equal votes, and
    among the rows of the value that wins, the more complete is better, then the higher confidence (null
    is lowest), then the later, then the least id.
    """
    long = _long(members, fields, "source__")
    age = (F.col("newest").cast("double") - F.col("created__").cast("double")) / 86400
    weight = F.pow(F.lit(2.0), -F.coalesce(age, F.lit(0.0)) / half_life_days) * F.col("held")
    rank = F.struct((-F.col("held")).alias("a"), (-F.coalesce("confidence__", F.lit(-1.0))).alias("b"), (-F.coalesce(F.unix_micros("created__"), F.lit(-(2**62)))).alias("c"), F.col("id").alias("d"))
    one = ["group_id", "field_name", "value"]
    # A row for each source of a value, so groups are small from here on however many copies they have.
    by_source = cut_lineage(long.groupBy(*one, "source__").agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), F.min(rank).alias("rank")))
    total = F.sum("n").over(Window.partitionBy(one))
    trust = by_source.withColumn("total", total).groupBy("source__").agg(((F.coalesce(F.sum(F.when(F.col("total") > 1, F.col("n"))), F.lit(0)) + 1) / (F.sum("n") + 2)).alias("trust"))
    votes = dup.spread(by_source, trust, "source__").groupBy(one).agg(F.round(F.sum(F.col("trust") * F.col("weight")), 6).alias("votes"), F.min("rank").alias("rank"))
    best = votes.groupBy("group_id", "field_name").agg(F.min_by("rank", F.struct((-F.col("votes")).alias("v"), "rank")).alias("rank"))
    return best.select("group_id", "field_name", F.col("rank.d").alias("source_id"))


def single_records(df: DataFrame, id_: str, members: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(group_id, each field) of each line without copies: its own values, null where they hold none. fields: name -> how much it holds."""
    alone = dup.lines(dup.marked(members.select("class", "id"))).where("copies = 1").select(F.col("representative").alias("group_id"))
    own = df.select(F.col(id_).alias("group_id"), *[F.when(held.cast("int") > 0, F.col(f).cast("string")).alias(f) for f, held in fields.items()])
    return own.join(alone, "group_id", "left_semi")


def survivors(df: DataFrame, id_: str, best: DataFrame, fields: list[str], members: DataFrame | None = None) -> DataFrame:
    """(group_id, each field): the surviving record of each group; null where no copy holds a value.

    members (id, class) names all groups, of two rows or more; without it those of `best` count.
    """
    values = df.select(F.col(id_).alias("source_id"), *fields)
    value = F.coalesce(*[F.when(F.col("field_name") == f, F.col(f).cast("string")) for f in fields])
    picked = best.join(values, "source_id").select("group_id", "field_name", value.alias("value"))
    out = picked.groupBy("group_id").pivot("field_name", fields).agg(F.first("value"))
    if members is None:
        return out
    groups = dup.lines(dup.marked(members.select("class", "id"))).where("copies > 1").withColumnRenamed("representative", "group_id")
    return groups.select("group_id").join(out, "group_id", "left")
