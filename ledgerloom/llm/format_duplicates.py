"""Duplicates hidden by formatting: whitespace, letter case, punctuation, order of set-apart fields.

Two rows are copies if they agree in the cell columns and either their texts are the same letters and
digits in the same order, or their texts have the same fields in any order. Both relations are equality
of a key, so classes come from keys alone: rows are never compared with one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import roots
from ledgerloom.session import cut_lineage

# The labels that open a field of a bank line.
FIELD_LABELS = ("CO ID", "DES", "INDN", "ID")
BLANK = r"[\s\p{Z}]"
NOT_TEXT = r"[^\p{L}\p{M}\p{N}]+"
#: A class is hot if it has more copies than this and more than a MOST_HOT-th of all rows, so there are at most MOST_HOT hot classes.
HOT_COPIES, MOST_HOT = 5_000, 10_000
SALTS = 32
#: Copies of a small table that a large one with perhaps hot keys is joined to.
SPREAD = 8


def text_key(text: Column) -> Column:
    """Letters, marks and digits of a text in their order, without case."""
    return F.regexp_replace(F.lower(F.upper(text)), NOT_TEXT, "")


def field_key(text: Column) -> Column:
    """The text keys of the fields, sorted. Fields are set apart by ; or | or open with a label and a colon."""
    labels = "|".join(r"[^\p{L}\p{N};|]*".join(x.split()) for x in FIELD_LABELS)
    cut = F.regexp_replace(text, rf"(?i)(?:{labels}){BLANK}*:", "\u0001$0")
    parts = F.transform(F.split(cut, "[;|\u0001]"), text_key)
    return F.array_join(F.array_sort(F.filter(parts, lambda x: x != "")), "\u0001")


def ledger_cell() -> list[Column]:
    """What copies of a ledger line have in common beside the description."""
    return [F.col("account_id"), F.col("date"), F.abs("amount"), F.lower(F.regexp_replace("direction", rf"^{BLANK}+|{BLANK}+$", ""))]


def classed(df: DataFrame, id_: str, cell: list[Column], text: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, class, carried columns): rows of equal class are copies, also by way of other copies.

    Nulls in the cell or the text equal each other and nothing else; an empty text equals texts without
    any letter or digit. Columns of df beyond those named play no part, whatever they are called. The
    result is cut off from its lineage.
    """
    whole = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in cell]
    key = lambda k: F.unhex(F.md5(F.concat_ws("\u0002", *whole, F.coalesce(k, F.lit("\u0000")))))
    rows = df.select(
        F.col(id_).alias("id"),
        key(text_key(F.col(text))).alias("in_order"),
        key(field_key(F.col(text))).alias("by_field"),
        *[c.alias(k) for k, c in (carry or {}).items()],
    )
    rows = cut_lineage(rows)  # the texts are read once; their keys three times
    # Rows whose letters agree but whose fields are cut differently tie two field keys together.
    tied = rows.groupBy("in_order").agg(F.min("by_field").alias("least"), F.max("by_field").alias("most")).where("least < most").select("in_order", "least")
    links = spread(rows.select("id", "in_order", "by_field"), tied, "in_order").where("by_field != least").select("by_field", "least").distinct()
    moved = roots(links, "by_field", "least")
    out = spread(rows, moved.select(F.col("node").alias("by_field"), "root"), "by_field", "left")
    return cut_lineage(out.select("id", F.coalesce("root", "by_field").alias("class"), *(carry or {})))


def salt(id_: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(salts))


def spread(large: DataFrame, small: DataFrame, key: str, how: str = "inner", id_: str | None = None, salts: int = SPREAD) -> DataFrame:
    """Join a large table, some of whose keys may hold a third of it, to a small one with a row for each
    key: the large side is salted, the small one repeated for each salt, so no task holds a key."""
    salted = large.withColumn("salt", salt(id_ or large.columns[0 if large.columns[0] != key else 1], salts))
    repeated = small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(repeated, [key, "salt"], how).drop("salt")


def hot_classes(members: DataFrame, hot: int = HOT_COPIES) -> DataFrame:
    """(class, copies) of the hot classes, counted exactly by partial counts; at most MOST_HOT of them."""
    least = max(hot, members.count() // MOST_HOT)
    return members.groupBy("class").agg(F.count("*").alias("copies")).where(F.col("copies") > least)


def marked(members: DataFrame, hot: int = HOT_COPIES) -> DataFrame:
    """members with whether each row's class is hot; the hot classes are few enough to broadcast at any size."""
    heavy = hot_classes(members, hot).select("class", F.lit(True).alias("hot"))
    return members.join(F.broadcast(heavy), "class", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def lines(rows: DataFrame, also: dict[str, str] | None = None) -> DataFrame:
    """(class, hot, representative, copies) of each class of marked rows: its least id and number of rows.

    Hot classes are aggregated in two levels, first by class and salt; the rest goes through one shuffle.
    also: names of further columns, each with the column whose maximum it is.
    """
    also = also or {}
    first = [F.min("id").alias("representative"), F.count("*").alias("copies"), *[F.max(c).alias(k) for k, c in also.items()]]
    second = [F.min("representative").alias("representative"), F.sum("copies").alias("copies"), *[F.max(k).alias(k) for k in also]]
    rest = rows.where("not hot").groupBy("class").agg(*first)
    salted = rows.where("hot").groupBy("class", salt("id").alias("salt")).agg(*first).groupBy("class").agg(*second)
    out = ["class", "hot", "representative", "copies", *also]
    return rest.withColumn("hot", F.lit(False)).select(out).unionByName(salted.withColumn("hot", F.lit(True)).select(out))


def collapse(members: DataFrame, hot: int = HOT_COPIES) -> DataFrame:
    """(id, copies) of each class: its least id and its number of rows."""
    return lines(marked(members, hot)).select(F.col("representative").alias("id"), "copies")


def with_lines(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Each marked row with its line; rows of hot classes meet it by class and salt, so no task holds a class."""
    cold = rows.where("not hot").join(of.where("not hot").drop("hot"), "class")
    return cold.unionByName(spread(rows.where("hot"), of.where("hot").drop("hot"), "class", id_="id", salts=SALTS), allowMissingColumns=False)


def copies(members: DataFrame, hot: int = HOT_COPIES, least: int = 1) -> DataFrame:
    """(id, representative, copies, hot) of every row of a class with `least` rows or more."""
    rows = marked(members.select("class", "id"), hot)
    return with_lines(rows, lines(rows).where(F.col("copies") >= least)).select("id", "representative", "copies", "hot")


def copy_pairs(members: DataFrame, hot: int = HOT_COPIES) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows with the same representative.

    Only rows of classes with two rows or more are joined. Within a hot class one side is salted and
    the other repeated for each salt, so no task holds the class.
    """
    rows = cut_lineage(copies(members, hot, 2))
    a = lambda r: r.select("representative", F.col("id").alias("id_a"))
    b = lambda r: r.select("representative", F.col("id").alias("id_b"))
    few, many = rows.where("not hot"), rows.where("hot")
    cold = a(few).join(b(few), "representative")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")
    crowded = a(many).withColumn("salt", salt("id_a")).join(b(many).select("*", every), ["representative", "salt"]).drop("salt")
    return cold.unionByName(crowded).where("id_a < id_b").select("id_a", "id_b")
