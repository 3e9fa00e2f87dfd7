"""Reconciliation of statement rows with feed rows by amount, date and merchant, and what follows from it.

A pair needs two of three signals to reach the floor, so every candidate shares either a day within the
tolerance or nearly the amount: two equi-joins replace the comparison of all pairs. Rows are compared
within an account, `account` on both sides.

Left (statement) rows: id, account, date, amount, description, merchant. Right (feed) rows: id, account,
date, amount, name, merchant_name. Amounts are compared as given, the feed's by size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ledgerloom.functions.scalars import can_be_similar, letters, similarity_from
from ledgerloom.operators.settle import settled
from ledgerloom.session import cut_lineage

DAYS, AMOUNT_SHARE, LIKENESS = 3, 0.01, 0.6
ALIKE = 0.9
FLOOR = 0.5
#: An account of more right rows with edges than this is settled by rounds instead of in one pass, which remembers them; the result is the same.
RIGHT_ROWS_A_TASK = 1_000_000
#: Bytes of an account, texts and 100 for each row, up to which a task holds it whole; pairs of a larger one are made by joins, with the same result.
BYTES_A_TASK = 150_000_000
#: Rounds of assignment in one job before it is seen whether any edge was lost.
ROUNDS_A_JOB = 4
# Points of each signal.
POINTS = {"amount": (0.4, 0.3), "date": (0.3, 0.2), "merchant": (0.3, 0.2)}


def _near(x: Column, y: Column, share: float) -> Column:
    return (x == y) | ((x != 0) & (y != 0) & (F.abs(x - y) / ((F.abs(x) + F.abs(y)) / 2) <= share))


def _side(rows: DataFrame, side: str) -> DataFrame:
    """What comparing needs of a row, under names of its side."""
    x, who, text = ("l", F.coalesce("merchant", "description"), "description") if side == "left" else ("r", F.coalesce("merchant_name", "name"), "name")
    tidy = lambda c: F.lower(F.trim(c))
    amount = F.col("amount").cast("double")
    return rows.select(F.col("id").alias(f"{side}_id"), "account", F.col("date").alias(f"{x}_date"), (amount if side == "left" else F.abs(amount)).alias(f"{x}_amount"), who.alias(f"{x}_merchant"), tidy(who).alias(f"{x}1"), tidy(F.col(text)).alias(f"{x}2"))


def _measured(side: DataFrame, x: str) -> DataFrame:
    """A side with the length and the letters of its texts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *[letters(b.column(f"{x}{n}")) for n in (1, 2)]], [*b.schema.names, *[f"{x}{n}_letters" for n in (1, 2)]])

    side = side.withColumns({f"{x}{n}_length": F.length(f"{x}{n}") for n in (1, 2)})
    return side.mapInArrow(add, StructType([*side.schema.fields, *[StructField(f"{x}{n}_letters", LongType()) for n in (1, 2)]]))


def _like(least: str | float, measured: bool = True) -> Column:
    """The greatest similarity of a pair's texts, 0 where it is under `least`."""
    return F.greatest(*[similarity_from(p, q, least, measured) for p in ("l1", "l2") for q in ("r1", "r2")])


def _can_be_like(edits: Column) -> Column:
    """False only if no two texts of a pair differ by at most `edits` of their length; lengths and letters tell it without comparing."""
    return functools.reduce(Column.__or__, [can_be_similar(p, q, edits) for p in ("l1", "l2") for q in ("r1", "r2")])


def _pairs(left: DataFrame, right: DataFrame, days: int, share: float, by_day_too: Column | None = None, by_amount_too: Column | None = None) -> DataFrame:
    """Pairs of an account and a day within `days`, and those of nearly the same amount at other days; each once.

    The two joins have no pair in common, so none has to be told apart, and their rows carry all that
    comparing needs, so pairs are scored where they meet and only those that count go on. by_day_too and
    by_amount_too: what else must hold of the pairs of either join.
    """
    # Days: blocks as long as the tolerance spans, met by one or two keys of the other side.
    block = 2 * days + 1
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    close = F.coalesce(F.abs(F.datediff("l_date", "r_date")) <= days, F.lit(False))
    al = left.withColumn("block", F.floor(number("l_date") / block))
    bl = right.withColumn("block", F.explode(F.sequence(F.floor((number("r_date") - days) / block), F.floor((number("r_date") + days) / block))))
    # Merge joins: a broadcast would leave the comparing to as few tasks as the left side's files.
    by_day = al.join(bl.hint("merge"), ["account", "block"]).where(close if by_day_too is None else close & by_day_too).drop("block")
    # Amounts: logarithmic classes, a little wider than the tolerance, so that a pair within it lies in the same or the next one.
    width = math.log((2 + share) / (2 - share)) * (1 + 1e-6) if share > 0 else 1e-9
    size = lambda c: F.when(c == 0, F.lit(-(2**40))).otherwise(F.floor(F.log(F.abs(c)) / width))
    ac = left.withColumn("size", size(F.col("l_amount")))
    bc = right.withColumn("size", F.explode(F.when(F.col("r_amount") == 0, F.array(F.lit(-(2**40)))).otherwise(F.sequence(size(F.col("r_amount")) - 1, size(F.col("r_amount")) + 1))))
    near = _near(F.col("l_amount"), F.col("r_amount"), share) & ~close
    by_amount = ac.join(bc.hint("merge"), ["account", "size"]).where(near if by_amount_too is None else near & by_amount_too).drop("size")
    return by_day.unionByName(by_amount)


def candidates(left: DataFrame, right: DataFrame, days: int = DAYS, share: float = AMOUNT_SHARE) -> DataFrame:
    """(left_id, right_id) that share an account and a day within `days`, or nearly the amount; each once."""
    return _pairs(_side(left, "left"), _side(right, "right"), days, share).select("left_id", "right_id")


def _scored(a: DataFrame, b: DataFrame, days: int, share: float, likeness: float) -> DataFrame:
    """Edges: candidates of two measured sides with confidence and match_type; those under the floor are left out.

    Where the amounts differ, two signals are left and both must be good, so names are compared only to
    the likeness that can still reach the floor, and not at all where their letters rule it out.
    """
    same_amount, near_amount = F.col("l_amount") == F.col("r_amount"), _near(F.col("l_amount"), F.col("r_amount"), share)
    same_day, near_day = F.col("l_date") == F.col("r_date"), F.abs(F.datediff("l_date", "r_date")) <= days
    # Short: the JVM compiles no method of more than 8000 bytes, and pairs run through these by the million.
    x = _pairs(a, b, days, share, near_amount | _can_be_like(F.when(same_day, 1 - likeness).otherwise(1 - ALIKE)), _can_be_like(F.lit(1 - likeness)))
    points = lambda k, full, part: F.when(full, POINTS[k][0]).when(part, POINTS[k][1]).otherwise(0.0)
    texts = [f"{t}{k}" for t in ("l1", "l2", "r1", "r2") for k in ("", "_length", "_letters")]
    least = F.when(near_amount | same_day, likeness).otherwise(ALIKE)
    x = x.select("account", "left_id", "right_id", "l_date", "r_date", *texts, points("amount", same_amount, near_amount).alias("of_amount"), points("date", same_day, near_day).alias("of_date"), least.alias("least"))
    # Made by a generator, so that no condition on it is pushed down and works it out again for each mention.
    x = x.withColumn("like", F.explode(F.array(_like("least"))))
    alike, likely, full = F.col("like") >= ALIKE, F.col("like") >= likeness, {k: F.col(f"of_{k}") == POINTS[k][0] for k in ("amount", "date")}
    confidence = F.col("of_amount") + F.col("of_date") + points("merchant", alike, likely)
    near = (F.col("of_amount") > 0) & (F.col("of_date") > 0)
    kind = F.when(full["amount"] & full["date"] & alike, "exact").when(near & likely, "fuzzy").when(near, "amount_date").otherwise("amount_only")
    return x.withColumn("confidence", confidence).where(F.col("confidence") >= FLOOR).select("account", "left_id", "right_id", "l_date", "r_date", "confidence", kind.alias("match_type"))


def _exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """The exact ones of _scored()'s edges: they share account, amount and day, so no other pair is looked at."""
    b = b.withColumnsRenamed({"account": "r_account"})
    same = (F.col("account") == F.col("r_account")) & (F.col("l_amount") == F.col("r_amount")) & (F.col("l_date") == F.col("r_date"))
    full = F.lit(POINTS["amount"][0]) + F.lit(POINTS["date"][0]) + F.lit(POINTS["merchant"][0])
    return a.join(b, same).where(_like(ALIKE, measured=False) >= ALIKE).select("account", "left_id", "right_id", "l_date", "r_date", full.alias("confidence"), F.lit("exact").alias("match_type"))


def _noted(found: DataFrame, a: DataFrame, b: DataFrame, days: int, share: float) -> DataFrame:
    """Matches with what differs between their sides. How alike their texts are is told by the points that amount and date leave of the confidence."""
    side = lambda rows, k, x: rows.select(f"{k}_id", f"{x}_date", f"{x}_amount", f"{x}_merchant")
    x = found.select("left_id", "right_id", "confidence", "match_type").join(side(a, "left", "l"), "left_id").join(side(b, "right", "r"), "right_id")
    same_amount, near_amount = F.col("l_amount") == F.col("r_amount"), _near(F.col("l_amount"), F.col("r_amount"), share)
    same_day, near_day = F.col("l_date") == F.col("r_date"), F.abs(F.datediff("l_date", "r_date")) <= days
    points = lambda k, full, part: F.when(full, POINTS[k][0]).when(part, POINTS[k][1]).otherwise(0.0)
    of_texts = F.col("confidence") - points("amount", same_amount, near_amount) - points("date", same_day, near_day)
    alike, likely = (of_texts > least - 1e-6 for least in POINTS["merchant"])
    money = lambda c: F.format_string("%.2f", F.col(c))
    note = lambda word, ok, l, r: F.concat(F.lit(word), F.when(ok, F.lit(": ")).otherwise(F.lit(" mismatch: ")), l, F.lit(" / "), r)  # noqa: E731, E741
    notes = F.array_compact(F.array(
        F.when(~same_amount, note("Amount", near_amount, money("l_amount"), money("r_amount"))),
        F.when(~same_day, note("Date", near_day, F.col("l_date").cast("string"), F.col("r_date").cast("string"))),
        F.when(~alike, note("Merchant", likely, F.col("l_merchant"), F.col("r_merchant"))),
    ))
    return x.select("left_id", "right_id", "confidence", "match_type", notes.alias("differences"))


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of edges sorted by account, left row and preference: each left row's best right row still free.

    What is remembered is the right rows taken in one account.
    """
    account, last, used = None, None, set()
    for b in batches:
        chosen = []
        for i, (of, left, right) in enumerate(zip(*[b.column(c).to_pylist() for c in ("account", "left_id", "right_id")])):
            if of != account:
                account, last, used = of, None, set()
            if left != last and right not in used:
                used.add(right)
                chosen.append(i)
                last = left
        yield b.take(pa.array(chosen, pa.int64()))


def assign(edges: DataFrame, most: int = RIGHT_ROWS_A_TASK) -> DataFrame:
    """One right row at most for each left row: left rows choose in order of date and id, each the best still free.

    edges also has account. No edge leads from one account to another, so an account of at most `most`
    right rows is settled in one pass over its sorted edges; larger ones take rounds that remember
    nothing, with the same result. Rows without date come last.
    """
    edges = cut_lineage(edges)
    large = edges.select("account", "right_id").distinct().groupBy("account").count().where(F.col("count") > most).select("account")
    large = cut_lineage(large)
    none = large.isEmpty()
    few = edges if none else edges.join(large, "account", "left_anti")
    order = ["account", *_first_left(), *_best_right()]
    out = few.repartition("account").sortWithinPartitions(*order).mapInArrow(lambda x: _greedy(x), edges.schema)
    if none:
        return out
    return out.unionByName(_by_rounds(edges.join(large, "account", "left_semi")))


def _first_left() -> list[Column]:
    return [F.asc_nulls_last("l_date"), F.asc("left_id")]


def _best_right() -> list[Column]:
    return [F.desc("confidence"), F.asc_nulls_last("r_date"), F.asc("right_id")]


def _by_rounds(edges: DataFrame) -> DataFrame:
    """assign() of accounts of any size.

    Since all right rows prefer left rows in the same order, this is deferred acceptance: each left row
    asks for its best remaining edge, each right row keeps the first of those that ask, the others lose
    that edge and ask again, until no edge is lost. Every step is a pair of windows over single rows'
    edges; nothing is gathered by account.
    """
    cols = edges.columns
    asks = Window.partitionBy("left_id").orderBy(*_best_right())
    keeps = Window.partitionBy("right_id", F.col("n") == 1).orderBy(*_first_left())
    lost = (F.col("n") == 1) & (F.col("m") > 1)
    while True:
        for _ in range(ROUNDS_A_JOB):
            edges = edges.select(cols).withColumn("n", F.row_number().over(asks)).withColumn("m", F.row_number().over(keeps)).where(~lost)
        edges = edges.select(cols).withColumn("n", F.row_number().over(asks)).withColumn("m", F.row_number().over(keeps))
        edges = cut_lineage(edges)
        if edges.where(lost).isEmpty():
            return edges.where("n = 1").select(cols)
        edges = edges.where(~lost)


def _settled(a: DataFrame, b: DataFrame, days: int, share: float, likeness: float, most: int = BYTES_A_TASK, taken: DataFrame | None = None) -> DataFrame:
    """assign() of _scored()'s edges, of which only those are made that can be taken when their left row chooses.

    An account of up to `most` bytes is held by one task; the rows of larger ones are joined and assigned.
    taken: matches whose rows are left out. The tasks do that, so rows meet them by account, not once more by id.
    """
    one = lambda side, rows, x, k: rows.where("account is not null").select("account", F.lit(k).alias("side"), F.datediff(f"{x}_date", F.lit("1970-01-01").cast("date")).alias("day"), F.col(f"{side}_id").alias("id"), F.col(f"{x}_amount").alias("amount"), F.col(f"{x}1").alias("text1"), F.col(f"{x}2").alias("text2"))
    rows = one("left", a, "l", 0).unionByName(one("right", b, "r", 1))
    if taken is not None:
        for k, side in ((2, "left"), (3, "right")):
            rows = rows.unionByName(taken.select("account", F.lit(k).alias("side"), F.col(f"{side}_id").alias("id")), allowMissingColumns=True)
    size = lambda side, x: side.select("account", (F.lit(100) + F.coalesce(F.length(f"{x}1"), F.lit(0)) + F.coalesce(F.length(f"{x}2"), F.lit(0))).alias("size")).groupBy("account").agg(F.sum("size").alias("size"))
    large = cut_lineage(size(a, "l").unionByName(size(b, "r")).groupBy("account").agg(F.sum("size").alias("size")).where(F.col("size") > most).select("account"))
    none = large.isEmpty()
    few = rows if none else rows.join(large, "account", "left_anti")
    rules = {"days": days, "share": share, "likeness": likeness, "alike": ALIKE, "floor": FLOOR, "points": POINTS}
    fields = {f.name: f for side in (a, b) for f in side.schema.fields}
    schema = StructType([*[fields[c] for c in ("account", "left_id", "right_id", "l_date", "r_date")], StructField("confidence", DoubleType()), StructField("match_type", StringType())])
    names = schema.names
    out = few.repartition("account").sortWithinPartitions("account", F.asc_nulls_last("day"), "id").mapInArrow(lambda x: settled(x, names, **rules), schema)
    if none:
        return out
    if taken is not None:
        a, b = (rows.join(taken.select(c), c, "left_anti") for rows, c in ((a, "left_id"), (b, "right_id")))
    a, b = (_measured(rows.join(large, "account", "left_semi"), x) for rows, x in ((a, "l"), (b, "r")))
    return out.unionByName(assign(_scored(a, b, days, share, likeness)))


def matches(left: DataFrame, right: DataFrame, days: int = DAYS, share: float = AMOUNT_SHARE, likeness: float = LIKENESS, noted: bool = True) -> DataFrame:
    """(left_id, right_id, confidence, match_type, differences): exact matches first, then the best of the rest.

    Rows matched exactly are left out before the rest is compared. Both sides are read several times, so
    what is costly to make should be cut before. Without `noted` there are no differences, for which all
    matches meet the texts of both sides again.
    """
    a, b = _side(left, "left"), _side(right, "right")
    exact = cut_lineage(assign(_exact(a, b)))
    rest = _settled(a, b, days, share, likeness, taken=exact)
    found = exact.unionByName(rest)
    return _noted(found, a, b, days, share) if noted else found.select("left_id", "right_id", "confidence", "match_type")


def summary(left: DataFrame, right: DataFrame, found: DataFrame) -> DataFrame:
    """One row: counts, rate and amounts of both sides and of each match type."""
    m = found.agg(F.count("*").alias("matched"), *[F.count_if(F.col("match_type") == k).alias(k) for k in ("exact", "fuzzy", "amount_date", "amount_only")])
    a = left.agg(F.count("*").alias("total_left"), F.coalesce(F.sum(F.col("amount").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("amount_left"))
    b = right.agg(F.count("*").alias("total_right"), F.coalesce(F.sum(F.abs("amount").cast("decimal(18,2)")), F.lit(0)).cast("double").alias("amount_right"))
    one = F.lit(1).alias("one")
    out = m.select(one, "*").join(a.select(one, "*"), "one").join(b.select(one, "*"), "one").drop("one")
    rate = F.when(F.col("total_left") > 0, F.col("matched") / F.col("total_left")).otherwise(0.0)
    return out.withColumn("match_rate", rate).withColumn("amount_difference", F.round(F.col("amount_left") - F.col("amount_right"), 2))


def unmatched(rows: DataFrame, found: DataFrame, side: str) -> DataFrame:
    """Rows of `side` (left or right) without a match."""
    return rows.join(found.select(F.col(f"{side}_id").alias("id")), "id", "left_anti")


def merged(left: DataFrame, right: DataFrame, found: DataFrame, mapping: Column, feed_confidence: float = 0.7) -> DataFrame:
    """Both sides as one table: matched left rows enriched, unmatched feed rows added. Every left row is kept.

    left also has category and confidence. mapping: struct of category and subcategory of a feed row. A
    feed category replaces a left row's only if its confidence is strictly higher. Added rows keep the
    feed's sign, debits positive, and take 0.9 as confidence; where right has kind and mask they get the
    key of a statement of their month, and a label.
    """
    kind, mask = [F.col(c) if c in right.columns else F.lit(None).cast("string") for c in ("kind", "mask")]
    r = right.select(F.col("id").alias("right_id"), F.col("merchant_name").alias("feed_merchant"), F.col("authorized_date").alias("feed_posted"), mapping.alias("feed"))
    x = left.join(found.select(F.col("left_id").alias("id"), "right_id"), "id", "left").join(r, "right_id", "left")
    better = F.col("right_id").isNotNull() & (F.lit(feed_confidence) > F.coalesce("confidence", F.lit(0.0)))
    updated = x.select(
        "id", "account", "date", F.col("amount").cast("double").alias("amount"), "description", F.when(better, F.coalesce("feed.category", F.lit("Uncategorized"))).otherwise(F.col("category")).alias("category"),
        F.when(better, F.lit(feed_confidence)).otherwise(F.col("confidence")).alias("confidence"), "feed_merchant", F.coalesce("feed_posted", "posted_date").alias("posted_date"), F.when(F.col("right_id").isNull(), "ledger").otherwise("both").alias("origin"),
        F.lit(None).cast("string").alias("statement_key"), F.lit(None).cast("string").alias("period_label"),
    )
    new = unmatched(right, found, "right")
    added = new.select(
        F.concat(F.lit("plaid_"), "id").alias("id"), "account", "date", F.col("amount").cast("double").alias("amount"), F.col("name").alias("description"), F.coalesce(mapping["category"], F.lit("Uncategorized")).alias("category"),
        F.lit(0.9).alias("confidence"), F.coalesce("merchant_name", "name").alias("feed_merchant"), F.coalesce("authorized_date", "date").alias("posted_date"), F.lit("feed").alias("origin"),
        F.when(kind.isNotNull(), F.concat_ws("-", F.lit("PLAID"), kind, F.coalesce(mask, F.lit("0000")), F.date_format("date", "yyyy-MM"))).alias("statement_key"), F.when(kind.isNotNull(), F.concat(F.lit("Plaid "), kind, F.lit(" "), F.coalesce(mask, F.lit("")))).alias("period_label"),
    )
    return updated.unionByName(added)


def created_accounts(right: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """(account, kind, mask, start, end, transactions): the accounts that unmatched feed rows need and `known` (account) lacks."""
    new = unmatched(right, found, "right").join(known.select("account"), "account", "left_anti")
    return new.groupBy("account").agg(F.min("kind").alias("kind"), F.min(F.coalesce("mask", F.lit("0000"))).alias("mask"), F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("transactions"))


def merge_stats(left: DataFrame, right: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """One row: rows of both sides, how many were updated and added, accounts created, left rows unmatched, and the rate."""
    s = summary(left, right, found).select("matched", "total_left", "total_right", "match_rate", F.lit(1).alias("one"))
    n = created_accounts(right, found, known).agg(F.count("*").alias("accounts_created")).withColumn("one", F.lit(1))
    return s.join(n, "one").select("total_left", "total_right", F.col("matched").alias("updated"), (F.col("total_right") - F.col("matched")).alias("added"), "accounts_created", (F.col("total_left") - F.col("matched")).alias("unmatched_left"), F.round("match_rate", 6).alias("match_rate"))


# Strategies of enrichment.
STRATEGIES = ("pdf-primary", "plaid-primary", "union")


def enriched(left: DataFrame, right: DataFrame, found: DataFrame, replace_merchant: bool = False) -> DataFrame:
    """Left rows with what the matched feed row says; with replace_merchant its name also takes the merchant's place."""
    r = right.select(F.col("id").alias("right_id"), F.coalesce("merchant_name", "name").alias("feed_merchant"))
    x = left.select("id", "account", "date", "amount", "merchant").join(found.withColumnRenamed("left_id", "id").join(r, "right_id", "left"), "id", "left")
    merchant = F.coalesce("feed_merchant", "merchant") if replace_merchant else F.col("merchant")
    return x.select("id", "account", "date", "amount", merchant.alias("merchant"), F.col("right_id").alias("feed_id"), "match_type", "confidence", "differences")


def by_strategy(left: DataFrame, right: DataFrame, found: DataFrame, strategy: str) -> DataFrame:
    """enriched() by one of STRATEGIES: the ledger's own values first, the feed's merchant first, or also the feed's unmatched rows."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    out = enriched(left, right, found, strategy == "plaid-primary")
    if strategy != "union":
        return out
    new = unmatched(right, found, "right").select(F.concat(F.lit("plaid_"), "id").alias("id"), "account", "date", "amount", F.coalesce("merchant_name", "name").alias("merchant"), F.col("id").alias("feed_id"))
    return out.unionByName(new, allowMissingColumns=True)


def match_payloads(right: DataFrame, found: DataFrame) -> DataFrame:
    """(left_id, payload): of each match a struct of the feed id, confidence, type, differences, merchant, place and category; absent parts are null."""
    place = F.when(F.coalesce("city", "region").isNotNull(), F.struct("city", F.col("region").alias("state")))
    category = F.when(F.col("pfc_primary").isNotNull(), F.struct(F.col("pfc_primary").alias("primary"), F.col("pfc_detailed").alias("detailed")))
    r = right.select(F.col("id").alias("right_id"), "merchant_name", place.alias("location"), category.alias("category"))
    p = F.struct(F.col("right_id").alias("transactionId"), F.col("confidence").alias("matchConfidence"), F.col("match_type").alias("matchType"), "differences", F.col("merchant_name").alias("merchantName"), "location", "category")
    return found.join(r, "right_id").select("left_id", p.alias("payload"))


def warnings(of: DataFrame, added: int | Column | None = None) -> DataFrame:
    """(place, warning) of a row of summary(): rows added, a match rate under a half, amounts that differ by more than a tenth."""
    some = F.col("total_left") > 0
    off = F.try_divide(F.abs("amount_difference"), F.col("amount_left"))
    texts = F.array(
        F.when(F.lit(added is not None), F.format_string("Added %d unmatched feed rows", added if isinstance(added, Column) else F.lit(added or 0))),
        F.when(some & (F.col("match_rate") < 0.5), F.format_string("Low match rate: %.1f%%", F.col("match_rate") * 100)),
        F.when(some & (off > 0.1), F.format_string("Significant amount difference: %.2f (%.1f%%)", F.abs("amount_difference"), off * 100)),
    )
    return of.select(F.posexplode(texts).alias("place", "warning")).where("warning is not null")


def _feed_keys(feed_accounts: DataFrame) -> DataFrame:
    """(feed_account, kind, mask, feed_bank) of the feed accounts with a mask."""
    return feed_accounts.where("mask is not null").select(F.col("account_id").alias("feed_account"), feed_kind().alias("kind"), "mask", _bank("institution_name").alias("feed_bank"))


def feed_kind() -> Column:
    return F.when(F.col("type") == "credit", "credit").when(F.lower("subtype") == "savings", "savings").otherwise("checking")


def accounts_without_mask(accounts: DataFrame, feed_accounts: DataFrame) -> DataFrame:
    """(feed_account, account): a feed account without mask fits any; the ledger's is taken if its institution has just one of the kind."""
    only = accounts.groupBy(_bank("institution").alias("bank"), F.lower("account_type").alias("kind")).agg(F.count("*").alias("n"), F.min("id").alias("account")).where("n = 1 and bank != ''")
    bare = feed_accounts.where("coalesce(mask, '') = ''").select(F.col("account_id").alias("feed_account"), feed_kind().alias("kind"), _bank("institution_name").alias("bank"))
    return bare.join(only, ["bank", "kind"]).select("feed_account", "account")


def _bank(c: str) -> Column:
    """The beginning of an institution's name, which its spellings have in common."""
    return F.substring(F.regexp_replace(F.lower(F.col(c)), "[^a-z]", ""), 1, 5)


def accounts_of_mask(accounts: DataFrame, feed_accounts: DataFrame) -> DataFrame:
    """(feed_account, account, same_bank): every ledger account of equal kind and mask."""
    a = accounts.select(F.col("id").alias("account"), F.lower("account_type").alias("kind"), F.regexp_replace("account_number_masked", r"\*", "").alias("mask"), _bank("institution").alias("bank"))
    same = F.coalesce((F.col("bank") == F.col("feed_bank")) & (F.col("bank") != ""), F.lit(False))
    return _feed_keys(feed_accounts).join(a, ["kind", "mask"]).select("feed_account", "account", same.alias("same_bank"))


def accounts_by_mask(accounts: DataFrame, feed_accounts: DataFrame) -> DataFrame:
    """(feed_account, account): equal kind and mask; of several ledger accounts the least id."""
    return accounts_of_mask(accounts, feed_accounts).groupBy("feed_account").agg(F.min("account").alias("account"))


def linked_accounts(accounts: DataFrame, feed_accounts: DataFrame, ledger: DataFrame, feed: DataFrame, days: int = DAYS) -> DataFrame:
    """(feed_account, account): of all ledger accounts of equal kind and mask the feed account's own.

    One of the same institution comes first, then the one with which more of the feed account's payments
    agree in amount, direction and days, then the least id. ledger: account, date, amount, direction.
    feed: feed_account, date, amount, debits positive. Payments are looked at only where there is a choice,
    and equal ones of a day once, so a key holds no more rows than days.
    """
    pairs = accounts_of_mask(accounts, feed_accounts)
    several = pairs.withColumn("n", F.count("*").over(Window.partitionBy("feed_account", "same_bank"))).where("n > 1").select("feed_account", "account")
    block, cents = 2 * days + 1, F.abs(F.col("amount") * 100).cast("bigint").alias("cents")
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    a = ledger.join(several.select("account").distinct(), "account", "left_semi").select("account", cents, F.lower(F.trim("direction")).startswith("c").alias("credit"), day.alias("day")).distinct()
    b = feed.select("feed_account", cents, (F.col("amount") < 0).alias("credit"), day.alias("feed_day")).distinct().join(several, "feed_account")
    a = a.withColumn("block", F.floor(F.col("day") / block))
    b = b.withColumn("block", F.explode(F.sequence(F.floor((F.col("feed_day") - days) / block), F.floor((F.col("feed_day") + days) / block))))
    near = a.join(b, ["account", "cents", "credit", "block"]).where(F.abs(F.col("day") - F.col("feed_day")) <= days)
    agree = near.groupBy("feed_account", "account").agg(F.count_distinct("cents", "credit", "feed_day").alias("agree"))
    ranked = pairs.join(agree, ["feed_account", "account"], "left").withColumn("agree", F.coalesce("agree", F.lit(0)))
    first = Window.partitionBy("feed_account").orderBy(F.desc("same_bank"), F.desc("agree"), "account")
    return ranked.withColumn("n", F.row_number().over(first)).where("n = 1").select("feed_account", "account")
