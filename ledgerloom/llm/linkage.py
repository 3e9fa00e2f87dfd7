"""Matching payments of a ledger and of a bank feed that share no identifier.

Accounts are linked first, by institution, kind, mask and payments they have in common. Within linked
accounts candidates share the exact amount, or a word of the name and nearly the amount, within days.
Matching functions vote on each candidate, a label model learned from these votes alone gives each a
confidence, and the best candidates are taken one for one.

Lines that look the same to every matching function (account, direction, amount, day, letters) are one
kind with a count, and so are payments; candidates, votes and assignment are between kinds, so equal
fares of one account never meet pair by pair.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.format_duplicates import classed, hot_classes, ledger_cell, spread, with_lines
from ledgerloom.llm.label_model import LabelModel, fit
from ledgerloom.session import cut_lineage


@dataclass(frozen=True)
class Rules:
    """What counts as the same payment, and as the same account.

    days_behind, days_ahead: by which the ledger may be behind or ahead of the feed. least_ratio,
    most_ratio: of the ledger's to the feed's amount, where a word of the name agrees. confidence: of a
    match, at least. least_share: of a feed account's distinct payments that must agree with its ledger
    account; least_agreeing: their number where the mask doesn't agree.
    """

    days_behind: int = 6
    days_ahead: int = 1
    least_ratio: float = 0.95
    most_ratio: float = 1.27
    confidence: float = 0.5
    least_share: float = 1 / 7
    least_agreeing: int = 3

    @property
    def block(self) -> int:
        """Days of a block: each payment's window meets two at most."""
        return self.days_behind + self.days_ahead + 1


#: Rounds of taking mutually best pairs in one job.
ROUNDS_A_JOB = 2
#: A word is the bank's own, and names no party, if this share of lines has it and party names have it so many times less often.
BANK_SHARE, BANK_RATIO = 0.005, 5.0
#: A word is a trade, and tells parties apart badly, if this share of the feed's party names ends with it, after so many different names.
TRADE_SHARE, TRADE_NAMES = 0.01, 5
#: Hash buckets in which the members of a kind are numbered before these numbers are joined up.
SALTS = 32
# Kinds of payment by words of either side's text.
KINDS = {
    "atm": r"\batm\b",
    "check": r"\bchecks?\b(?!card)",
    "transfer": r"online\s*banking|\btransfer\b",
    "person": r"\bpayment\s+(?:to|from)\b",
    "fee": r"\bfee\b|interest|\bcharged\b",
    "pay": r"payroll|salary|dir dep|\bppd\b",
}
NAMELESS = ("atm", "check", "transfer", "fee")
VOTES = ["amount", "gap", "authorized", "words", "start", "kind", "place"]
SIZES = [5, 7, 4, 4, 3, 3, 3]
ABSTAIN = [-1, -1, 0, 0, 0, 0, 0]


def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\band\b", " ")), r"[^\p{L}]+", "")


def _skeleton(letters: Column) -> Column:
    """Letters without vowels: abbreviations drop these first."""
    return F.regexp_replace(letters, "[aeiou]", "")


def _words(c: Column, common: list[str] | None = None) -> Column:
    """The words of three letters or more, without those in `common` unless no other is left."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}']+", " "), " ")
    words = F.transform(words, lambda w: F.regexp_replace(w, "'s?", ""))
    words = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin("and", "the", "llc", "inc")))
    if not common:
        return words
    telling = F.filter(words, lambda w: ~w.isin(*common))
    return F.when(F.size(telling) > 0, telling).otherwise(words)


def common_words(ledger: DataFrame, payments: DataFrame) -> list[str]:
    """Words that tell no party from another, learned from how often all lines and names have them.

    The bank's own words (and the places it prints) are frequent in lines and rare in the feed's party
    names; trades end many different names. At most 1 / share words of a kind can be so frequent for each
    word that a line has, so the list is short at any size. Without party names nothing is known and
    no word is left out.
    """
    names = payments.where("merchant_name is not null").groupBy(F.lower("merchant_name").alias("name")).count()
    words = _words(F.col("name"))
    ends = names.select("count", words.alias("words")).where("size(words) > 0")
    total = ends.agg(F.sum("count").alias("n")).first()["n"] or 0
    lines = ledger.where("description is not null")
    n_lines = lines.count() if total else 0
    if not n_lines:
        return []
    last = (F.col("i") == F.size("words") - 1) & (F.col("i") > 0)
    named = ends.select("count", "words", F.posexplode("words").alias("i", "word")).groupBy("word").agg(F.sum("count").alias("named"), F.sum(F.when(last, F.col("count"))).alias("ended"), F.count_if(last).alias("names"))
    trades = named.where((F.col("ended") >= TRADE_SHARE * total) & (F.col("names") >= TRADE_NAMES)).select("word")
    often = lines.select(F.explode(_words(F.col("description"))).alias("word")).groupBy("word").count().where(F.col("count") >= BANK_SHARE * n_lines)
    own = often.join(named, "word", "left").where(F.col("count") / n_lines >= BANK_RATIO * F.coalesce("named", F.lit(0)) / total).select("word")
    return sorted(r["word"] for r in own.union(trades).distinct().collect())  # bounded by the shares


def _kind(text: Column) -> Column:
    out = F.lit("other")
    for k, pattern in reversed(KINDS.items()):
        out = F.when(F.lower(text).rlike(pattern), k).otherwise(out)
    return out


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def _bank(c: str) -> Column:
    """The beginning of an institution's name, which its spellings have in common."""
    return F.substring(F.regexp_replace(F.lower(F.col(c)), "[^a-z]", ""), 1, 5)


def ledger_rows(ledger: DataFrame) -> DataFrame:
    """(id, class, account_id, date, cents, credit) of every row; rows of a class are copies of one line.

    Rows that lack account, date or amount match nothing and are left out.
    """
    carry = {"account_id": F.col("account_id"), "date": F.col("date"), "cents": F.abs(F.col("amount") * 100).cast("bigint"), "credit": F.lower(F.trim("direction")).startswith("c")}
    return classed(ledger, "id", ledger_cell(), "description", carry).where("account_id is not null and date is not null and cents is not null")


def of_linked(ledger: DataFrame, linked: DataFrame) -> DataFrame:
    """The ledger's rows of linked accounts, with the columns that matching needs."""
    return spread(ledger.select("id", "account_id", "date", "amount", "direction", "description"), linked.select("account_id").distinct(), "account_id", "left_semi")


def own_lines(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """(class, account_id, date, cents, credit, description) of each line, as its least id has it."""
    least = rows.groupBy("class").agg(F.min("id").alias("id"))
    return rows.join(least, ["class", "id"]).join(ledger.select("id", "description"), "id").drop("id")


def feed_payments(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(payments, members): a row for each payment, and the feed ids of all its rows.

    A row delivered again counts once, as it came last. A pending row belongs to the posted row that
    names it; without one it is a payment of its own.
    """
    cols = ["transaction_id", "account_id", "amount", "date", "authorized_date", "name", "merchant_name", "pending_transaction_id", "city", "pfc_primary"]
    feed = feed if "pfc_primary" in feed.columns else feed.withColumn("pfc_primary", F.lit(None).cast("string"))
    last = feed.where("transaction_id is not null").groupBy("transaction_id").agg(F.max_by(F.struct(*cols[1:]), "feed_seq").alias("x")).select("transaction_id", "x.*")
    last = cut_lineage(last)
    names = last.where("pending_transaction_id is not null").groupBy(F.col("pending_transaction_id").alias("pending_id")).agg(F.min("transaction_id").alias("posted"))
    rows = cut_lineage(last.join(names, last["transaction_id"] == names["pending_id"], "left").withColumn("payment", F.coalesce("posted", "transaction_id")))
    payments = rows.where("posted is null and account_id is not null and date is not null and amount is not null")
    payments = payments.withColumn("cents", F.abs(F.col("amount") * 100).cast("bigint")).withColumn("credit", F.col("amount") < 0)
    return payments.drop("posted", "pending_id", "transaction_id", "pending_transaction_id", "amount"), rows.select("payment", "transaction_id")


def _day_blocks(day: Column, rules: Rules) -> Column:
    return F.explode(F.sequence(F.floor((day - rules.days_ahead) / rules.block), F.floor((day + rules.days_behind) / rules.block)))


def _starts(words: Column, kind: Column) -> Column:
    """The beginnings of words; kinds that name no party are words of their own, so that such lines can meet too."""
    starts = F.array_distinct(F.transform(words, lambda x: F.substring(x, 1, 4)))
    return F.when(kind.isin(*NAMELESS), F.array_append(starts, F.concat(F.lit("="), kind))).otherwise(starts)


def link_accounts(accounts: DataFrame, feed_accounts: DataFrame, ledger: DataFrame, payments: DataFrame, common: list[str] | None = None, rules: Rules = Rules()) -> DataFrame:
    """(feed_account, account_id): the ledger account of each feed account that has one.

    Accounts of the same institution and kind are compared by how many distinct payments (amount,
    direction, day) agree in amount and days; all payments count, whatever their amount. Accounts of an
    equal mask come first. Masks may be missing, wrong or shared; feed accounts that found nothing are
    compared with the ledger accounts left, by amount and the beginning of a word or the kind of payment.
    Accounts without institution or kind are linked to nothing.

    Payments that many ledger accounts have say little and would join many with many. A pair that agrees
    in t of n payments agrees in k of any n - t + k of them, so candidates are sought by the rarest
    payments alone, and the others are counted for these candidates only: no link is lost.
    """
    ours = accounts.select(F.col("id").alias("account_id"), _bank("institution").alias("bank"), F.lower("account_type").alias("kind"), F.regexp_extract("account_number_masked", r"(\d{4})\s*$", 1).alias("mask"))
    sub = F.when(F.col("type") == "credit", F.array(F.lit("credit"))).when(F.lower("subtype").isin("checking", "savings"), F.array(F.lower("subtype"))).otherwise(F.array(F.lit("checking"), F.lit("savings")))
    theirs = feed_accounts.select(F.col("account_id").alias("feed_account"), _bank("institution_name").alias("bank"), F.explode(sub).alias("kind"), "mask")
    cents, credit = F.abs(F.col("amount") * 100).cast("bigint").alias("cents"), F.lower(F.trim("direction")).startswith("c").alias("credit")
    lines = ledger.where("account_id is not null and date is not null and amount is not null").select("account_id", cents, credit, _day("date").alias("day"), F.floor(_day("date") / rules.block).alias("block"), "description")
    paid = payments.select(F.col("account_id").alias("feed_account"), "cents", "credit", _day("date").alias("feed_day"), "merchant_name", "name")
    one = ["feed_account", "cents", "credit", "feed_day"]
    distinct = cut_lineage(paid.select(one).distinct())
    counts = distinct.groupBy("feed_account").agg(F.count("*").alias("n"))
    near = F.col("day").between(F.col("feed_day") - rules.days_ahead, F.col("feed_day") + rules.days_behind)
    key = ["bank", "kind", "cents", "credit", "block"]
    blocks = _day_blocks(F.col("feed_day"), rules).alias("block")

    def agreeing(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
        """How many of the feed account's payments each ledger account has, of those joined by the keys."""
        return left.join(right, by).where(near).groupBy("feed_account", "account_id").agg(F.count_distinct("cents", "credit", "feed_day").alias("agree"))

    def best(agreed: DataFrame, least: int) -> DataFrame:
        enough = (F.col("agree") >= rules.least_share * F.col("n")) & (F.col("agree") >= least)
        return cut_lineage(agreed.join(counts, "feed_account").where(enough).groupBy("feed_account").agg(F.max_by("account_id", F.struct("agree", "account_id")).alias("account_id")))

    bare = lines.drop("description").distinct()
    masked = best(agreeing(spread(bare, ours.where("mask != ''"), "account_id"), distinct.select("*", blocks).join(theirs, "feed_account"), [*key, "mask"]), 1)

    open_ours, open_theirs = ours.drop("mask").join(masked, "account_id", "left_anti"), theirs.drop("mask").join(masked, "feed_account", "left_anti")
    word = lambda c: F.explode(_starts(_words(c, common), _kind(F.coalesce(c, F.lit(""))))).alias("word")
    left = cut_lineage(spread(lines, open_ours, "account_id").select(*key, "account_id", "day", word(F.col("description"))).distinct())
    right = paid.join(open_theirs.select("feed_account").distinct(), "feed_account").select(*one, word(F.concat_ws(" ", "merchant_name", "name"))).distinct()
    right = cut_lineage(right.select("*", blocks).join(open_theirs, "feed_account"))
    # How many lines each payment would meet, from counts alone; then the rarest n - t + k of each feed account.
    met = cut_lineage(right.join(left.groupBy(*key, "word").agg(F.count("*").alias("lines")), [*key, "word"]).groupBy(*one).agg(F.sum("lines").alias("lines")))
    k, t = rules.least_agreeing, F.greatest(F.ceil(F.col("n") * rules.least_share), F.lit(rules.least_agreeing))
    by_lines = met.groupBy("feed_account", "lines").agg(F.count("*").alias("c"))
    so_far = F.sum("c").over(Window.partitionBy("feed_account").orderBy("lines"))
    # Payments that meet none come before all others and can't agree.
    none = counts.join(by_lines.groupBy("feed_account").agg(F.sum("c").alias("some")), "feed_account").select("feed_account", (F.col("n") - F.col("some")).alias("none"), (F.col("n") - t + k).alias("first"))
    limit = by_lines.withColumn("so_far", so_far).join(none, "feed_account").where(F.col("so_far") + F.col("none") - F.col("c") < F.col("first")).groupBy("feed_account").agg(F.max("lines").alias("limit"))
    ranked = cut_lineage(met.join(limit, "feed_account").select(*one, (F.col("lines") <= F.col("limit")).alias("rare")))
    rare = right.join(ranked.where("rare").drop("rare"), one, "left_semi")
    found = cut_lineage(agreeing(left, rare, [*key, "word"]).where(F.col("agree") >= k))
    rest = right.join(ranked.where("not rare").drop("rare"), one, "left_semi").join(found.select("feed_account", "account_id"), "feed_account")
    more = agreeing(left.drop("bank", "kind"), rest.drop("bank", "kind"), ["account_id", "cents", "credit", "block", "word"])
    both = found.unionByName(more).groupBy("feed_account", "account_id").agg(F.sum("agree").alias("agree"))
    return masked.unionByName(best(both, rules.least_agreeing))


def features(lines: DataFrame, payments: DataFrame, common: list[str] | None = None, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """What the candidate joins and the matching functions need of each line and payment, with the hash of its kind, once."""
    text = F.coalesce("description", F.lit(""))
    a = lines.select(
        "class", "account_id", "credit", "cents", _day("date").alias("day"), F.floor(_day("date") / rules.block).cast("int").alias("block"),
        _letters(text).alias("l_letters"), _kind(text).alias("l_kind"), _starts(_words(text, common), _kind(text)).alias("l_words"),
    )
    who = F.concat_ws(" ", "merchant_name", "name")
    own = _kind(F.coalesce("name", F.lit("")))
    p_kind = F.when((own == "other") & F.coalesce(F.col("pfc_primary"), F.lit("")).startswith("TRANSFER"), "person").otherwise(own)
    b = payments.select(
        "payment", "account_id", "credit", F.col("cents").alias("p_cents"), _day("date").alias("p_day"), _day("authorized_date").alias("p_auth"),
        _words(F.regexp_replace(F.coalesce("merchant_name", "name"), r"(?i)\(online\)", ""), common).alias("p_words"),
        _letters(F.regexp_replace(F.coalesce("merchant_name", F.lit("")), r"(?i)\(online\)|\bllc\b|\binc\b", "")).alias("p_merchant"), _letters(F.col("name")).alias("p_name"),
        p_kind.alias("p_kind"), _starts(_words(who, common), p_kind).alias("p_starts"), _letters(F.col("city")).alias("p_city"),
    )
    kind = lambda df: F.unhex(F.md5(F.to_json(F.struct(*df.columns[1:]))))
    return cut_lineage(a.withColumn("l_key", kind(a))), cut_lineage(b.withColumn("p_key", kind(b)))


def kinds(rows: DataFrame, key: str, member: str) -> DataFrame:
    """A row for each kind: its features, its number of members and the least of them."""
    rest = [c for c in rows.columns if c not in (key, member)]
    return cut_lineage(rows.groupBy(key).agg(F.count("*").alias(f"n_{key[0]}"), F.min(member).alias(member), F.any_value(F.struct(*rest)).alias("x")).select(key, f"n_{key[0]}", member, "x.*"))


def numbered(rows: DataFrame, of: DataFrame, key: str, member: str) -> DataFrame:
    """(key, member, rank): the members of each kind numbered from 1. Kinds of several are numbered within hash
    buckets, and the buckets' counts added up, so that no task orders a kind."""
    n = f"n_{key[0]}"
    several = spread(rows.select(member, key), of.where(F.col(n) > 1).select(key), key).withColumn("salt", F.pmod(F.xxhash64(member), F.lit(SALTS)))
    before = several.groupBy(key, "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy(key).orderBy("salt")) - F.col("count")).drop("count")
    inside = several.withColumn("rank", F.row_number().over(Window.partitionBy(key, "salt").orderBy(member)))
    return of.where(F.col(n) == 1).select(key, member, F.lit(1).cast("bigint").alias("rank")).unionByName(inside.join(before, [key, "salt"]).select(key, member, (F.col("rank") + F.col("before")).alias("rank")))


def candidates(a: DataFrame, b: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(l_key, p_key) of the same account and direction worth voting on, each once.

    Two equi-joins on narrow keys: account, direction, exact amount and block of days; and account,
    direction, beginning of a word, block of days and class of amount. No key gathers an account.
    """
    width = math.log(rules.most_ratio / rules.least_ratio)
    near = F.col("day").between(F.col("p_day") - rules.days_ahead, F.col("p_day") + rules.days_behind)
    left, right = a.select("l_key", "account_id", "credit", "cents", "day", "block"), b.select("p_key", "account_id", "credit", "p_cents", "p_day")
    exact = left.join(right.select("*", _day_blocks(F.col("p_day"), rules).alias("block")).withColumnRenamed("p_cents", "cents"), ["account_id", "credit", "cents", "block"]).where(near).select("l_key", "p_key")

    size = lambda c, by: F.floor(F.log(F.col(c) * by + 1.0) / width)
    keyed = a.select("l_key", "account_id", "credit", "cents", "day", "block", F.explode("l_words").alias("word")).withColumn("size", size("cents", 1.0))
    asked = b.select("p_key", "account_id", "credit", "p_cents", "p_day", F.explode("p_starts").alias("word"))
    asked = asked.select("*", F.explode(F.sequence(size("p_cents", rules.least_ratio), size("p_cents", rules.most_ratio))).alias("size"))
    asked = asked.select("*", _day_blocks(F.col("p_day"), rules).alias("block"))
    ratio = F.try_divide(F.col("cents"), F.col("p_cents"))  # a zero amount meets only zero, exactly
    close = keyed.join(asked, ["account_id", "credit", "word", "size", "block"]).where(near & (F.col("cents") != F.col("p_cents")) & ratio.between(rules.least_ratio, rules.most_ratio))
    return exact.unionByName(close.select("l_key", "p_key").distinct())


def vote(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """The matching functions' votes on each pair."""
    return _voted(pairs.join(a.drop("class", "account_id", "credit", "block", "l_words"), "l_key").join(b.drop("payment", "account_id", "credit", "p_starts"), "p_key"))


def _voted(pairs: DataFrame) -> DataFrame:
    """The votes of the matching functions, each a small number; 0 abstains where a function can."""
    gap = F.col("day") - F.col("p_day")
    off = F.abs(F.col("cents") - F.col("p_cents"))
    ratio = F.try_divide(F.col("cents"), F.col("p_cents"))  # a zero amount meets only zero, exactly
    skel = _skeleton(F.col("l_letters"))
    hit = lambda w: F.contains(F.col("l_letters"), w) | ((F.length(w) >= 8) & F.contains(F.col("l_letters"), F.substring(w, 1, 7))) | ((F.length(_skeleton(w)) >= 3) & F.contains(skel, _skeleton(w)))
    n, hits = F.size("p_words"), F.size(F.filter("p_words", hit))
    starts = lambda c: (F.length(c) >= 6) & (F.contains(F.col("l_letters"), F.substring(c, 1, 8)) | ((F.length(_skeleton(c)) >= 5) & F.contains(skel, F.substring(_skeleton(c), 1, 6))))
    named = (F.length("p_merchant") >= 6) | (F.col("p_kind") == "other") & (F.length("p_name") >= 6)
    votes = {
        "amount": F.when(off == 0, 0).when(off <= 2, 1).when(ratio.between(0.965, 1.035), 2).when(ratio > 1.1, 3).otherwise(4),
        "gap": F.when(gap < -1, 0).when(gap == -1, 1).when(gap == 0, 2).when(gap == 1, 3).when(gap == 2, 4).when(gap == 3, 5).otherwise(6),
        "authorized": F.when(F.col("p_auth").isNull(), 0).when((F.col("day") - F.col("p_auth")).between(0, 2), 1).when((F.col("day") - F.col("p_auth")).between(-1, 5), 2).otherwise(3),
        "words": F.when(n == 0, 0).when(hits == 0, 1).when((hits >= 2) | (hits == n), 3).otherwise(2),
        "start": F.when(starts(F.col("p_merchant")) | starts(F.col("p_name")), 2).when(named, 1).otherwise(0),
        "kind": F.when(F.col("p_kind") == F.col("l_kind"), F.when(F.col("p_kind") == "other", 0).otherwise(2)).when((F.col("p_kind") == "other") & ~F.col("l_kind").isin("atm", "check", "transfer", "fee"), 0).otherwise(1),
        "place": F.when(F.length("p_city") == 0, 0).when(F.contains(F.col("l_letters"), F.col("p_city")), 2).otherwise(1),
    }
    return pairs.select("l_key", "p_key", "n_l", "n_p", gap.alias("days"), off.alias("off"), (hits / F.greatest(n, F.lit(1))).alias("share"), *[v.cast("int").alias(f"v_{k}") for k, v in votes.items()])


#: What the functions' values mean at the start, as weights for (1) and against (-1) a match; learned from there on.
_FIRST = {
    "amount": [1.0, 0.7, 0.2, -0.2, -1.5],
    "gap": [-1.0, 0.0, 1.0, 0.8, 0.5, 0.2, -0.5],
    "authorized": [0.0, 0.6, 0.0, -0.8],
    "words": [0.0, -1.5, 0.8, 1.5],
    "start": [0.0, -1.2, 1.5],
    "kind": [0.0, -2.0, 1.2],
    "place": [0.0, -0.3, 0.8],
}


def learn(voted: DataFrame) -> tuple[LabelModel | None, list[tuple]]:
    """The label model and each vote pattern with its posterior; patterns are at most the product of SIZES."""
    counts = voted.groupBy(*[f"v_{v}" for v in VOTES]).count().collect()
    if not counts:
        return None, []
    patterns = np.array([list(r)[:-1] for r in counts], dtype=int)
    n = np.array([r["count"] for r in counts], dtype=float)
    total = sum(np.array(_FIRST[v])[patterns[:, i]] for i, v in enumerate(VOTES))
    start = 1 / (1 + np.exp(-1.5 * (total - 1.0)))
    strength = max(5.0, 0.01 * n.sum())
    anchor = [strength * np.stack([np.exp(-np.array(_FIRST[v])), np.exp(np.array(_FIRST[v]))]) / len(_FIRST[v]) for v in VOTES]
    model = fit(patterns, n, SIZES, start, ABSTAIN, anchor)
    return model, [(*map(int, p), float(q)) for p, q in zip(patterns, model.posterior(patterns))]


def matched(voted: DataFrame, least: float = Rules.confidence) -> DataFrame:
    """(l_key, p_key, confidence, took, l_from, p_from): candidates of at least `least`, one line for one payment.

    Of all candidates the best for both its lines and its payments are taken, as many as both have left,
    then the best of what is left, until nothing is. Ties in confidence go to the nearer amount, day and
    name, then to the lesser hash of both: the order among ties is as good as random, so they are settled
    in a number of rounds that grows with the logarithm of their number. Members l_from + 1 .. l_from + took
    of the line's kind belong to p_from + 1 .. p_from + took of the payment's.
    """
    spark = voted.sparkSession
    _, rows = learn(voted)
    names = [f"v_{v}" for v in VOTES]
    known = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", confidence double")
    scored = voted.join(F.broadcast(known), names).where(F.col("confidence") >= least)
    worth = F.struct(
        F.round(-F.col("confidence"), 3).alias("a"), F.least("off", F.lit(3)).alias("b"), F.round(-F.col("share"), 2).alias("c"), F.abs(F.col("days") - 0.4).alias("d"), F.col("off").alias("e"), F.xxhash64("l_key", "p_key").alias("f"), F.col("l_key").alias("g"), F.col("p_key").alias("h"),
    )
    by_line, by_payment = Window.partitionBy("l_key"), Window.partitionBy("p_key")
    zero = F.lit(0).cast("bigint")
    edges = scored.select("l_key", "p_key", "confidence", worth.alias("worth"), "n_l", "n_p", zero.alias("l_from"), zero.alias("p_from"), zero.alias("took"))
    is_open = F.col("took") == 0
    now = F.when(is_open, F.col("worth"))
    left = [F.col(f"n_{s}") - F.col(f"{s}_from") for s in "lp"]
    while True:
        for _ in range(ROUNDS_A_JOB):
            edges = edges.withColumn("for_line", F.min(now).over(by_line)).withColumn("for_payment", F.min(now).over(by_payment))
            hit = is_open & (F.col("worth") == F.col("for_line")) & (F.col("worth") == F.col("for_payment"))
            edges = edges.withColumn("takes", F.when(hit, F.least(*left)).otherwise(0)).withColumn("l_took", F.sum("takes").over(by_line)).withColumn("p_took", F.sum("takes").over(by_payment))
            waits = is_open & (F.col("takes") == 0)
            edges = edges.select(
                "l_key", "p_key", "confidence", "worth", "n_l", "n_p",
                *[F.when(waits, F.col(f"{s}_from") + F.col(f"{s}_took")).otherwise(F.col(f"{s}_from")).alias(f"{s}_from") for s in "lp"],
                F.greatest("took", "takes").alias("took"),
            ).where(~is_open | (F.least(*left) > 0))
        edges = cut_lineage(edges)
        if edges.where(is_open).isEmpty():
            return edges.select("l_key", "p_key", "confidence", "took", "l_from", "p_from")


def link(ledger: DataFrame, accounts: DataFrame, feed: DataFrame, feed_accounts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(ledger_id, plaid_transaction_id, confidence): every stored copy of a line with every feed id of its payment.

    Empty tables, payments without text, ties and repeated rows are all allowed; extra columns are ignored.
    """
    payments, ids = feed_payments(feed)
    common = common_words(ledger, payments)
    linked = cut_lineage(link_accounts(accounts, feed_accounts, ledger, payments, common, rules))
    # Copies stand in one account, so those of other accounts need not be told apart.
    mine = cut_lineage(of_linked(ledger, linked))
    rows = ledger_rows(mine)
    theirs = spread(payments.withColumnRenamed("account_id", "feed_account"), linked, "feed_account", id_="payment").drop("feed_account")
    a, b = features(own_lines(rows, mine), theirs, common, rules)
    of_a, of_b = kinds(a, "l_key", "class"), kinds(b, "p_key", "payment")
    took = matched(cut_lineage(vote(candidates(of_a, of_b, rules), of_a, of_b)), rules.confidence)
    l_rank, p_rank = numbered(a, of_a, "l_key", "class"), numbered(b, of_b, "p_key", "payment").withColumnRenamed("rank", "p_rank")
    mine = took.join(l_rank, "l_key").where((F.col("rank") > F.col("l_from")) & (F.col("rank") <= F.col("l_from") + F.col("took"))).withColumn("p_rank", F.col("rank") - F.col("l_from") + F.col("p_from"))
    # Cut, since the driver holds each plan several times while it runs: one of all that follows took more of its memory than all others.
    pairs = cut_lineage(mine.join(p_rank, ["p_key", "p_rank"]).select("class", "payment", "confidence"))
    members, heavy = rows.select("class", "id"), cut_lineage(hot_classes(rows).select("class", F.lit(True).alias("hot")))
    if heavy.isEmpty():
        out = members.join(pairs, "class")
    else:
        # Copies of a line may be many: hot classes are few enough to broadcast, and their rows meet the pair by class and salt.
        marked = lambda df: df.join(F.broadcast(heavy), "class", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        out = with_lines(marked(members), marked(pairs))
    out = out.join(ids, "payment")
    return out.select(F.col("id").alias("ledger_id"), F.col("transaction_id").alias("plaid_transaction_id"), "confidence")
