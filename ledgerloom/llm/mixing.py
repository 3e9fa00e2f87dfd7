"""Mixing sources to target weights by Poisson replication.

Each document draws its number of copies from a Poisson distribution whose mean is its source's
repetition rate, by inverting the distribution at a uniform number hashed from the document's id, and
no more than the source's cap. For these fixed numbers the tokens that a source contributes rise with
its rate; a histogram of tokens by hashed number, whose size depends on the number of sources alone,
suffices to find the rate at which they meet the target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.format_duplicates import spread
from ledgerloom.session import cut_lineage

#: Buckets of the hashed number in a source's histogram.
BUCKETS = 4096


def uniform(id_: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and seed alone, the same on every executor and retry."""
    return (F.shiftrightunsigned(F.xxhash64(id_.cast("string"), F.lit(seed)), 11)).cast("double") / F.lit(float(2**53))


def thresholds(rate: float, cap: int) -> list[float]:
    """Where the copies go up by one: copies = how many of these the uniform number reaches. Infinite rates always give the cap."""
    if math.isinf(rate):
        return [0.0] * cap
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(cap):
        total += term
        out.append(min(total, 1.0))
        term *= rate / (k + 1)
    return out


def _tokens_at(hist: list[tuple[int, int]], rate: float, cap: int) -> float:
    """Tokens at a rate; a bucket that a threshold cuts counts by its part."""
    b, n = np.array(hist, dtype=float).reshape(-1, 2).T
    return float(sum((n * np.clip(b + 1 - t * BUCKETS, 0.0, 1.0)).sum() for t in thresholds(rate, cap)))


def solve_rate(hist: list[tuple[int, int]], target: float, cap: int) -> float:
    """The rate at which a source gives `target` tokens, by bisection; infinite if only the cap gives as many."""
    whole = cap * sum(n for _, n in hist)
    if target <= 0:
        return 0.0
    if target >= whole * (1 - 1e-12):
        return math.inf
    lo, hi = 0.0, 1.0
    while _tokens_at(hist, hi, cap) < target and hi < 700:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _tokens_at(hist, mid, cap) < target else (lo, mid)
    return hi


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rates, at = [], []
        for hist, target, cap in zip(b.pop("hist"), b["target"], b["cap"]):
            rate = solve_rate([(h["b"], h["n"]) for h in hist] if hist is not None else [], target, cap)
            rates.append(rate)
            at.append([t for t in thresholds(rate, cap) if t < 1.0] if 0 < rate < math.inf else [])
        yield b.assign(rate=rates, at=at)


def planned(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """A row per target source: available tokens, share, target tokens, rate and thresholds.

    docs: source, id and n_tokens. Without `total`, the mix is as large as the caps allow at the exact
    shares; a larger total makes sources run into their caps and is then spread as it comes. Sources
    without tokens get no share; weights of null, nan or below 0 count as 0, caps of null as 1. Rates are
    solved where the histograms are, one source at a time; two numbers come to the driver.
    """
    w, cap = F.max("target_weight"), F.max("max_repeats")
    wanted = targets.where("source is not null").groupBy("source").agg(F.when((w > 0) & ~F.isnan(w), w).otherwise(0.0).alias("weight"), F.greatest(F.coalesce(cap, F.lit(1)), F.lit(0)).cast("int").alias("cap"))
    u = uniform(F.col("id"), seed)
    names = wanted.select("source", F.lit(True).alias("listed"))
    binned = spread(docs.select("id", "source", "n_tokens"), names, "source").groupBy("source", F.floor(u * BUCKETS).cast("int").alias("b")).agg(F.sum("n_tokens").alias("n"))
    hist = binned.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("hist"), F.sum("n").alias("available"))  # BUCKETS at most
    rows = cut_lineage(wanted.join(hist, "source", "left").fillna(0, ["available"]))
    usable = (F.col("available") > 0) & (F.col("cap") > 0) & (F.col("weight") > 0)
    most = rows.where(usable).agg(F.sum("weight").alias("weight"), F.min(F.col("available") * F.col("cap") / F.col("weight")).alias("size")).first()
    weights = most["weight"] or 0.0
    total = (most["size"] or 0.0) * weights if total is None else total
    share = F.when(usable, F.col("weight") / F.lit(weights or 1.0)).otherwise(0.0)
    rows = rows.withColumn("share", share).withColumn("target", F.col("share") * F.lit(float(total)))
    kinds = "source string, weight double, cap int, available bigint, share double, target double, rate double, at array<double>"
    return cut_lineage(rows.mapInPandas(_solved, kinds))


def plan(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> list[dict]:
    """The rows of planned(), for a look at a mix of few sources."""
    return [r.asDict() for r in planned(docs, targets, total, seed).orderBy("source").collect()]


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """(id, source, copy, n_tokens, place): the mixed records in a globally shuffled order by place.

    docs: id, source, n_tokens. A document appears once for each of its copies, at most its source's
    cap; documents of a null or unlisted source do not appear. place is hashed from id, copy and seed.
    """
    at = planned(docs, targets, total, seed).select("source", "cap", "rate", "at")
    drawn = spread(docs.select("id", "source", "n_tokens"), at, "source").withColumn("u", uniform(F.col("id"), seed))
    copies = F.when(F.col("rate") == float("inf"), F.col("cap")).otherwise(F.size(F.filter("at", lambda t: F.col("u") >= t)))
    drawn = drawn.withColumn("copies", copies).where("copies > 0")
    out = drawn.select("id", "source", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "n_tokens")
    out = out.withColumn("place", F.xxhash64(F.col("id").cast("string"), "copy", F.lit(seed + 1)))
    return out.orderBy("place", "id", "copy")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, records, documents, most_copies) for every target source."""
    got = mixed.groupBy("source", "id").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("t")).groupBy("source")
    got = got.agg(F.sum("t").alias("tokens"), F.sum("c").alias("records"), F.count("*").alias("documents"), F.max("c").alias("most_copies"))
    w = F.max("target_weight")
    want = targets.where("source is not null").groupBy("source").agg(F.when((w > 0) & ~F.isnan(w), w).otherwise(0.0).alias("w"))
    all_ = cut_lineage(want.join(got, "source", "left").fillna(0, ["tokens", "records", "documents", "most_copies"]))
    sums = all_.agg(F.sum(F.when(F.col("tokens") > 0, F.col("w"))).alias("weights"), F.sum("tokens").alias("all_tokens")).withColumn("one", F.lit(1))
    both = all_.withColumn("one", F.lit(1)).join(F.broadcast(sums), "one")  # one row
    share = F.when(F.col("tokens") > 0, F.try_divide(F.col("w"), F.col("weights"))).otherwise(F.lit(0.0))
    actual = F.coalesce(F.try_divide(F.col("tokens"), F.col("all_tokens")), F.lit(0.0))
    return both.select("source", share.alias("target_share"), actual.alias("actual_share"), "tokens", "records", "documents", "most_copies")
