"""Queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import format_duplicates as dup
from ledgerloom.llm import linkage, mixing, survivor, text_ops
from ledgerloom.llm.sql import ORACLE  # noqa: F401
from ledgerloom.session import cut_lineage
from ledgerloom.sources.tables import table

SURVIVING = ["merchant", "category", "raw"]


def _lines(spark: SparkSession, folder: str, carry=None) -> DataFrame:
    return dup.classed(table(spark, folder, "ledger_transactions"), "id", dup.ledger_cell(), "description", carry)


def p1_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every matching pair with its confidence."""
    names = ("ledger_transactions", "accounts", "plaid_transactions", "plaid_accounts")
    return linkage.link(*[table(spark, folder, n) for n in names])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_links(spark, folder).select("ledger_id", "plaid_transaction_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return dup.copy_pairs(_lines(spark, folder))


def p4_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each line once, under its least id, with its number of copies."""
    return dup.collapse(_lines(spark, folder))


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """Each row with the least id of its line and the line's number of copies."""
    return dup.copies(_lines(spark, folder)).select("id", "representative", "copies")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.best_fields(_lines(spark, folder, survivor.carried(survivor.ledger_fields())), SURVIVING)


def p5_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each line: by votes where it has copies, its own values where it has none."""
    fields, ledger = survivor.ledger_fields(), table(spark, folder, "ledger_transactions")
    members = _lines(spark, folder, survivor.carried(fields, source=survivor.ledger_source(ledger)))
    best = survivor.voted_fields(members, SURVIVING)
    return survivor.survivors(ledger, "id", best, SURVIVING, members).unionByName(survivor.single_records(ledger, "id", members, {k: v[0] for k, v in fields.items()}))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return text_ops.encode(table(spark, folder, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's number of ids and the hash of the text decoded from them."""
    ids = p7_ids(spark, folder)
    texts = text_ops.decode(ids, "doc_id")
    return texts.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    listed = table(spark, folder, "mix_targets").select("source").distinct()
    return cut_lineage(text_ops.count_tokens(docs.join(listed, "source", "left_semi"), "text", ["id", "source"]))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_sized(spark, folder), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each target source in the mix, wanted and actual."""
    targets = table(spark, folder, "mix_targets")
    return mixing.shares(mixing.mix(_sized(spark, folder), targets), targets)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return text_ops.sentence_spans(table(spark, folder, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_links": p1_links,
    "p4_found": p4_found,
    "p4_lines": p4_lines,
    "p4_members": p4_members,
    "p5_found": p5_found,
    "p5_survivors": p5_survivors,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}
