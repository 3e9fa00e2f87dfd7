"""Importing parsed statements: accounts, statements and rows are created where their natural key is not stored.

Ids are hashes of natural keys, so every retry and every executor makes the same ones, and links between
new rows need no second look-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.upsert import new_rows, surrogate

ACCOUNT_KEY = ["user_id", "institution", "account_type", "account_number_masked"]
STATEMENT_KEY = ["user_id", "statement_id"]


def get_or_create(stored: DataFrame, wanted: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new, ids): rows of `wanted` whose key is not stored, with an id, and (key, id) of all wanted keys.

    Of several wanted rows with one key one is created; stored rows keep their ids. Null keys equal nothing.
    """
    one = wanted.dropDuplicates(key)
    new = new_rows(one, stored, key).withColumn("id", surrogate(*key))
    known = stored.select(*key, "id").join(one.select(key), key, "left_semi")
    return new, known.unionByName(new.select(*key, "id"))


def imported(accounts: DataFrame, statements: DataFrame, rows: DataFrame, parsed: DataFrame, parsed_rows: DataFrame) -> dict[str, DataFrame]:
    """New accounts, statements and rows of parsed statements, and the links of rows to statements.

    parsed: ACCOUNT_KEY, statement_id, period_start, period_end; parsed_rows: user_id, statement_id,
    transaction_id and what else rows have. What is stored stays as it is.
    """
    new_accounts, account_ids = get_or_create(accounts, parsed.select(ACCOUNT_KEY), ACCOUNT_KEY)
    with_account = parsed.join(account_ids.withColumnRenamed("id", "account_id"), ACCOUNT_KEY)
    new_statements, statement_ids = get_or_create(statements, with_account, STATEMENT_KEY)
    linked = parsed_rows.join(statement_ids.withColumnRenamed("id", "statement_db_id"), STATEMENT_KEY)
    linked = linked.join(with_account.select(*STATEMENT_KEY, "account_id").dropDuplicates(STATEMENT_KEY), STATEMENT_KEY)
    fresh = new_rows(linked.dropDuplicates(["transaction_id"]), rows, ["transaction_id"]).withColumn("id", surrogate("transaction_id"))
    return {"accounts": new_accounts, "statements": new_statements, "rows": fresh, "links": linked.select("transaction_id", "statement_db_id")}


def deleted(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the rows of the given keys."""
    return stored.join(keys.distinct(), keys.columns, "left_anti")
