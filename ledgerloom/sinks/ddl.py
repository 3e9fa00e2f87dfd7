"""The ledger's tables in a catalog, made where they are missing; changes only add."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = {
    "accounts": "id STRING, user_id STRING, institution STRING, account_type STRING, account_number_masked STRING, currency STRING, created_at TIMESTAMP",
    "sources": "id STRING, user_id STRING, provider STRING, file_name STRING, file_sha256 STRING, page_count INT, uploaded_at TIMESTAMP, notes STRING",
    "parse_runs": "id STRING, user_id STRING, source_id STRING, parser_version STRING, schema_version STRING, options STRING, status STRING, warnings STRING, output_snapshot STRING, created_at TIMESTAMP",
    "statements": "id STRING, user_id STRING, account_id STRING, statement_id STRING, period_start DATE, period_end DATE, statement_kind STRING, starting_balance DECIMAL(14,2), ending_balance DECIMAL(14,2), total_credits DECIMAL(14,2), total_debits DECIMAL(14,2), transaction_count INT, page_start INT, page_end INT, provenance STRING, metadata STRING, created_at TIMESTAMP",
    "ledger_transactions": "id STRING, user_id STRING, account_id STRING, statement_db_id STRING, transaction_id STRING, date DATE, posted_date DATE, amount DECIMAL(14,2), direction STRING, description STRING, description_raw STRING, merchant STRING, bank_reference STRING, channel STRING, category STRING, subcategory STRING, confidence DOUBLE, rule_id STRING, rationale STRING, flags STRING, raw STRING, created_at TIMESTAMP",
    "overrides": "id STRING, user_id STRING, transaction_id STRING, kind STRING, value STRING, created_at TIMESTAMP",
    "feed_items": "item_id STRING, user_id STRING, institution STRING, status STRING, cursor STRING, synced_at TIMESTAMP",
    "gap_cache": "account STRING, start DATE, end DATE, checked_at TIMESTAMP",
}


def statements(database: str) -> list[str]:
    """The SQL that makes the database and its tables where they are missing."""
    return [f"CREATE DATABASE IF NOT EXISTS {database}", *[f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet" for name, columns in TABLES.items()]]


def missing(spark: SparkSession, database: str) -> list[str]:
    """Tables, and columns of tables as table.column, that the database lacks."""
    if not spark.catalog.databaseExists(database):
        return list(TABLES)
    out = []
    for name, columns in TABLES.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            out.append(name)
            continue
        there = set(spark.table(f"{database}.{name}").columns)
        out += [f"{name}.{c}" for c in (x.split()[0] for x in columns.split(", ")) if c not in there]
    return out


def migrate(spark: SparkSession, database: str) -> list[str]:
    """Make what is missing; returns what that was. A second run finds nothing to do."""
    lacking = missing(spark, database)
    for sql in statements(database):
        spark.sql(sql)
    for name in lacking:
        if "." in name:
            table, column = name.split(".")
            kind = next(x.split(" ", 1)[1] for x in TABLES[table].split(", ") if x.split()[0] == column)
            spark.sql(f"ALTER TABLE {database}.{table} ADD COLUMNS ({column} {kind})")
    return lacking
