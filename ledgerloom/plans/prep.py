"""Queries for intervals (p2), drifting schemas (p3) and rolling totals (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import intervals, rolling, schema_drift
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import table


@query("""
WITH ok AS (SELECT account_id, period_start AS s, period_end AS e FROM statements WHERE period_start <= period_end),
marked AS (SELECT *, max(e) OVER (PARTITION BY account_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
grouped AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY account_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM marked),
periods AS (SELECT account_id, min(s) AS a, max(e) AS b FROM grouped GROUP BY account_id, g),
gaps AS (SELECT account_id, b + 1 AS a, lead(a) OVER (PARTITION BY account_id ORDER BY a) - 1 AS b FROM periods)
SELECT account_id, 'period' AS kind, strftime(a, '%Y-%m-%d') AS start_day, strftime(b, '%Y-%m-%d') AS end_day FROM periods
UNION ALL SELECT account_id, 'gap', strftime(a, '%Y-%m-%d'), strftime(b, '%Y-%m-%d') FROM gaps WHERE b IS NOT NULL
""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = intervals.periods_and_gaps(table(spark, folder, "statements"), "account_id", "period_start", "period_end")
    return found.select("account_id", "kind", F.col("start_day").cast("string").alias("start_day"), F.col("end_day").cast("string").alias("end_day"))


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "parse_runs").where("status = 'success' and output_snapshot is not null")


@query()
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    found = schema_drift.changes(_snapshots(spark, folder), "id", "source_id", "created_at", "output_snapshot")
    return found.select(F.col("id").alias("run_id"), "field_path", "change_kind")


_LEAVES = r"""d AS (SELECT id, output_snapshot AS j FROM parse_runs WHERE status = 'success' AND json_valid(output_snapshot) AND json_type(output_snapshot) IN ('OBJECT', 'ARRAY')),
leaf AS (SELECT d.id, regexp_replace(regexp_replace(t.fullkey, '^\$\.?', ''), '\[\d+\]', '[]', 'g') AS path, t.id AS place, json_extract_string(t.atom, '$') AS said,
  CASE WHEN t.type = 'NULL' THEN 'null' WHEN t.type = 'BOOLEAN' THEN 'boolean' WHEN t.type IN ('BIGINT', 'UBIGINT') THEN 'integer' WHEN t.type = 'DOUBLE' THEN 'number' WHEN regexp_full_match(json_extract_string(t.atom, '$'), '\d{4}-\d\d-\d\d') THEN 'date' ELSE 'string' END AS kind
  FROM d, json_tree(d.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')),
kinds AS (SELECT path, list(DISTINCT kind) FILTER (kind <> 'null') AS k, count(DISTINCT id) AS documents FROM leaf GROUP BY 1),
folded AS (SELECT path, documents, CASE WHEN k IS NULL OR len(k) = 0 THEN 'null' WHEN len(k) = 1 THEN k[1] WHEN list_has_all(['integer', 'number'], k) THEN 'number' ELSE 'string' END AS type FROM kinds)"""


@query(f"WITH {_LEAVES} SELECT path, type, documents FROM folded")
def p3_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The union schema of all snapshots."""
    return schema_drift.union_schema(_snapshots(spark, folder), "output_snapshot")


@query(rf"""WITH {_LEAVES},
rows AS (SELECT leaf.id AS run_id, path, type, kind, row_number() OVER (PARTITION BY leaf.id, path ORDER BY place) - 1 AS position,
  CASE WHEN kind = 'number' THEN regexp_replace(regexp_replace(CAST(CAST(said AS DECIMAL(38,12)) AS VARCHAR), '0+$', ''), '\.$', '') ELSE said END AS said FROM leaf JOIN folded USING (path))
SELECT run_id, path, type, CAST(position AS INT) AS position, CASE WHEN type = 'number' AND NOT contains(said, '.') THEN said || '.0' ELSE said END AS value,
  CASE WHEN type = 'boolean' THEN CAST(said AS BOOLEAN) END AS as_boolean, CASE WHEN type = 'integer' THEN CAST(said AS BIGINT) END AS as_integer, CASE WHEN type = 'number' THEN CAST(said AS DECIMAL(38,12)) END AS as_number,
  CAST(NULL AS DOUBLE) AS as_real, CASE WHEN type = 'date' THEN CAST(said AS DATE) END AS as_date FROM rows""")
def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    """All snapshots as one table in the union schema, a row for each leaf."""
    return schema_drift.consistent_rows(_snapshots(spark, folder), "id", "output_snapshot").withColumnRenamed("id", "run_id")


@query()
def p3_wide(spark: SparkSession, folder: str) -> DataFrame:
    """All snapshots as one table in the union schema, a row for each snapshot and a typed column for each field."""
    return schema_drift.wide_table(_snapshots(spark, folder).withColumnRenamed("id", "run_id"), "run_id", "output_snapshot")


@query("""
WITH signed AS (SELECT account_id, date AS day, CASE WHEN lower(trim(direction)) = 'debit' THEN -abs(amount) ELSE abs(amount) END AS v FROM ledger_transactions),
days AS (SELECT account_id, day, sum(v) AS v, count(*) AS n FROM signed GROUP BY 1, 2),
spans AS (SELECT account_id, min(day) AS a, max(day) AS b FROM days GROUP BY 1),
grid AS (SELECT account_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
dense AS (SELECT g.account_id, g.day, coalesce(d.v, 0) AS v, coalesce(d.n, 0) AS n FROM grid g LEFT JOIN days d ON d.account_id = g.account_id AND d.day = g.day),
rolled AS (SELECT account_id, day, v, n,
  sum(v) OVER w7 AS t7, sum(n) OVER w7 AS n7, sum(v) OVER w30 AS t30, sum(n) OVER w30 AS n30 FROM dense
  WINDOW w7 AS (PARTITION BY account_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY account_id ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT account_id, day, CAST(v AS DOUBLE) AS amount_day, CAST(n AS BIGINT) AS rows_day, CAST(t7 AS DOUBLE) AS total_7, round(CAST(t7 AS DOUBLE) / 7, 6) AS avg_7, CAST(n7 AS BIGINT) AS rows_7,
  CAST(t30 AS DOUBLE) AS total_30, round(CAST(t30 AS DOUBLE) / 30, 6) AS avg_30, CAST(n30 AS BIGINT) AS rows_30 FROM rolled
""")
def p6_rolling(spark: SparkSession, folder: str) -> DataFrame:
    signed = F.when(F.lower(F.trim("direction")) == "debit", -F.abs("amount")).otherwise(F.abs("amount"))
    out = rolling.trailing(table(spark, folder, "ledger_transactions"), "account_id", "date", signed, (7, 30))
    return out.select("account_id", F.col("date").alias("day"), *[F.col(c).cast("bigint" if c.startswith("rows") else "double").alias(c) for c in out.columns[2:]])
