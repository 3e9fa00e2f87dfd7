"""Queries of reconciliation and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import classify
from ledgerloom.functions.category_rules import FEED_CATEGORIES, entries
from ledgerloom.operators import reconcile
from ledgerloom.plans.registry import query
from ledgerloom.session import cut_lineage
from ledgerloom.sources.tables import table


def sides(spark: SparkSession, folder: str, by_mask: bool = False) -> tuple[DataFrame, DataFrame]:
    """All ledger rows, amounts by size, and all feed rows as delivered last; pending rows that a posted one names have been replaced by it.

    A feed row stands under its ledger account, or if it has none under one to be created for its kind
    and mask. by_mask: only linked rows, as SIDES links them, by the least id of equal kind and mask.
    """
    ledger = table(spark, folder, "ledger_transactions").withColumnRenamed("account_id", "account")
    feed, optional = table(spark, folder, "plaid_transactions"), ("pending_transaction_id", "city", "region")
    feed = feed.withColumns({c: F.lit(None).cast("string") for c in optional if c not in feed.columns})
    if by_mask:
        feed = feed.where("not pending")
    cols = ("account_id", "date", "authorized_date", "amount", "name", "merchant_name", "pfc_primary", "pfc_detailed", *optional)
    last = cut_lineage(feed.groupBy("transaction_id").agg(F.max_by(F.struct(*cols), "feed_seq").alias("x")).select(F.col("transaction_id").alias("id"), "x.*").withColumnRenamed("account_id", "feed_account"))
    accounts, feed_accounts = table(spark, folder, "accounts"), table(spark, folder, "plaid_accounts")
    left = ledger.select("id", "account", "date", "posted_date", F.abs("amount").alias("amount"), "description", F.get_json_object("merchant", "$.name").alias("merchant"), "category", "confidence")
    if by_mask:
        pairs = reconcile.accounts_by_mask(accounts, feed_accounts)
        return left.join(pairs.select("account").distinct(), "account", "left_semi"), last.join(pairs, "feed_account").drop("feed_account")
    last = last.join(last.where("pending_transaction_id is not null").select(F.col("pending_transaction_id").alias("id")).distinct(), "id", "left_anti")
    pairs = reconcile.linked_accounts(accounts, feed_accounts, ledger, last).unionByName(reconcile.accounts_without_mask(accounts, feed_accounts))
    keys = feed_accounts.select(F.col("account_id").alias("feed_account"), reconcile.feed_kind().alias("kind"), "mask").join(pairs, "feed_account", "left")
    created = F.concat_ws("-", F.lit("new"), F.coalesce("kind", F.lit("checking")), F.coalesce("mask", F.lit("0000")))
    return left, last.join(cut_lineage(keys), "feed_account", "left").withColumn("account", F.coalesce("account", created)).withColumn("kind", F.coalesce("kind", F.lit("checking"))).drop("feed_account")


SIDES = """pairs AS (SELECT f.account_id AS feed_account, min(a.id) AS account FROM plaid_accounts f JOIN accounts a ON lower(a.account_type) = CASE WHEN f.type = 'credit' THEN 'credit' WHEN lower(f.subtype) = 'savings' THEN 'savings' ELSE 'checking' END
 AND replace(a.account_number_masked, '*', '') = f.mask GROUP BY 1),
l AS (SELECT t.id, t.account_id AS account, t.date, CAST(abs(t.amount) AS DOUBLE) AS amount FROM ledger_transactions t WHERE t.account_id IN (SELECT account FROM pairs)),
r AS (SELECT p.transaction_id AS id, pairs.account, p.date, CAST(abs(p.amount) AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY feed_seq DESC) AS n FROM plaid_transactions WHERE NOT pending) p JOIN pairs ON pairs.feed_account = p.account_id WHERE p.n = 1)"""


@query(f"""WITH {SIDES} SELECT l.id AS left_id, r.id AS right_id FROM l JOIN r ON r.account = l.account
WHERE abs(date_diff('day', l.date, r.date)) <= 3 OR l.amount = r.amount OR (l.amount <> 0 AND r.amount <> 0 AND abs(l.amount - r.amount) / ((abs(l.amount) + abs(r.amount)) / 2) <= 0.01::DOUBLE)""")
def reconcile_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.candidates(*sides(spark, folder, by_mask=True))


# What matched rows are, in SQL: accounts, both sides, pairs with their points, then one left row after the other takes the best right row left.
_BANK = lambda c: f"substr(regexp_replace(lower({c}), '[^a-z]', '', 'g'), 1, 5)"
_KIND = "CASE WHEN type = 'credit' THEN 'credit' WHEN lower(subtype) = 'savings' THEN 'savings' ELSE 'checking' END"
_LIKE = lambda x, y: f"CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN length({x}) = 0 OR length({y}) = 0 THEN 0.0::DOUBLE ELSE 1 - levenshtein({x}, {y}) / greatest(length({x}), length({y}))::DOUBLE END"
_TAKE = lambda name, edges: f"""{name}_e AS (SELECT account, left_id, l_date, list(right_id ORDER BY confidence DESC, r_date, right_id) AS wants FROM {edges} GROUP BY 1, 2, 3),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY l_date, left_id) AS k FROM {name}_e),
{name}_s AS (SELECT DISTINCT account, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::VARCHAR AS left_id, NULL::VARCHAR AS right_id FROM {name}_o
  UNION ALL SELECT o.account, o.k, list_concat(s.used, list_filter(o.wants, lambda x: NOT list_contains(s.used, x))[1:1]), o.left_id, list_filter(o.wants, lambda x: NOT list_contains(s.used, x))[1] FROM {name}_s s JOIN {name}_o o ON o.account = s.account AND o.k = s.k + 1),
{name} AS (SELECT left_id, right_id FROM {name}_s WHERE right_id IS NOT NULL)"""  # noqa: E731
MATCHED = f"""
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY feed_seq DESC) AS n FROM plaid_transactions) WHERE n = 1),
feed AS (SELECT * FROM last WHERE transaction_id NOT IN (SELECT pending_transaction_id FROM last WHERE pending_transaction_id IS NOT NULL)),
fk AS (SELECT account_id AS feed_account, {_KIND} AS kind, mask, {_BANK('institution_name')} AS feed_bank FROM plaid_accounts),
ak AS (SELECT id AS account, lower(account_type) AS kind, replace(account_number_masked, '*', '') AS mask, {_BANK('institution')} AS bank FROM accounts),
cand AS (SELECT feed_account, account, coalesce(bank = feed_bank AND bank <> '', false) AS same_bank FROM fk JOIN ak ON ak.kind = fk.kind AND ak.mask = fk.mask),
agree AS (SELECT c.feed_account, c.account, count(DISTINCT (abs(p.amount), p.amount < 0, p.date)) AS agree FROM cand c JOIN ledger_transactions a ON a.account_id = c.account
  JOIN feed p ON p.account_id = c.feed_account AND abs(p.amount) = abs(a.amount) AND (p.amount < 0) = starts_with(lower(trim(a.direction)), 'c') AND abs(date_diff('day', a.date, p.date)) <= 3 GROUP BY 1, 2),
linked AS (SELECT feed_account, account FROM (SELECT c.*, row_number() OVER (PARTITION BY feed_account ORDER BY same_bank DESC, coalesce(agree, 0) DESC, account) AS n FROM cand c LEFT JOIN agree USING (feed_account, account)) WHERE n = 1
  UNION ALL SELECT fk.feed_account, o.account FROM fk JOIN (SELECT bank, kind, min(account) AS account FROM ak WHERE bank <> '' GROUP BY 1, 2 HAVING count(*) = 1) o ON o.bank = fk.feed_bank AND o.kind = fk.kind WHERE coalesce(fk.mask, '') = ''),
l AS (SELECT id, account_id AS account, date, posted_date, CAST(abs(amount) AS DOUBLE) AS amount, description, json_extract_string(merchant, '$.name') AS merchant, category, confidence FROM ledger_transactions),
r AS (SELECT p.transaction_id AS id, coalesce(k.account, 'new-' || coalesce(fk.kind, 'checking') || '-' || coalesce(fk.mask, '0000')) AS account, coalesce(fk.kind, 'checking') AS kind, fk.mask, p.date, p.authorized_date, CAST(p.amount AS DOUBLE) AS amount, p.name, p.merchant_name, p.pfc_primary
  FROM feed p LEFT JOIN fk ON fk.feed_account = p.account_id LEFT JOIN linked k ON k.feed_account = p.account_id),
lt AS (SELECT *, lower(trim(coalesce(merchant, description))) AS l1, lower(trim(description)) AS l2 FROM l), rt AS (SELECT *, abs(amount) AS size, lower(trim(coalesce(merchant_name, name))) AS r1, lower(trim(name)) AS r2 FROM r),
pairs AS (SELECT lt.account, lt.id AS left_id, rt.id AS right_id, lt.date AS l_date, rt.date AS r_date, lt.amount AS x, rt.size AS y, coalesce(lt.merchant, lt.description) AS lm, coalesce(rt.merchant_name, rt.name) AS rm, l1, l2, r1, r2,
  lt.amount = rt.size AS same_amount, lt.amount = rt.size OR (lt.amount <> 0 AND rt.size <> 0 AND abs(lt.amount - rt.size) / ((lt.amount + rt.size) / 2) <= 0.01::DOUBLE) AS near_amount, lt.date = rt.date AS same_day, abs(date_diff('day', lt.date, rt.date)) <= 3 AS near_day
  FROM lt JOIN rt ON rt.account = lt.account),
liked AS (SELECT *, greatest({_LIKE('l1', 'r1')}, {_LIKE('l1', 'r2')}, {_LIKE('l2', 'r1')}, {_LIKE('l2', 'r2')}) AS alike FROM pairs WHERE near_amount OR near_day),
scored AS (SELECT *, CASE WHEN same_amount THEN 0.4 WHEN near_amount THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN same_day THEN 0.3 WHEN near_day THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN alike >= 0.9::DOUBLE THEN 0.3 WHEN alike >= 0.6::DOUBLE THEN 0.2 ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN same_amount AND same_day AND alike >= 0.9::DOUBLE THEN 'exact' WHEN near_amount AND near_day AND alike >= 0.6::DOUBLE THEN 'fuzzy' WHEN near_amount AND near_day THEN 'amount_date' ELSE 'amount_only' END AS match_type,
  concat_ws('; ', CASE WHEN NOT same_amount THEN 'Amount' || CASE WHEN near_amount THEN ': ' ELSE ' mismatch: ' END || format('{{:.2f}}', x) || ' / ' || format('{{:.2f}}', y) END,
   CASE WHEN NOT same_day THEN 'Date' || CASE WHEN near_day THEN ': ' ELSE ' mismatch: ' END || l_date || ' / ' || r_date END, CASE WHEN alike < 0.9::DOUBLE THEN 'Merchant' || CASE WHEN alike >= 0.6::DOUBLE THEN ': ' ELSE ' mismatch: ' END || lm || ' / ' || rm END) AS differences FROM liked),
edges AS MATERIALIZED (SELECT * FROM scored WHERE confidence >= 0.5::DOUBLE),
{_TAKE('exact', "(SELECT * FROM edges WHERE match_type = 'exact')")},
{_TAKE('rest', '(SELECT * FROM edges WHERE left_id NOT IN (SELECT left_id FROM exact) AND right_id NOT IN (SELECT right_id FROM exact))')},
found AS MATERIALIZED (SELECT e.left_id, e.right_id, e.confidence, e.match_type, e.differences FROM edges e JOIN (SELECT * FROM exact UNION ALL SELECT * FROM rest) m ON m.left_id = e.left_id AND m.right_id = e.right_id)"""

def _matched(spark: SparkSession, folder: str, noted: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides whole, and their matches; noted: with what differs."""
    left, right = (cut_lineage(x) for x in sides(spark, folder))
    return left, right, cut_lineage(reconcile.matches(left, right, noted=noted))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("differences", F.array_join("differences", "; "))


@query(f"WITH RECURSIVE {MATCHED} SELECT * FROM found")
def reconcile_matches(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_matched(spark, folder)[2])


@query(f"""WITH RECURSIVE {MATCHED}, a AS (SELECT count(*) AS total_left, sum(CAST(amount AS DECIMAL(18,2))) AS amount_left FROM l), b AS (SELECT count(*) AS total_right, sum(CAST(abs(amount) AS DECIMAL(18,2))) AS amount_right FROM r),
m AS (SELECT count(*) AS matched, count(*) FILTER (match_type = 'exact') AS exact, count(*) FILTER (match_type = 'fuzzy') AS fuzzy, count(*) FILTER (match_type = 'amount_date') AS amount_date, count(*) FILTER (match_type = 'amount_only') AS amount_only FROM found)
SELECT m.*, total_left, CAST(amount_left AS DOUBLE) AS amount_left, total_right, CAST(amount_right AS DOUBLE) AS amount_right, matched / total_left::DOUBLE AS match_rate, CAST(amount_left - amount_right AS DOUBLE) AS amount_difference FROM m, a, b""")
def reconcile_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.summary(*_matched(spark, folder, noted=False))


@query(f"WITH RECURSIVE {MATCHED} SELECT match_type, count(*) AS matches, round(avg(confidence), 6) AS mean_confidence FROM found GROUP BY 1")
def match_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(spark, folder)[2].groupBy("match_type").agg(F.count("*").alias("matches"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"WITH RECURSIVE {MATCHED} SELECT id, account, date, name FROM r WHERE id NOT IN (SELECT right_id FROM found)")
def plaid_unmatched_anti(spark: SparkSession, folder: str) -> DataFrame:
    _, right, found = _matched(spark, folder)
    return reconcile.unmatched(right, found, "right").select("id", "account", "date", "name")


_MAPPED = "CASE pfc_primary " + " ".join(f"WHEN '{r[0]}' THEN '{r[1]}'" for r in entries(FEED_CATEGORIES, 4)) + " END"


@query(f"""WITH RECURSIVE {MATCHED}, m AS (SELECT *, {_MAPPED} AS mapped FROM r), x AS (SELECT l.*, m.id AS right_id, m.merchant_name, m.authorized_date, m.mapped, m.id IS NOT NULL AND 0.7::DOUBLE > coalesce(l.confidence, 0) AS better FROM l LEFT JOIN found f ON f.left_id = l.id LEFT JOIN m ON m.id = f.right_id)
SELECT id, account, date, amount, description, CASE WHEN better THEN coalesce(mapped, 'Uncategorized') ELSE category END AS category, CASE WHEN better THEN 0.7::DOUBLE ELSE confidence END AS confidence, merchant_name AS feed_merchant, coalesce(authorized_date, posted_date) AS posted_date,
  CASE WHEN right_id IS NULL THEN 'ledger' ELSE 'both' END AS origin, NULL AS statement_key, NULL AS period_label FROM x
UNION ALL SELECT 'plaid_' || id, account, date, amount, name, coalesce(mapped, 'Uncategorized'), 0.9::DOUBLE, coalesce(merchant_name, name), coalesce(authorized_date, date), 'feed', 'PLAID-' || kind || '-' || coalesce(mask, '0000') || '-' || strftime(date, '%Y-%m'), 'Plaid ' || kind || ' ' || coalesce(mask, '')
FROM m WHERE id NOT IN (SELECT right_id FROM found)""")
def merge_union(spark: SparkSession, folder: str) -> DataFrame:
    """Every ledger row once, with its match, and every feed row without one."""
    left, right, found = _matched(spark, folder, noted=False)
    return reconcile.merged(left, right, found, classify.feed_category(F.col("pfc_primary"), F.lit(None).cast("string")))


_CREATED = "created AS (SELECT account, min(kind) AS kind, min(coalesce(mask, '0000')) AS mask, min(date) AS start, max(date) AS \"end\", count(*) AS transactions FROM r WHERE id NOT IN (SELECT right_id FROM found) AND account NOT IN (SELECT id FROM accounts) GROUP BY 1)"


@query(f"WITH RECURSIVE {MATCHED}, {_CREATED} SELECT * FROM created")
def merge_accounts_created(spark: SparkSession, folder: str) -> DataFrame:
    """The accounts that feed rows without a ledger account need."""
    _, right, found = _matched(spark, folder)
    return reconcile.created_accounts(right, found, table(spark, folder, "accounts").select(F.col("id").alias("account")))


@query(f"""WITH RECURSIVE {MATCHED}, {_CREATED}, c AS (SELECT (SELECT count(*) FROM l) AS total_left, (SELECT count(*) FROM r) AS total_right, (SELECT count(*) FROM found) AS updated, (SELECT count(*) FROM created) AS accounts_created)
SELECT total_left, total_right, updated, total_right - updated AS added, accounts_created, total_left - updated AS unmatched_left, round(updated / total_left::DOUBLE, 6) AS match_rate FROM c""")
def merge_stats(spark: SparkSession, folder: str) -> DataFrame:
    left, right, found = _matched(spark, folder, noted=False)
    return reconcile.merge_stats(left, right, found, table(spark, folder, "accounts").select(F.col("id").alias("account")))


@query(f"""WITH RECURSIVE {MATCHED} SELECT l.id, l.account, l.date, l.amount, coalesce(r.merchant_name, r.name, l.merchant) AS merchant, r.id AS feed_id, f.match_type, f.confidence, f.differences FROM l LEFT JOIN found f ON f.left_id = l.id LEFT JOIN r ON r.id = f.right_id""")
def enrich_with_feed(spark: SparkSession, folder: str) -> DataFrame:
    """All ledger rows, the feed's merchant first."""
    return _flat(reconcile.by_strategy(*_matched(spark, folder), "plaid-primary"))


@query(f"""WITH RECURSIVE {MATCHED} SELECT l.id, l.account, l.date, l.amount, l.merchant, r.id AS feed_id, f.match_type, f.confidence, f.differences FROM l LEFT JOIN found f ON f.left_id = l.id LEFT JOIN r ON r.id = f.right_id
UNION ALL SELECT 'plaid_' || id, account, date, amount, coalesce(merchant_name, name), id, NULL, NULL, NULL FROM r WHERE id NOT IN (SELECT right_id FROM found)""")
def enrich_union(spark: SparkSession, folder: str) -> DataFrame:
    """All ledger rows with their matches, and the feed's rows without one."""
    return _flat(reconcile.by_strategy(*_matched(spark, folder), "union"))


@query(f"""WITH RECURSIVE {MATCHED} SELECT f.left_id, f.right_id AS transaction_id, f.confidence AS match_confidence, f.match_type, f.differences, p.merchant_name, p.city, p.region AS state, p.pfc_primary AS "primary", CASE WHEN p.pfc_primary IS NOT NULL THEN p.pfc_detailed END AS detailed
FROM found f JOIN last p ON p.transaction_id = f.right_id""")
def match_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """What each match says about its ledger row, its parts as columns."""
    _, right, found = _matched(spark, folder)
    p = reconcile.match_payloads(right, found)
    return p.select("left_id", F.col("payload.transactionId").alias("transaction_id"), F.col("payload.matchConfidence").alias("match_confidence"), F.col("payload.matchType").alias("match_type"), F.array_join("payload.differences", "; ").alias("differences"),
                    F.col("payload.merchantName").alias("merchant_name"), "payload.location.city", "payload.location.state", "payload.category.primary", "payload.category.detailed")


@query(f"""WITH RECURSIVE {MATCHED}, s AS (SELECT (SELECT count(*) FROM found) AS m, (SELECT count(*) FROM l) AS n, (SELECT count(*) FROM r) AS k, (SELECT CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) FROM l) AS a, (SELECT CAST(sum(CAST(abs(amount) AS DECIMAL(18,2))) AS DOUBLE) FROM r) AS b)
SELECT 0 AS place, 'Added ' || (k - m) || ' unmatched feed rows' AS warning FROM s UNION ALL SELECT 1, format('Low match rate: {{:.1f}}%', 100.0::DOUBLE * m / n) FROM s WHERE m / n::DOUBLE < 0.5
UNION ALL SELECT 2, format('Significant amount difference: {{:.2f}} ({{:.1f}}%)', abs(round(a - b, 2)), abs(round(a - b, 2)) / a * 100) FROM s WHERE abs(a - b) / a > 0.1""")
def enrich_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """What a union with the feed should be warned of."""
    left, right, found = _matched(spark, folder, noted=False)
    s = reconcile.summary(left, right, found)
    return reconcile.warnings(s, F.col("total_right") - F.col("matched"))


@query("""WITH k AS (SELECT f.account_id AS feed_account, min(a.id) AS account FROM plaid_accounts f JOIN accounts a ON lower(a.account_type) = CASE WHEN f.type = 'credit' THEN 'credit' WHEN lower(f.subtype) = 'savings' THEN 'savings' ELSE 'checking' END
AND replace(a.account_number_masked, '*', '') = f.mask GROUP BY 1) SELECT * FROM k""")
def account_links_by_mask(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile.accounts_by_mask(table(spark, folder, "accounts"), table(spark, folder, "plaid_accounts"))


@query("""SELECT p.feed_seq, CAST(abs(p.amount) AS DOUBLE) AS amount, CASE WHEN p.amount > 0 THEN 'debit' ELSE 'credit' END AS direction, p.name AS description, coalesce(p.merchant_name, p.name) AS merchant, coalesce(p.authorized_date, p.date) AS posted_date,
CASE lower(p.payment_channel) WHEN 'online' THEN 'ONLINE_BANKING_TRANSFER' WHEN 'in store' THEN 'CHECKCARD' ELSE 'OTHER' END AS channel,
upper(CASE WHEN f.type = 'credit' THEN 'credit' WHEN lower(f.subtype) = 'savings' THEN 'savings' ELSE 'checking' END) || '-' || coalesce(f.mask, '0000') || '-' || strftime(p.date, '%Y%m') || '01-' || strftime(last_day(p.date), '%Y%m%d') AS statement_key,
'tx_' || substr(sha256(p.transaction_id || p.account_id || CAST(p.date AS VARCHAR) || CAST(p.amount AS VARCHAR)), 1, 24) AS transaction_key FROM plaid_transactions p JOIN plaid_accounts f ON f.account_id = p.account_id""")
def feed_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Feed rows in the ledger's terms; rows of unknown accounts are left out. A zero amount is a credit."""
    kind = F.when(F.col("type") == "credit", "credit").when(F.lower("subtype") == "savings", "savings").otherwise("checking")
    f = table(spark, folder, "plaid_accounts").select("account_id", kind.alias("kind"), F.coalesce("mask", F.lit("0000")).alias("mask"))
    p = table(spark, folder, "plaid_transactions").join(f, "account_id")
    channel = F.when(F.lower("payment_channel") == "online", "ONLINE_BANKING_TRANSFER").when(F.lower("payment_channel") == "in store", "CHECKCARD").otherwise("OTHER")
    period = F.concat(F.date_format("date", "yyyyMM"), F.lit("01-"), F.date_format(F.last_day("date"), "yyyyMMdd"))
    key = F.concat(F.lit("tx_"), F.substring(F.sha2(F.concat("transaction_id", "account_id", F.col("date").cast("string"), F.col("amount").cast("string")), 256), 1, 24))
    return p.select(
        "feed_seq", F.abs("amount").cast("double").alias("amount"), F.when(F.col("amount") > 0, "debit").otherwise("credit").alias("direction"), F.col("name").alias("description"), F.coalesce("merchant_name", "name").alias("merchant"),
        F.coalesce("authorized_date", "date").alias("posted_date"), channel.alias("channel"), F.concat_ws("-", F.upper("kind"), "mask", period).alias("statement_key"), key.alias("transaction_key"),
    )
