"""Queries of gap filling, imports, ranges of the feed and parsed statement text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import gaps, importing, positions, reconcile, validation
from ledgerloom.plans.reconciled import MATCHED
from ledgerloom.plans.registry import query
from ledgerloom.plans.reports import _A, _B, GAPS
from ledgerloom.sources import batch, statement_lines
from ledgerloom.sources.tables import table
from ledgerloom.session import cut_lineage

_LINKED = MATCHED.split("\nl AS (")[0].rstrip().rstrip(",")


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    """Feed rows of linked accounts as delivered last, under their ledger account, without pending rows that a posted one names."""
    feed, a, f = (table(spark, folder, n) for n in ("plaid_transactions", "accounts", "plaid_accounts"))
    cols = ("account_id", "date", "authorized_date", "amount", "name", "merchant_name", "pending_transaction_id")
    last = cut_lineage(feed.groupBy("transaction_id").agg(F.max_by(F.struct(*cols), "feed_seq").alias("x")).select(F.col("transaction_id").alias("id"), "x.*").withColumnRenamed("account_id", "feed_account"))
    last = last.join(last.where("pending_transaction_id is not null").select(F.col("pending_transaction_id").alias("id")).distinct(), "id", "left_anti")
    ledger = table(spark, folder, "ledger_transactions").withColumnRenamed("account_id", "account")
    pairs = reconcile.linked_accounts(a, f, ledger, last).unionByName(reconcile.accounts_without_mask(a, f))
    return cut_lineage(last.join(cut_lineage(pairs), "feed_account"))


def _gaps(spark: SparkSession, folder: str, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    day = lambda d: F.lit(d).cast("date")
    known = table(spark, folder, "statements").select(F.col("account_id").alias("account"), F.col("period_start").alias("start"), F.col("period_end").alias("end"))
    none = known.limit(0).withColumn("checked_at", F.lit(None).cast("timestamp"))
    open_ = gaps.open_gaps(known, none, day(_A), day(_B)).join(feed.select("account").distinct(), "account", "left_semi")
    return gaps.clamped(open_, feed.groupBy("account").agg(F.min("date").alias("earliest")))


_FILL = f"""{_LINKED}, r AS (SELECT p.transaction_id AS id, k.account, p.date, p.authorized_date, p.amount, p.name, p.merchant_name FROM feed p JOIN linked k ON k.feed_account = p.account_id),
{GAPS}, begun AS (SELECT account, min(date) AS earliest FROM r GROUP BY 1),
todo AS (SELECT account, greatest(gap_start, earliest) AS gap_start, gap_end FROM gaps JOIN begun ON account = account_id WHERE gap_end >= earliest)"""


@query(f"WITH {_FILL} SELECT id, account, date, name FROM r WHERE EXISTS (SELECT 1 FROM todo g WHERE g.account = r.account AND r.date BETWEEN g.gap_start AND g.gap_end)")
def gap_fill_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Feed rows on days that no statement of their account covers."""
    feed = _feed(spark, folder)
    return gaps.filled(_gaps(spark, folder, feed)[0], feed)[0].select("id", "account", "date", "name")


@query(f"""WITH {_FILL} SELECT account, gap_start, least(gap_end, CAST(earliest - 1 AS DATE)) AS gap_end FROM (SELECT account_id AS account, gap_start, gap_end, earliest FROM gaps JOIN begun ON account = account_id) WHERE gap_start < earliest
UNION ALL SELECT account, gap_start, gap_end FROM todo g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.account = g.account AND r.date BETWEEN g.gap_start AND g.gap_end)""")
def gap_checked_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Days that need not be asked for again: those before the feed begins, and gaps in which it has nothing."""
    feed = _feed(spark, folder)
    fetch, before = _gaps(spark, folder, feed)
    return before.unionByName(gaps.filled(fetch, feed)[1]).select("account", "gap_start", "gap_end")


@query(f"""WITH {_FILL} SELECT 'feed' AS user_id, account AS account_id, 'tx_' || substr(sha256(id || account || CAST(date AS VARCHAR) || CAST(amount AS VARCHAR)), 1, 24) AS transaction_id, date, coalesce(authorized_date, date) AS posted_date, CAST(CASE WHEN amount > 0 THEN -abs(amount) ELSE abs(amount) END AS DOUBLE) AS amount,
CASE WHEN amount > 0 THEN 'debit' ELSE 'credit' END AS direction, name AS description, coalesce(merchant_name, name) AS merchant FROM r WHERE EXISTS (SELECT 1 FROM todo g WHERE g.account = r.account AND r.date BETWEEN g.gap_start AND g.gap_end)
AND 'tx_' || substr(sha256(id || account || CAST(date AS VARCHAR) || CAST(amount AS VARCHAR)), 1, 24) NOT IN (SELECT transaction_id FROM ledger_transactions)""")
def gap_upload(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger rows that filling the gaps adds."""
    feed = _feed(spark, folder)
    rows, _ = gaps.filled(_gaps(spark, folder, feed)[0], feed)
    key = F.concat(F.lit("tx_"), F.substring(F.sha2(F.concat("id", "account", F.col("date").cast("string"), F.col("amount").cast("string")), 256), 1, 24))
    new = gaps.uploaded(rows, table(spark, folder, "ledger_transactions"), key, F.lit("feed"))
    return new.withColumn("amount", F.col("amount").cast("double"))


@query("SELECT feed_seq, transaction_id, account_id, date, CAST(amount AS DOUBLE) AS amount FROM plaid_transactions WHERE date BETWEEN DATE '2024-03-01' AND DATE '2024-05-31'")
def feed_by_range(spark: SparkSession, folder: str) -> DataFrame:
    """The feed's rows of a range of days; the range is pushed down to the scan."""
    day = lambda d: F.lit(d).cast("date")
    return table(spark, folder, "plaid_transactions").where(F.col("date").between(day("2024-03-01"), day("2024-05-31"))).select("feed_seq", "transaction_id", "account_id", "date", F.col("amount").cast("double").alias("amount"))


@query("""WITH s AS (SELECT s.*, a.institution, a.account_type, a.account_number_masked FROM statements s JOIN accounts a ON a.id = s.account_id), old AS (SELECT * FROM s WHERE period_start < DATE '2024-07-01'), new AS (SELECT * FROM s WHERE period_start >= DATE '2024-07-01'),
t AS (SELECT l.transaction_id, n.statement_id FROM ledger_transactions l JOIN new n ON n.id = l.statement_db_id)
SELECT 'accounts' AS part, count(*) AS created FROM (SELECT DISTINCT account_id FROM new WHERE account_id NOT IN (SELECT account_id FROM old)) UNION ALL SELECT 'statements', count(*) FROM new UNION ALL SELECT 'rows', count(*) FROM t UNION ALL SELECT 'links', count(*) FROM t""")
def import_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What an import of the statements from July 2024 on creates beside those before."""
    a, s, t = (table(spark, folder, n) for n in ("accounts", "statements", "ledger_transactions"))
    s = s.join(a.select(F.col("id").alias("account_id"), "institution", "account_type", "account_number_masked"), "account_id")
    late = F.col("period_start") >= F.lit("2024-07-01").cast("date")
    old, new = s.where(~late), s.where(late)
    stored_accounts = a.join(old.select(F.col("account_id").alias("id")).distinct(), "id", "left_semi")
    parsed = new.select(*importing.ACCOUNT_KEY, "statement_id", "period_start", "period_end")
    rows = t.join(new.select(F.col("id").alias("statement_db_id"), "statement_id"), "statement_db_id").select("user_id", "statement_id", "transaction_id", "date", "amount", "description")
    kept = t.join(old.select(F.col("id").alias("statement_db_id")), "statement_db_id", "left_semi")
    made = importing.imported(stored_accounts, old.select("id", *importing.STATEMENT_KEY), kept.select("id", "transaction_id"), parsed, rows)
    counts = [df.agg(F.lit(part).alias("part"), F.count("*").alias("created")) for part, df in made.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _printed(spark: SparkSession, folder: str) -> DataFrame:
    """Statements with rows, printed as lines of text: a file for each account, its statements one after the other."""
    s = table(spark, folder, "statements").where("period_start <= period_end and starting_balance >= 0 and ending_balance >= 0")
    a = table(spark, folder, "accounts").where("lower(account_type) = 'checking'").select(F.col("id").alias("account_id"), "account_number_masked")
    s = s.join(a, "account_id").withColumn("order", F.concat_ws("|", F.col("period_start").cast("string"), "id"))
    long_day, money = lambda c: F.date_format(c, "MMMM d, yyyy"), lambda c: F.format_number(c, 2)
    t = table(spark, folder, "ledger_transactions").where("statement_db_id is not null and amount <> 0").select(F.col("statement_db_id").alias("id"), "date", F.abs("amount").alias("size"), (F.lower(F.trim("direction")) == "credit").alias("credit"), F.col("id").alias("tx"))
    row = lambda credit: F.transform(F.array_sort(F.collect_list(F.when(F.col("credit") == credit, F.struct("date", "tx", "size")))), lambda r: F.concat(F.date_format(r["date"], "MM/dd/yy"), F.lit(" PAYMENT "), F.translate(r["tx"], "0123456789-", "ghijklmnopz"), F.lit(" "), money(r["size"])))
    rows = t.groupBy("id").agg(row(True).alias("ins"), row(False).alias("outs"))  # the rows of a statement
    text = F.concat(
        F.array(F.lit("Your Advantage Plus Banking"), F.concat(F.lit("for "), long_day("period_start"), F.lit(" to "), long_day("period_end")), F.concat(F.lit("Account number: 0000 0000 "), F.substring("account_number_masked", -4, 4)), F.concat(F.lit("Beginning balance on "), long_day("period_start"), F.lit(" $"), money("starting_balance")), F.lit("Deposits and other additions")),
        "ins", F.array(F.lit("Withdrawals and other subtractions")), "outs", F.array(F.lit("Daily ending balance"), F.concat(F.lit("Ending balance on "), long_day("period_end"), F.lit(" $"), money("ending_balance"))),
    )
    return s.join(rows, "id").select(F.concat("account_id", F.lit(".pdf")).alias("file"), F.dense_rank().over(_by_order()).alias("page"), F.posexplode(text).alias("line_index", "line"), "id")


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("account_id").orderBy("order")


_PRINTED = """s AS (SELECT s.*, a.account_number_masked, row_number() OVER (PARTITION BY s.account_id ORDER BY s.period_start, s.id) AS part FROM statements s JOIN accounts a ON a.id = s.account_id WHERE lower(a.account_type) = 'checking' AND period_start <= period_end AND starting_balance >= 0 AND ending_balance >= 0
  AND s.id IN (SELECT statement_db_id FROM ledger_transactions WHERE statement_db_id IS NOT NULL AND amount <> 0)),
t AS (SELECT s.*, t.date, t.amount, lower(trim(t.direction)) = 'credit' AS credit, t.date BETWEEN s.period_start AND s.period_end AS inside FROM s JOIN ledger_transactions t ON t.statement_db_id = s.id WHERE t.amount <> 0)"""


@query(f"""WITH {_PRINTED} SELECT account_id || '.pdf' AS source, CAST(part AS INT) AS part, '****' || right(any_value(account_number_masked), 4) AS account_number_masked, any_value(period_start) AS period_start, any_value(period_end) AS period_end, CAST(any_value(starting_balance) AS DOUBLE) AS starting_balance, CAST(any_value(ending_balance) AS DOUBLE) AS ending_balance,
CAST(coalesce(sum(abs(amount)) FILTER (inside AND credit), 0) AS DOUBLE) AS total_credits, CAST(coalesce(sum(abs(amount)) FILTER (inside AND NOT credit), 0) AS DOUBLE) AS total_debits, count(*) FILTER (inside) AS transaction_count FROM t GROUP BY account_id, part""")
def parsed_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Statements printed as text, several to a file, and read back."""
    s, _ = batch.parsed(cut_lineage(_printed(spark, folder).drop("id")))
    return s.select("source", "part", "account_number_masked", "period_start", "period_end", "starting_balance", "ending_balance", "total_credits", "total_debits", "transaction_count")


@query(f"""WITH {_PRINTED} SELECT account_id || '.pdf' AS source, CAST(part AS INT) AS part, date, CAST(CASE WHEN credit THEN abs(amount) ELSE -abs(amount) END AS DOUBLE) AS amount, CASE WHEN credit THEN 'deposits' ELSE 'withdrawals' END AS section FROM t WHERE inside""")
def parsed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of statements printed as text and read back."""
    _, r = batch.parsed(cut_lineage(_printed(spark, folder).drop("id")))
    return r.select("source", "part", "date", "amount", "section")


@query(f"""WITH {_PRINTED}, x AS (SELECT DISTINCT account_id, part FROM t) SELECT account_id || '.pdf' AS file, 'checking' AS kind, count(*) AS statements FROM x GROUP BY 1""")
def detected_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """What kind of account each printed file is of, and how many statements it holds."""
    lines = cut_lineage(_printed(spark, folder).drop("id"))
    kinds = statement_lines.headers(lines).select("file", "kind")
    parts = batch.segments(lines).groupBy(F.col("source").alias("file")).agg(F.count_distinct("part").alias("statements"))
    return kinds.join(parts, "file")


@query()
def snapshot_violations(spark: SparkSession, folder: str) -> DataFrame:
    """What breaks the schema in the documents of all runs."""
    return validation.violations(table(spark, folder, "parse_runs"), "id", "output_snapshot").withColumnRenamed("id", "run_id")


@query("""WITH h AS (SELECT o.o_custkey AS account_id, l.l_partkey AS security_id, sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS quantity, sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS value, sum(CAST(CAST(l.l_quantity AS DECIMAL(18,2)) * CAST(p.p_retailprice AS DECIMAL(18,2)) AS DECIMAL(18,2))) AS cost
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2)
SELECT h.account_id, c.c_name AS account, h.security_id, p.p_name AS security, CAST(quantity AS DOUBLE) AS quantity, CAST(value AS DOUBLE) AS value, CAST(cost AS DOUBLE) AS cost_basis, CAST(value - cost AS DOUBLE) AS gain, CASE WHEN cost > 0 THEN round(CAST(value - cost AS DOUBLE) / CAST(cost AS DOUBLE) * 100, 2) END AS gain_percent
FROM h LEFT JOIN part p ON p.p_partkey = h.security_id LEFT JOIN customer c ON c.c_custkey = h.account_id""")
def holdings_gain_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Holdings with their gains: parts stand for securities, customers for accounts, what they ordered for holdings."""
    item, order, part, customer = (table(spark, folder, n) for n in ("lineitem", "orders", "part", "customer"))
    money = lambda c: F.col(c).cast("decimal(18,2)")
    x = item.join(order, item["l_orderkey"] == order["o_orderkey"]).join(part, item["l_partkey"] == part["p_partkey"])
    cost = (money("l_quantity") * money("p_retailprice")).cast("decimal(18,2)")
    held = x.groupBy(F.col("o_custkey").alias("account_id"), F.col("l_partkey").alias("security_id")).agg(F.sum(money("l_quantity")).alias("quantity"), F.sum(money("l_extendedprice")).alias("value"), F.sum(cost).alias("cost_basis"))
    held = held.withColumn("exact", (F.col("value") - F.col("cost_basis")).cast("double")).withColumns({c: F.col(c).cast("double") for c in ("quantity", "value", "cost_basis")})
    securities = part.select(F.col("p_partkey").alias("security_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("ticker"))
    accounts = customer.select(F.col("c_custkey").alias("account_id"), F.col("c_name").alias("name"))
    gains = positions.holding_gains(held, securities, accounts)
    percent = F.when(F.col("cost_basis") > 0, F.round(F.col("exact") / F.col("cost_basis") * 100, 2))
    return gains.select("account_id", "account", "security_id", "security", "quantity", "value", "cost_basis", F.col("exact").alias("gain"), percent.alias("gain_percent"))
