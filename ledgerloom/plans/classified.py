"""Queries that apply the scalar and classifying functions to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import classify, scalars
from ledgerloom.functions.category_rules import FEED_CATEGORIES, OLDER_RULES, RULES, entries
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import table


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ledger_transactions")


def _direction():
    return F.lower(F.trim("direction"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


EVEN = r"regexp_replace(description, '[\p{Z}\t]', ' ', 'g')"


def _rules_sql() -> str:
    cases = "".join(f"WHEN regexp_matches(t, {_q(r[5])})" + (f" AND NOT regexp_matches(t, {_q(r[6])})" if r[6] else "") + f" THEN {i}\n" for i, r in enumerate(sorted(entries(RULES, 8), key=lambda r: int(r[1]))))
    rows = ", ".join(f"({i}, {_q(r[2])}, {_q(r[3])}, {float(r[4])}, {_q(r[0])})" for i, r in enumerate(sorted(entries(RULES, 8), key=lambda r: int(r[1]))))
    return f"""WITH l AS (SELECT id, lower(trim({EVEN})) AS t FROM ledger_transactions), p AS (SELECT id, CASE {cases} END AS i FROM l),
r(i, category, subcategory, confidence, rule_id) AS (VALUES {rows})
SELECT p.id, coalesce(r.category, 'Uncategorized') AS category, r.subcategory, coalesce(CAST(r.confidence AS DOUBLE), 0.5::DOUBLE) AS confidence, r.rule_id FROM p LEFT JOIN r ON r.i = p.i"""


def _older_sql() -> str:
    rules = entries(OLDER_RULES, 4)
    cases = "".join(f"WHEN regexp_matches(t, {_q(r[3])}) THEN {i}\n" for i, r in enumerate(rules))
    rows = ", ".join(f"({i}, {_q(r[0])}, {_q(r[1])}, {float(r[2])})" for i, r in enumerate(rules))
    return f"""WITH l AS (SELECT id, lower(trim({EVEN})) AS t FROM ledger_transactions), p AS (SELECT id, CASE {cases} END AS i FROM l),
r(i, category, subcategory, confidence) AS (VALUES {rows})
SELECT p.id, coalesce(r.category, 'Uncategorized') AS category, r.subcategory, coalesce(CAST(r.confidence AS DOUBLE), 0.5::DOUBLE) AS confidence FROM p LEFT JOIN r ON r.i = p.i"""


def _feed_sql() -> str:
    rows = ", ".join(f"({_q(r[0])}, {_q(r[1])}, {_q(r[2]) if r[2] else 'NULL'}, {float(r[3])})" for r in entries(FEED_CATEGORIES, 4))
    return f"""WITH r(k, category, subcategory, confidence) AS (VALUES {rows})
SELECT p.feed_seq, coalesce(d.category, m.category) AS category, CASE WHEN d.k IS NOT NULL THEN d.subcategory ELSE m.subcategory END AS subcategory, CAST(coalesce(d.confidence, m.confidence) AS DOUBLE) AS confidence
FROM plaid_transactions p LEFT JOIN r d ON d.k = p.pfc_detailed LEFT JOIN r m ON m.k = p.pfc_primary"""


def _channel_sql() -> str:
    cases = "".join(f"WHEN regexp_matches(t, {_q('(?i)' + p)}) THEN {_q(kind)}\n" for kind, _, p, _ in classify.CHANNELS)
    subs = "".join(f"WHEN regexp_matches(t, {_q('(?i)' + p)}) THEN {_q(sub) if sub and sub != 'person' else 'NULL'}\n" for _, sub, p, _ in classify.CHANNELS)
    return f"WITH l AS (SELECT id, trim({EVEN}) AS t FROM ledger_transactions) SELECT id, CASE {cases} ELSE 'OTHER' END AS channel, CASE {subs} END AS subtype FROM l"


def _reference_sql() -> str:
    cols = ", ".join(f"CASE WHEN channel IN ({', '.join(map(_q, kinds))}) THEN nullif(regexp_extract(u, {_q(p)}, 1), '') END AS {n}" for n, kinds, p in classify.REFERENCES)
    return f"WITH c AS ({_channel_sql()}), x AS (SELECT c.id, c.channel, {EVEN} AS u FROM c JOIN ledger_transactions l ON l.id = c.id) SELECT id, {cols} FROM x"


def _words_sql(types: tuple) -> str:
    return "".join("WHEN " + " OR ".join(f"contains(u, {_q(w)})" for w in words) + f" THEN {_q(n)}\n" for n, words in types)


@query(_rules_sql())
def categorize_v2(spark: SparkSession, folder: str) -> DataFrame:
    return classify.with_category(_ledger(spark, folder).select("id", "description"), "description").drop("description")


@query(_older_sql())
def categorize_v1(spark: SparkSession, folder: str) -> DataFrame:
    return classify.with_category(_ledger(spark, folder).select("id", "description"), "description", older=True).drop("description", "rule_id")


@query(_feed_sql())
def plaid_category_map(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "plaid_transactions")
    return t.select("feed_seq", classify.feed_category(F.col("pfc_primary"), F.col("pfc_detailed")).alias("c")).select("feed_seq", "c.*")


@query(_channel_sql())
def channel_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger(spark, folder).select("id", classify.channel(F.col("description")).alias("c")).select("id", F.col("c.type").alias("channel"), "c.subtype")


@query(_reference_sql())
def bank_reference(spark: SparkSession, folder: str) -> DataFrame:
    t = _ledger(spark, folder).withColumn("kind", classify.channel(F.col("description"))["type"])
    return t.select("id", classify.bank_reference(F.col("description"), F.col("kind")).alias("r")).select("id", "r.*")


def _merchant_sql() -> str:
    c = classify
    states = "|".join(c.STATES)
    slash, end = rf"\b([A-Z][A-Za-z\s]+)/({states})\b", rf"\b([A-Z][A-Za-z\s]+)\s+({states})\s*$"
    lead = r"(?i)^([A-Z][A-Z0-9\s&'.\-#]+?)(?:\s+\d|$)"
    text = f"trim({EVEN})"
    for prefix in c.LINE_PREFIXES:
        text = f"regexp_replace({text}, {_q('(?i)' + prefix)}, '', 'g')"
    text = f"trim(regexp_replace({text}, {_q('(?i)' + '|'.join(f'(?:{p})' for p in c.LINE_SUFFIXES))}, '', 'g'))"
    brands = "".join(f"WHEN contains(upper(name), {_q(k)}) THEN {_q(v)} " for k, v in c.BRANDS)
    networks = "".join(f"WHEN regexp_matches(u, {_q(p)}) THEN '{n}' " for n, p in c.NETWORKS)
    part = lambda group: f"CASE place WHEN 1 THEN regexp_extract(t, {_q(slash)}, {group}) WHEN 2 THEN regexp_extract(t, {_q(end)}, {group}) END"
    return rf"""WITH a AS (SELECT id, upper(description) AS u, {text} AS t FROM ledger_transactions),
b AS (SELECT *, CASE WHEN contains(t, '/') AND regexp_matches(t, {_q(slash)}) THEN 1 WHEN right(rtrim(t), 2) IN ({', '.join(map(_q, c.STATES))}) AND regexp_matches(t, {_q(end)}) THEN 2 ELSE 0 END AS place FROM a),
d AS (SELECT *, trim({part(1)}) AS city, {part(2)} AS state, nullif(regexp_extract(t, {_q(c.PHONE)}, 1), '') AS phone, trim(CASE place WHEN 1 THEN regexp_replace(t, {_q(slash)}, '', 'g') WHEN 2 THEN regexp_replace(t, {_q(end)}, '', 'g') ELSE t END) AS r FROM b),
e AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN r = '' THEN t ELSE r END, '\d{{2}}/\d{{2}}|\*+\d+', '', 'g'), '\s{{2,}}', ' ', 'g'), {_q(c.PHONE)}, '', 'g')) AS rest FROM d),
f AS (SELECT *, trim(regexp_extract(rest, {_q(lead)}, 1)) AS l, trim(regexp_replace(array_to_string(list_slice(regexp_split_to_array(rest, '\s+'), 1, 5), ' '), '[^A-Za-z0-9\s&''.\-#]', '', 'g')) AS w FROM e),
g AS (SELECT *, CASE WHEN length(l) > 2 THEN l WHEN length(w) > 2 THEN w END AS name FROM f)
SELECT id, city, state, phone, name, CASE WHEN name IS NULL THEN NULL {brands} ELSE array_to_string(list_transform(string_split(lower(regexp_replace(name, '\s+', ' ', 'g')), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ') END AS normalized_name,
regexp_matches(u, {_q(c.ONLINE)}) AS online, CASE {networks} END AS network FROM g"""


@query(_merchant_sql())
def merchant_extract(spark: SparkSession, folder: str) -> DataFrame:
    return classify.with_merchant(_ledger(spark, folder).select("id", "description"), "description").drop("description")


@query(f"""WITH l AS (SELECT id, upper(description) AS u, description, lower(trim(direction)) AS d FROM ledger_transactions)
SELECT id, CASE WHEN contains(u, 'CHECK') AND regexp_matches(description, '[0-9]') THEN 'Check' {_words_sql(classify.CSV_TYPES)} WHEN d = 'credit' THEN 'Credit' ELSE 'Debit' END AS csv_type FROM l""")
def csv_type(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger(spark, folder).select("id", classify.csv_type(F.col("description"), _direction()).alias("csv_type"))


@query(f"""WITH l AS (SELECT id, upper(description) AS u, lower(trim(direction)) AS d FROM ledger_transactions),
k AS (SELECT id, d, coalesce(nullif(regexp_extract(u, {_q(classify.OFX_CHECK)}, 1), ''), nullif(regexp_extract(u, {_q(classify.OFX_CHECK)}, 2), '')) AS check_number, u FROM l),
t AS (SELECT id, d, check_number, CASE WHEN check_number IS NOT NULL THEN 'CHECK' {_words_sql(classify.OFX_TYPES)} WHEN d = 'credit' THEN 'CREDIT' ELSE 'DEBIT' END AS y FROM k)
SELECT id, CASE WHEN y = 'FEE' AND d <> 'debit' THEN 'CREDIT' ELSE y END AS trntype, check_number FROM t""")
def ofx_trntype(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger(spark, folder).select("id", classify.ofx_type(F.col("description"), _direction()).alias("t")).select("id", F.col("t.type").alias("trntype"), "t.check_number")


@query(r"""SELECT id, 'tx_' || substr(sha256(concat_ws('|', coalesce(statement_db_id, ''), CAST(date AS VARCHAR), coalesce(CAST(posted_date AS VARCHAR), ''), lower(trim(direction)), CAST(amount AS VARCHAR),
upper(trim(regexp_replace(description, '[\p{Z}\s]+', ' ', 'g'))), '', coalesce(json_extract_string(raw, '$.page'), ''), upper(trim(regexp_replace(coalesce(json_extract_string(raw, '$.originalText'), ''), '[\p{Z}\s]+', ' ', 'g'))))), 1, 24) AS transaction_key FROM ledger_transactions""")
def transaction_id_hash(spark: SparkSession, folder: str) -> DataFrame:
    of = lambda k: F.get_json_object("raw", f"$.{k}")
    key = scalars.transaction_key(F.col("statement_db_id"), F.col("date"), F.col("posted_date"), _direction(), F.col("amount"), F.col("description"), F.lit(None).cast("string"), of("page"), of("originalText"))
    return _ledger(spark, folder).select("id", key.alias("transaction_key"))


@query("""SELECT s.id, regexp_replace(upper(trim(a.institution)), '\\s+', '_', 'g') || '-' || lower(trim(s.statement_kind)) || '-' || a.account_number_masked || '-' || s.period_start || '-' || s.period_end AS statement_key,
CASE WHEN strftime(s.period_start, '%Y-%m') = strftime(s.period_end, '%Y-%m') THEN strftime(s.period_start, '%Y-%m') ELSE s.period_start || '..' || s.period_end END || ' ' || regexp_replace(upper(trim(a.institution)), '\\s+', '_', 'g') || ' ' || upper(substr(s.statement_kind, 1, 1)) || lower(substr(s.statement_kind, 2)) AS period_label
FROM statements s JOIN accounts a ON a.id = s.account_id""")
def statement_keys(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "accounts").select(F.col("id").alias("account_id"), "institution", "account_number_masked")
    s = table(spark, folder, "statements").join(a, "account_id")
    i, k, m, x, y = (F.col(c) for c in ("institution", "statement_kind", "account_number_masked", "period_start", "period_end"))
    return s.select("id", scalars.statement_key(i, k, m, x, y).alias("statement_key"), scalars.period_label(i, k, x, y).alias("period_label"))


@query("SELECT id, CAST(amount AS DOUBLE) AS amount, true AS same FROM ledger_transactions")
def parse_amount_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts written as statements print them and read back."""
    a = F.col("amount").cast("double")
    parsed = scalars.parse_amount(F.when(a < 0, F.concat(F.lit("("), scalars.currency(F.abs(a)), F.lit(")"))).otherwise(scalars.currency(a)))
    return _ledger(spark, folder).select("id", parsed.alias("amount"), (parsed == a).alias("same"))


@query("SELECT id, date AS long_form, date AS short_form, date AS named_form FROM ledger_transactions")
def parse_us_date_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Days written in each printed form and read back."""
    year = F.year("date")
    forms = {"long_form": "M/d/yy", "short_form": "MM/dd", "named_form": "MMM d"}
    return _ledger(spark, folder).select("id", *[scalars.parse_us_date(F.date_format("date", f), year).alias(n) for n, f in forms.items()])
