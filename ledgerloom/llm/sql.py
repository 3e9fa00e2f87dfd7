"""SQL that gives the same rows as the queries of this subpackage, where SQL can."""

from __future__ import annotations

from ledgerloom.llm.survivor import MISSING_WORDS, UNCATEGORIZED

_WORDS = ", ".join(f"'{w}'" for w in MISSING_WORDS)
_TIDY = lambda c: rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
_KEY = lambda c: rf"regexp_replace(lower(upper({c})), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"

CLASSES = rf"""
k AS (SELECT id, account_id, date, abs(amount) AS a, lower(regexp_replace(direction, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS d, {_KEY('description')} AS t,
  array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(regexp_replace(description, '(?i)((CO[^\p{{L}}\p{{N}};|]*ID|DES|INDN|ID)[\s\p{{Z}}]*:)', '|\1', 'g'), '[;|]'), lambda x: {_KEY('x')}), lambda x: x <> '')), '~') AS f FROM ledger_transactions),
e AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.account_id = y.account_id AND x.date = y.date AND x.a = y.a AND x.d = y.d AND (x.t = y.t OR x.f = y.f) WHERE x.id <> y.id),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS id, least(a, min(b)) AS group_id FROM r GROUP BY a)
"""

_COUNT = lambda c: f"""(SELECT id, count(*) FILTER (v IS NOT NULL AND {_TIDY('v')} <> '' AND {_TIDY('v')} NOT IN ({_WORDS})) AS n FROM
  (SELECT id, json_extract_string({c}, '$."' || key || '"') AS v FROM (SELECT id, {c}, unnest(json_keys({c})) AS key FROM ledger_transactions WHERE {c} IS NOT NULL)) GROUP BY 1)"""  # noqa: E731

_TEXT = lambda c: f"""(SELECT id, count(*) AS n, string_agg(key || '=' || trim(regexp_replace(lower(v), '[\\s\\p{{Z}}]+', ' ', 'g')), '~' ORDER BY key) AS v FROM
  (SELECT id, key, json_extract_string({c}, '$."' || key || '"') AS v FROM (SELECT id, {c}, unnest(json_keys({c})) AS key FROM ledger_transactions WHERE {c} IS NOT NULL))
  WHERE v IS NOT NULL AND {_TIDY('v')} <> '' AND {_TIDY('v')} NOT IN ({_WORDS}) GROUP BY 1)"""  # noqa: E731
_HOLDS_CATEGORY = f"t.category IS NOT NULL AND {_TIDY('t.category')} <> '' AND {_TIDY('t.category')} NOT IN ({_WORDS}, {', '.join(f"'{x}'" for x in UNCATEGORIZED)})"

ORACLE: dict[str, str] = {
    "p4_members": f"""WITH RECURSIVE {CLASSES}, x AS (SELECT t.id, coalesce(g.group_id, t.id) AS representative FROM ledger_transactions t LEFT JOIN g ON g.id = t.id)
SELECT id, representative, count(*) OVER (PARTITION BY representative) AS copies FROM x""",
    "p5_survivors": f"""WITH RECURSIVE {CLASSES},
c AS (SELECT t.id, coalesce(g.group_id, t.id) AS group_id, g.group_id IS NOT NULL AS copied, CASE WHEN isnan(t.confidence) THEN NULL ELSE t.confidence END AS confidence, t.created_at,
  coalesce(nullif(lower(regexp_extract(t.rule_id, '^([A-Za-z]+)', 1)), ''), 'none') || CASE WHEN t.statement_db_id IS NULL THEN '' ELSE '+statement' END AS source,
  t.merchant, t.category, t.raw, coalesce(m.n, 0) AS mn, m.v AS mv, coalesce(w.n, 0) AS wn, w.v AS wv, CASE WHEN {_HOLDS_CATEGORY} THEN 1 ELSE 0 END AS cn, trim(regexp_replace(lower(t.category), '[\\s\\p{{Z}}]+', ' ', 'g')) AS cv
  FROM ledger_transactions t LEFT JOIN g ON g.id = t.id LEFT JOIN {_TEXT('merchant')} m ON m.id = t.id LEFT JOIN {_TEXT('raw')} w ON w.id = t.id),
s AS (SELECT *, max(created_at) OVER (PARTITION BY group_id) AS newest FROM c WHERE copied),
l AS (SELECT id, group_id, source, confidence, created_at, newest, 'merchant' AS f, mn AS held, mv AS v, merchant AS kept FROM s UNION ALL
  SELECT id, group_id, source, confidence, created_at, newest, 'category', cn, cv, category FROM s UNION ALL SELECT id, group_id, source, confidence, created_at, newest, 'raw', wn, wv, raw FROM s),
h AS (SELECT *, count(*) OVER (PARTITION BY group_id, f, v) AS same FROM l WHERE held > 0),
tr AS (SELECT source, (count(*) FILTER (same > 1) + 1) / CAST(count(*) + 2 AS DOUBLE) AS trust FROM h GROUP BY 1),
vo AS (SELECT h.*, round(sum(trust * held * power(2.0, -(epoch_us(newest) - epoch_us(created_at)) / 1e6 / 86400 / 180)) OVER (PARTITION BY group_id, f, v), 6) AS votes FROM h JOIN tr USING (source)),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id, f, v ORDER BY held DESC, coalesce(confidence, -1) DESC, created_at DESC, id) AS q FROM vo),
p AS (SELECT *, row_number() OVER (PARTITION BY group_id, f ORDER BY votes DESC, held DESC, coalesce(confidence, -1) DESC, created_at DESC, id) AS p FROM o WHERE q = 1)
SELECT g2.group_id, (SELECT kept FROM p WHERE p.p = 1 AND p.group_id = g2.group_id AND f = 'merchant') AS merchant, (SELECT kept FROM p WHERE p.p = 1 AND p.group_id = g2.group_id AND f = 'category') AS category,
  (SELECT kept FROM p WHERE p.p = 1 AND p.group_id = g2.group_id AND f = 'raw') AS raw FROM (SELECT DISTINCT group_id FROM s) g2
UNION ALL SELECT id, CASE WHEN mn > 0 THEN merchant END, CASE WHEN cn > 0 THEN category END, CASE WHEN wn > 0 THEN raw END FROM c WHERE NOT copied""",
    "p4_found": f"WITH RECURSIVE {CLASSES} SELECT DISTINCT a AS id_a, b AS id_b FROM r WHERE a < b",
    "p4_lines": f"WITH RECURSIVE {CLASSES} SELECT coalesce(g.group_id, t.id) AS id, count(*) AS copies FROM ledger_transactions t LEFT JOIN g ON g.id = t.id GROUP BY 1",
    "p5_found": f"""WITH RECURSIVE {CLASSES},
c AS (SELECT t.id, g.group_id, t.confidence, t.created_at, coalesce(m.n, 0) AS m, coalesce(w.n, 0) AS w,
  CASE WHEN t.category IS NOT NULL AND {_TIDY('t.category')} <> '' AND {_TIDY('t.category')} NOT IN ({_WORDS}, {', '.join(f"'{x}'" for x in UNCATEGORIZED)}) THEN 1 ELSE 0 END AS c
  FROM ledger_transactions t JOIN g ON g.id = t.id LEFT JOIN {_COUNT('merchant')} m ON m.id = t.id LEFT JOIN {_COUNT('raw')} w ON w.id = t.id),
l AS (SELECT group_id, id, confidence, created_at, 'merchant' AS field_name, m AS n FROM c UNION ALL SELECT group_id, id, confidence, created_at, 'category', c FROM c UNION ALL SELECT group_id, id, confidence, created_at, 'raw', w FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY n DESC, coalesce(confidence, -1) DESC, created_at DESC, id) AS p FROM l WHERE n > 0)
SELECT group_id, field_name, id AS source_id FROM o WHERE p = 1""",
}
