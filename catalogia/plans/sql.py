"""The adapter's rules as SQL, for the oracle queries. Money is in integers: cents times 10000 (a millionth of the currency)."""

DIGIT = "(10 - list_sum(list_transform(range(12), lambda i: substr({b}, (12 - i)::INT, 1)::INT * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10"
BODY = "('8' || lpad({k}::VARCHAR, 11, '0'))"


def gtin(k: str) -> str:
    b = BODY.format(k=k)
    return f"('0' || {b} || ({DIGIT.format(b=b)})::VARCHAR)"


SUP = """sup AS (SELECT s_suppkey, s_suppkey::VARCHAR AS supplier_id, s_name AS name, (10 + 10 * (s_suppkey % 5))::INT AS priority,
  CASE WHEN s_suppkey % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS last_import_status,
  CASE WHEN s_suppkey % 9 <> 0 THEN TIMESTAMP '2001-11-20' + to_days((s_suppkey % 12)::INT) END AS last_success_as_of FROM supplier)"""


def off(where: str = "TRUE", name: str = "off") -> str:
    return f"""{name} AS (SELECT l_suppkey || '|P' || l_partkey AS offer_id, l_suppkey, l_partkey, l_suppkey::VARCHAR AS supplier_id, 'P' || l_partkey AS sku, {gtin('l_partkey')} AS gtin,
  'g:' || {gtin('l_partkey')} AS product_id, p_name AS title, p_brand AS brand, p_type AS category_raw, CASE WHEN l_suppkey % 3 <> 0 THEN 'c:' || p_type END AS category_id, p_size, split_part(p_name, ' ', 1) AS color,
  round(l_extendedprice * 100)::HUGEINT * 10000 AS price6, CASE WHEN l_suppkey % 7 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE l_returnflag WHEN 'R' THEN 'gross' WHEN 'A' THEN 'net' ELSE 'unknown' END AS vat, round(l_tax * 100)::HUGEINT * 1000000 AS rate6,
  CASE WHEN l_linenumber <> 7 THEN l_quantity::INT END AS units, CASE WHEN l_linenumber % 3 = 0 THEN 5 END AS moq,
  CASE WHEN l_linestatus = 'O' THEN 'in_stock' WHEN l_quantity <= 10 THEN 'out_of_stock' ELSE 'unknown' END AS stock_status,
  CASE WHEN l_linestatus = 'O' THEN l_quantity::INT WHEN l_quantity <= 10 THEN 0 END AS stock_quantity,
  l_linenumber <> 6 AS active, l_shipdate AS source_as_of, 10 + 10 * (l_suppkey % 5) AS priority
  FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem WHERE {where}) JOIN part ON l_partkey = p_partkey WHERE rn = 1)"""


NET = "CASE vat WHEN 'net' THEN price6 WHEN 'gross' THEN (2 * price6 * 100000000 + 100000000 + rate6) // (2 * (100000000 + rate6)) END"
EV = f"""n6 AS (SELECT *, {NET} AS net6 FROM off),
ev AS (SELECT *, CASE WHEN units > 0 THEN (2 * net6 + units) // (2 * units) END AS unit6,
  concat_ws(',', CASE WHEN NOT active THEN 'inactive' END, CASE WHEN price6 = 0 THEN 'zero_price' END, CASE WHEN vat = 'unknown' THEN 'unknown_vat' END, CASE WHEN units IS NULL OR units = 0 THEN 'unknown_pack' END) AS reasons FROM n6)"""
#: A row for each product: the summary currency, its best and cheapest sold-out offers, and counts.
SUMMARY = """cur AS (SELECT product_id, currency, count(*) AS n FROM ev WHERE active AND reasons = '' GROUP BY ALL),
pick AS (SELECT product_id, first(currency ORDER BY n DESC, currency <> 'EUR', currency) AS currency, list_sort(list(currency)) AS all_c FROM cur GROUP BY product_id),
cmp AS (SELECT e.* FROM ev e JOIN pick p ON e.product_id = p.product_id AND e.currency = p.currency WHERE e.active AND e.reasons = ''),
bst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY unit6, coalesce(moq, 1), priority, offer_id) AS r FROM cmp WHERE stock_status <> 'out_of_stock') WHERE r = 1),
sld AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY unit6, coalesce(moq, 1), priority, offer_id) AS r FROM cmp WHERE stock_status = 'out_of_stock') WHERE r = 1),
cnt AS (SELECT product_id, count(*) FILTER (reasons = '') AS comparable_count, count(*) FILTER (reasons <> '') AS not_comparable_count FROM ev WHERE active GROUP BY product_id),
smy AS (SELECT c.product_id, p.currency, b.offer_id AS best_offer, (b.unit6 + 50) // 100 AS best_unit, s.offer_id AS sold_offer_any, s.unit6 AS sold6, b.unit6 AS best6, c.comparable_count, c.not_comparable_count,
  list_filter(p.all_c, lambda x: x <> p.currency) AS others
  FROM cnt c LEFT JOIN pick p USING (product_id) LEFT JOIN bst b USING (product_id) LEFT JOIN sld s USING (product_id))"""
GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split({t}, ' '), lambda w: w <> ''), lambda w: list_transform(range(length(w) + 1), lambda i: substr('  ' || w || ' ', (i + 1)::INT, 3)))))"
FOLD = "trim(regexp_replace(replace(lower(strip_accents({t})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
CHG = """chg AS (SELECT event_id, (event_id % 20)::VARCHAR AS run_id, (user_id % 10)::VARCHAR AS supplier_id, (user_id % 10) || '|P' || (event_id % 50) AS offer_id, 'p' || (event_id % 50) AS product_id,
  CASE event_type WHEN 'click' THEN 'price' WHEN 'view' THEN 'stock' WHEN 'error' THEN 'removed' ELSE 'availability' END AS change_type, CASE WHEN event_type = 'click' THEN round(value * 100)::BIGINT END AS pct100, ts AS created_at FROM events)"""
_ORDER = "priority, NOT active, source_as_of DESC, source_as_of, offer_id"
#: search (product_id, search_text): the distinct pieces of a product's search text in order; after off.
SEARCH = f"""pieces AS (
  SELECT product_id, 0 AS part, 0::BIGINT AS r, 0 AS i, CASE WHEN l_partkey % 50 = 0 THEN 'Special ' || title ELSE title END AS piece FROM off UNION ALL SELECT product_id, 0, 0, 1, brand FROM off UNION ALL
  SELECT product_id, 1, rn, i, [title, brand, sku, substr(gtin, 2), category_raw][i] FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY {_ORDER}) AS rn FROM off), range(1, 6) t(i) UNION ALL
  SELECT product_id, 2, 0, 0, gtin FROM off UNION ALL SELECT product_id, 2, 0, 0, substr(gtin, 2) FROM off),
first_pieces AS (SELECT product_id, piece, min((part, r, i)) AS pos FROM pieces GROUP BY ALL),
search AS (SELECT product_id, string_agg(piece, ' ' ORDER BY pos, piece) AS search_text FROM first_pieces GROUP BY product_id)"""
