"""Queries for outcomes of imported rows, mapped details, issue pages, duplicate suggestions, the change export and missing embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogia.operators import apply, changes, normalize, suggest, vectors
from catalogia.plans import adapter as A, sql as S
from catalogia.plans.queries import query

T = "1997-01-01"


@query(
    f"""WITH {S.off(f"l_shipdate < TIMESTAMP '{T}'", 'a')},
n AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS row_number, l_shipdate, l_linenumber = 5 AS bad,
  CASE WHEN l_linenumber <> 7 THEN 'P' || l_partkey END AS sku, 'h' || (l_quantity::INT % 3) AS h FROM lineitem),
j AS (SELECT n.*, a.offer_id, a.source_as_of, a.active FROM n LEFT JOIN a ON a.l_suppkey = n.l_suppkey AND a.sku = n.sku),
c AS (SELECT *, CASE WHEN offer_id IS NOT NULL THEN min(row_number) OVER w ELSE min(CASE WHEN NOT bad THEN row_number END) OVER w END AS claim
  FROM j WINDOW w AS (PARTITION BY l_suppkey, sku))
SELECT l_suppkey::VARCHAR AS supplier_id, row_number, sku, CASE WHEN sku IS NULL THEN 'error' WHEN row_number > claim THEN 'duplicate' WHEN bad THEN 'error'
  WHEN source_as_of > l_shipdate THEN 'outdated' WHEN active AND h = 'h0' THEN 'unchanged' WHEN offer_id IS NULL THEN 'create' ELSE 'update' END AS outcome FROM c"""
)
def d2_d4_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """All lines as one list a supplier, with repeated skus, against the offers of before: duplicates, rows older than what is stored, unchanged ones."""
    li = A.read(spark, d, "lineitem")
    n = li.select(
        F.lit("r").alias("run_id"),
        F.col("l_suppkey").cast("string").alias("supplier_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_number"),
        F.col("l_shipdate").cast("timestamp").alias("as_of"),
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("sku"),
        F.when(F.col("l_linenumber") != 5, F.struct("l_quantity")).alias("offer"),
        F.concat(F.lit("h"), (F.col("l_quantity").cast("int") % 3).cast("string")).alias("row_hash"),
    )
    stored = A.offers(spark, d, before=T).withColumn("row_hash", F.lit("h0"))
    return apply.classify(apply.resolve_duplicate_skus(apply.match_existing(n, stored))).select("supplier_id", "row_number", "sku", "outcome")


@query(
    """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 5 <> 1 THEN '10:6.5000' END, CASE WHEN p_partkey % 5 <> 2 THEN '100:5.2500' END) AS tiers,
  concat_ws(';', 'color=rosso', 'size=' || p_size, CASE WHEN p_partkey % 3 = 0 THEN 'material=' || lower(p_type) END) AS attributes,
  'http://img/' || (p_partkey % 100) || CASE WHEN p_partkey % 3 = 2 THEN ',http://img/b' || p_partkey ELSE '' END AS urls,
  concat_ws(',', CASE WHEN p_partkey % 5 = 1 THEN 'invalid_tier_price' END, CASE WHEN p_partkey % 3 = 1 THEN 'invalid_image_url' END) AS codes,
  p_partkey % 4 IN (1, 2) AS changed FROM part"""
)
def c5_c8_mapped_details(spark: SparkSession, d: str) -> DataFrame:
    """Price tiers, attributes and pictures of each part's row, and whether a second row of it has another fingerprint (not for spaces around a barcode)."""
    k, second = F.col("p_partkey"), F.col("version") == 1
    ean = F.substring(A.gtin_of(k), 2, 13)
    cells = {
        "sku": F.concat(F.lit("P"), k.cast("string")),
        "name": F.col("p_name"),
        "ean": F.when(second & (k % 4 == 0), F.concat(F.lit(" "), ean, F.lit("  "))).otherwise(ean),
        "price": F.when(second & (k % 4 == 1), "8").otherwise("7"),
        "color": F.when(second & (k % 4 == 2), "verde").otherwise("rosso"),
        "size": F.col("p_size").cast("string"),
        "material": F.when(k % 3 == 0, F.lower("p_type")).otherwise(" "),
        "from 10": F.when(k % 5 == 1, "0").otherwise("6.5"),
        "from 100": F.when(k % 5 == 2, "").otherwise("5.25"),
        "picture": F.concat(F.lit("http://img/"), (k % 100).cast("string")),
        "more": F.when(k % 3 == 0, F.concat(F.lit("http://img/"), (k % 100).cast("string"))).when(k % 3 == 1, "ftp://x").otherwise(F.concat(F.lit("http://img/b"), k.cast("string"))),
    }
    none = lambda t: F.lit(None).cast(t)
    rows = A.parts(spark, d).withColumn("version", F.explode(F.array(F.lit(0), F.lit(1))))
    values = F.create_map(*(x for name, c in cells.items() for x in (F.lit(name), c)))
    staged = rows.select(F.lit("r").alias("run_id"), F.lit("1").alias("supplier_id"), (2 * k + F.col("version")).alias("row_number"), values.alias("values"), none("array<string>").alias("numeric"), none("array<string>").alias("formula"), none("map<string,string>").alias("links"))
    columns = {"sku": ["sku"], "title": ["name"], "barcode": ["ean"], "price": ["price"], "color": ["color"], "size": ["size"], "material": ["material"], "image_urls": ["picture", "more"]}
    fields = F.create_map(*(x for f, names in columns.items() for x in (F.lit(f), F.array(*map(F.lit, names)))))
    tiers = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(q).alias("min_qty")) for c, q in (("from 100", 100), ("from 10", 10))))
    usual = F.struct(F.lit("EUR").alias("currency"), F.lit("net").alias("vat_treatment"), none("decimal(5,2)").alias("vat_rate"), F.lit(1).alias("units_per_pack"), none("string").alias("sales_unit"))
    runs = spark.range(1).select(F.lit("r").alias("run_id"), F.lit("delta").alias("mode"), F.lit(A.NOW).cast("timestamp").alias("as_of"), F.lit(".").alias("decimal_separator"), F.struct(fields.alias("fields"), tiers.alias("tiers")).alias("mapping"), usual.alias("defaults"))
    n = normalize.normalize_rows(staged, runs)
    o = F.col("offer")
    told = n.select(
        F.floor(F.col("row_number") / 2).cast("long").alias("p_partkey"),
        "row_hash",
        F.struct(
            "row_number",
            F.array_join(F.transform(o["price_tiers"], lambda t: F.concat_ws(":", t["min_qty"].cast("string"), t["price"].cast("string"))), ",").alias("tiers"),
            F.array_join(F.transform(F.map_entries(o["attributes"]), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("attributes"),
            F.array_join(o["image_urls"], ",").alias("urls"),
            F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"),
        ).alias("first"),
    )
    g = told.groupBy("p_partkey").agg(F.min("first").alias("first"), (F.min("row_hash") != F.max("row_hash")).alias("changed"))
    return g.select("p_partkey", "first.tiers", "first.attributes", "first.urls", "first.codes", "changed")


@query(
    """SELECT p_partkey AS row_number, code FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'missing_sku' WHEN 1 THEN 'negative_price' ELSE 'zero_pack' END AS code,
  CASE p_partkey % 2 WHEN 0 THEN 'error' ELSE 'warning' END AS severity FROM part) WHERE severity = 'error' AND code = 'zero_pack' ORDER BY p_partkey LIMIT 100 OFFSET 20"""
)
def c10_issues_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of one kind of issue."""
    k = F.col("p_partkey")
    code = F.when(k % 3 == 0, "missing_sku").when(k % 3 == 1, "negative_price").otherwise("zero_pack")
    i = A.read(spark, d, "part").select(F.lit("r").alias("run_id"), k.alias("row_number"), F.when(k % 2 == 0, "error").otherwise("warning").alias("severity"), F.lit("x").alias("field"), code.alias("code"))
    return normalize.issues_page(i, "error", "zero_pack", 100, 20).select("row_number", "code")


@query(
    f"""WITH {S.off()}, {S.SEARCH}, n AS (SELECT s.product_id, o.k, CASE WHEN o.k % 50 = 0 THEN 'Special ' || o.title ELSE o.title END AS title, o.brand AS b, s.search_text FROM search s JOIN (SELECT DISTINCT product_id, l_partkey AS k, title, brand FROM off) o USING (product_id)),
p AS (SELECT product_id, k, title, 'brand' || regexp_extract(b, '([0-9]+)$', 1) AS brand, k % 100 AS asset, {S.FOLD.format(t='title')} AS t, {S.FOLD.format(t='search_text')} AS x FROM n),
g AS (SELECT *, {S.GRAMS.format(t='t')} AS gt, {S.GRAMS.format(t='x')} AS gx FROM p), u AS (SELECT DISTINCT t, gt FROM g),
s AS (SELECT u.t, g.product_id AS candidate_id, len(list_intersect(u.gt, g.gt))::DOUBLE / (len(u.gt) + len(g.gt) - len(list_intersect(u.gt, g.gt))) AS similarity FROM u JOIN g ON len(list_intersect(u.gt, g.gx))::DOUBLE / (len(u.gt) + len(g.gx) - len(list_intersect(u.gt, g.gx))) >= 0.3 WHERE g.k % 7 <> 0),
d AS (SELECT p.product_id, f.product_id AS other FROM p JOIN (SELECT title, min(product_id) AS product_id FROM p GROUP BY title) f USING (title) WHERE p.k % 100 = 1 AND p.product_id <> f.product_id),
c AS (SELECT n.product_id, f.product_id AS candidate_id, similarity, n.brand AS b1, f.brand AS b2, n.asset = f.asset AS same,
  row_number() OVER (PARTITION BY n.product_id ORDER BY similarity DESC, f.product_id) AS r
  FROM p n JOIN s ON s.t = n.t JOIN p f ON f.product_id = s.candidate_id
  WHERE n.k % 7 <> 0 AND n.k % 2 <> 0 AND length(n.title) >= 4 AND f.product_id <> n.product_id
  AND NOT EXISTS (SELECT 1 FROM d WHERE (d.product_id = n.product_id AND d.other = f.product_id) OR (d.other = n.product_id AND d.product_id = f.product_id)))
SELECT product_id, candidate_id, similarity AS score, 'title_similarity,same_brand' || CASE WHEN same THEN ',same_image' ELSE '' END AS reasons
FROM c WHERE r <= 5 AND similarity >= 0.6 AND (contains(b1, b2) OR contains(b2, b1))"""
)
def h1_h3_suggest_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for active products without a GTIN (odd parts) of the stored catalogue. Every hundredth part and the first of its title were decided to be different."""
    k = F.substring("product_id", 5, 11).cast("long")
    p = A.catalogue(spark, d)[0].filter("status = 'active'").select("product_id", k.alias("k"), F.when(k % 7 == 0, "archived").otherwise("active").alias("status"), "title", "brand", "search_text", (k % 2 == 0).alias("has_gtin"))
    first = p.groupBy("title").agg(F.min("product_id").alias("first"))
    decided = p.filter("k % 100 = 1").join(first, "title").filter("product_id <> first").select(F.least("product_id", "first").alias("a"), F.greatest("product_id", "first").alias("b"))
    links = p.select("product_id", F.concat(F.lit("a"), (F.col("k") % 100).cast("string")).alias("asset_id"))
    found = suggest.suggest_duplicates(suggest.suggestion_sources(p, p), p, decided, links)
    return found.select("product_id", "candidate_id", "score", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {S.CHG}, {S.off()}, c AS (SELECT c.*, o.sku, o.title, o.product_id AS current_id, s.s_name FROM chg c JOIN off o ON c.offer_id = o.offer_id LEFT JOIN supplier s ON s.s_suppkey::VARCHAR = c.supplier_id
  ORDER BY c.created_at DESC, c.offer_id, c.change_type LIMIT 50000),
v AS (SELECT *, [CASE change_type WHEN 'stock' THEN (event_id % 7)::VARCHAR WHEN 'availability' THEN '(' || (event_id % 7) || ')' ELSE (event_id % 100) || ' EUR' END,
  CASE change_type WHEN 'stock' THEN (event_id % 5)::VARCHAR WHEN 'availability' THEN '(' || (event_id % 5) || ')' ELSE (event_id % 90) || ' EUR' END] AS w FROM c)
SELECT created_at::VARCHAR || ';' || coalesce(s_name, '') || ';' || sku || ';' || title || ';' || change_type || ';' || w[1] || ';' || w[2] || ';' || coalesce((pct100 / 100.0)::DECIMAL(9, 2)::VARCHAR, '') || ';' || current_id || ';' || run_id AS value FROM v"""
)
def j5_export_changes(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the change export."""
    return changes.changes_as_csv(A.changes(spark, d), A.suppliers(spark, d), A.offers(spark, d))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 4 <> 1")
def k9_missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Pictures whose vectors failed, wait, or were never asked for."""
    e = A.read(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("asset_id"), F.lit("m").alias("model_key"), F.when(F.col("vec_id") % 4 == 1, "done").when(F.col("vec_id") % 4 == 2, "failed").otherwise("pending").alias("status"))
    return vectors.missing_embeddings(e.select("vec_id", "asset_id"), e.filter("vec_id % 4 <> 3"), "m").select("vec_id")
