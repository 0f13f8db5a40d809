"""Queries for pictures' upkeep, operational gauges, feeds, retention and the stream of offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogia.operators import apply, canonical, catalog, ops, suggest, vectors
from catalogia.plans import adapter as A, sql as S
from catalogia.plans.queries import query
from catalogia.sources import store
from catalogia.sources.scratch import folder, saved
from catalogia.streaming import streams

AT = "2024-01-30"
_N = "l_partkey % 100"


@query(f"SELECT p_partkey::VARCHAR AS query_id, 'g:' || {S.gtin('p_partkey')} AS product_id, {S.gtin('p_partkey')} AS gtin FROM part WHERE p_partkey % 3 < 2")
def k7_barcode_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A query for each part: with its code; with an unknown code before it; or with an unknown one alone."""
    k = F.col("p_partkey")
    mine, none = A.gtin_of(k), A.gtin_of(k + 50_000_000_000)
    codes = F.when(k % 3 == 0, F.array(mine)).when(k % 3 == 1, F.array(none, mine)).otherwise(F.array(none))
    return vectors.barcode_evidence(A.read(spark, d, "part").select(k.cast("string").alias("query_id"), codes.alias("codes")), A.identifiers(spark, d))


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources (one for each supplier and address, fetched when its newest offer came), links, which carry their offer, and offers."""
    o = saved(A.offers(spark, d).select("offer_id", "supplier_id", "product_id", "active", "source_as_of", "image_urls"), "picture-offers")
    i = A.images(o, ("supplier_id", "product_id", "active", "source_as_of"))
    s = i.groupBy("supplier_id", "url").agg(F.max("source_as_of").alias("fetched_at")).withColumns({"status": A.picture_status(F.col("url")), "checked_at": F.lit(None).cast("timestamp")})
    return s, i.select("offer_id", "supplier_id", "product_id", "active", "url"), o


@query(f"WITH {S.off()} SELECT supplier_id, 'http://img/' || {_N} AS url FROM off WHERE l_partkey % 10 <> 9 GROUP BY ALL HAVING bool_or(active) AND max(source_as_of) < TIMESTAMP '2001-06-01' - INTERVAL 20 HOUR")
def k10_images_due_recheck(spark: SparkSession, d: str) -> DataFrame:
    s, links, o = _sources(spark, d)
    return vectors.images_due_recheck(s, links, o, "2001-06-01").select("supplier_id", "url")


@query(
    f"""WITH {S.off()} SELECT offer_id, product_id, '{{"count":1,"images":[{{"url":"http://img/' || {_N} || '","sha256":"old' || {_N} || '"}}]}}' AS old_value, '{{"count":1,"images":[{{"url":"http://img/' || {_N} || '","sha256":"new' || {_N} || '"}}]}}' AS new_value
FROM off WHERE active AND l_partkey % 4 <> 0"""
)
def k11_image_replaced_changes(spark: SparkSession, d: str) -> DataFrame:
    """Three of four addresses hold another picture than before."""
    s, links, o = _sources(spark, d)
    n = F.regexp_extract("url", "([0-9]+)$", 1)
    checked = s.select("supplier_id", "url", F.concat(F.lit("old"), n).alias("old_sha"), F.when(n.cast("int") % 4 == 0, F.concat(F.lit("old"), n)).otherwise(F.concat(F.lit("new"), n)).alias("new_sha"))
    return vectors.image_replaced_changes(checked, links, o, "r", AT).select("offer_id", "product_id", "old_value", "new_value")


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("supplier_id").cast("long")
    return A.suppliers(spark, d).withColumns({
        "active": k % 5 != 0, "feed_enabled": k % 2 == 0, "feed_failures": (k % 6).cast("int"), "busy": k % 11 == 0, "feed_kind": F.lit("hourly"), "feed_time": F.lit("10:00"), "feed_zone": F.lit("UTC"),
        "feed_hours": (k % 24 + 1).cast("int"), "next_run_at": F.lit("2024-01-29").cast("timestamp") + F.make_dt_interval(hours=(k % 48).cast("int")),
    })


@query(
    f"""WITH {S.off()}, {S.SUP} SELECT (SELECT count(*) FROM off o JOIN sup s USING (supplier_id) WHERE o.active AND (o.source_as_of < TIMESTAMP '2001-12-01' - INTERVAL 168 HOUR OR (s.last_import_status = 'failed' AND TIMESTAMP '2001-11-01' > o.source_as_of))) AS stale_offers,
(SELECT count(*) FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '{AT}' - INTERVAL 7 DAY) AS failed_imports_7d, (SELECT count(*) FROM sup WHERE s_suppkey % 6 > 0) AS failed_feeds, (SELECT count(*) FROM sup WHERE s_suppkey % 2 = 0 AND s_suppkey % 48 < 23) AS overdue_feeds,
(SELECT count(*) FROM events WHERE ts >= TIMESTAMP '{AT}' - INTERVAL 24 HOUR) AS changes_24h, 0::BIGINT AS image_failures, (SELECT count(DISTINCT (supplier_id, {_N})) FROM off WHERE l_partkey % 10 = 9) AS images_pending"""
)
def l2_health_gauges(spark: SparkSession, d: str) -> DataFrame:
    s, _, o = _sources(spark, d)
    stale = catalog.stale_offers(o, A.suppliers(spark, d), A.NOW)
    runs = A.read(spark, d, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status"), F.col("ts").cast("timestamp").alias("created_at"))
    return ops.health_gauges(stale, runs, _feeds(spark, d), A.changes(spark, d), s, AT)


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_id % 4 <> 0")
def l6_expired_searches(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").select(F.col("event_id").alias("search_id"), F.col("ts").cast("timestamp").alias("expires_at"))
    return ops.expired_searches(e, e.filter("search_id % 4 = 0"), "2024-01-15").select(F.col("search_id").alias("event_id"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 6 HOUR")
def l6_stalled_images(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "pending").otherwise("fetched").alias("status"), F.col("ts").cast("timestamp").alias("requested_at"))
    return ops.stalled_images(e, "2024-01-15").select("event_id")


@query("SELECT s_suppkey::VARCHAR AS supplier_id FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0 AND s_suppkey % 48 <= 24 ORDER BY s_suppkey % 48, s_suppkey::VARCHAR LIMIT 50")
def l7_due_feeds(spark: SparkSession, d: str) -> DataFrame:
    return ops.due_feeds(_feeds(spark, d), AT).select("supplier_id")


@query(f"SELECT s_suppkey::VARCHAR AS supplier_id, TIMESTAMP '{AT}' + to_minutes(CASE WHEN s_suppkey % 11 = 0 THEN 15 WHEN s_suppkey % 6 BETWEEN 1 AND 3 THEN 30 * (s_suppkey % 6) ELSE 60 * (s_suppkey % 24 + 1) END) AS next_run_at FROM supplier")
def l7_feed_backoff(spark: SparkSession, d: str) -> DataFrame:
    return ops.reschedule(_feeds(spark, d), AT).select("supplier_id", F.col("next_run_at").cast("timestamp_ntz").alias("next_run_at"))


@query(
    """WITH r AS (SELECT l_suppkey::VARCHAR AS s, 'P' || l_partkey AS p, l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS t, round(l_extendedprice * 100)::BIGINT AS price, l_linestatus AS st, l_quantity::INT AS q FROM lineitem),
m AS (SELECT *, max(t) OVER (PARTITION BY s, p ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM r),
k AS (SELECT *, lag(seq) OVER w AS ls, lag(price) OVER w AS lp, lag(st) OVER w AS lst, lag(q) OVER w AS lq FROM m WHERE newest IS NULL OR t >= newest WINDOW w AS (PARTITION BY s, p ORDER BY seq))
SELECT s AS supplier_id, p AS supplier_sku, 'new_offer' AS change_type, t AS as_of FROM k WHERE ls IS NULL UNION ALL SELECT s, p, 'price', t FROM k WHERE ls IS NOT NULL AND price <> lp
UNION ALL SELECT s, p, 'availability', t FROM k WHERE ls IS NOT NULL AND st <> lst UNION ALL SELECT s, p, 'stock', t FROM k WHERE ls IS NOT NULL AND st = lst AND q <> lq"""
)
def l9_stream_offer_changes(spark: SparkSession, d: str) -> DataFrame:
    """All lines as one stream of offers, in the order of their orders; the changes are written as they come and read again."""
    schema = A.read(spark, d, "lineitem").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/lineitem.parque[t]").select(
        F.col("l_suppkey").cast("string").alias("supplier_id"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("supplier_sku"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_shipdate").cast("timestamp").alias("as_of"),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string").alias("price"), F.lit("EUR").alias("currency"), F.col("l_linestatus").alias("stock_status"), F.col("l_quantity").cast("int").alias("stock_quantity"),
    )
    # A file source takes a folder or a pattern, not one file: hence the pattern above.
    root = folder(spark, "offer-changes")
    streams.new_offer_store(spark, root)
    streams.stream_offer_changes(rows, root, folder(spark, "offer-changes-marks")).awaitTermination()
    return store.load(spark, root, "offer_changes").select("supplier_id", "supplier_sku", "change_type", F.col("as_of").cast("timestamp_ntz").alias("as_of"))



_RUN = "SELECT (o_custkey % 10 + 1)::VARCHAR AS supplier_id, o_orderdate AS as_of, CASE o_orderstatus WHEN 'F' THEN 'snapshot' ELSE 'partial' END AS mode FROM orders WHERE o_custkey % 10 < 8"


@query(
    f"""WITH r AS (SELECT supplier_id, max(as_of) AS a, max(as_of) FILTER (mode = 'snapshot') AS s FROM ({_RUN}) GROUP BY supplier_id)
SELECT s_suppkey::VARCHAR AS supplier_id, greatest(CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2030-01-01' END, r.a) AS last_success_as_of, greatest(CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '1990-01-01' END, r.s) AS last_snapshot_as_of
FROM supplier LEFT JOIN r ON r.supplier_id = s_suppkey::VARCHAR"""
)
def d15_supplier_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Each order is a run of one of eight suppliers; some suppliers have later or earlier dates of their own, some no run."""
    k = F.col("s_suppkey")
    date = lambda cond, t: F.when(cond, F.lit(t).cast("timestamp"))
    s = A.read(spark, d, "supplier").select(k.cast("string").alias("supplier_id"), date(k % 3 == 0, "2030-01-01").alias("last_success_as_of"), date(k % 2 == 0, "1990-01-01").alias("last_snapshot_as_of"))
    mode = F.when(F.col("o_orderstatus") == "F", "snapshot").otherwise("partial")
    runs = A.read(spark, d, "orders").filter("o_custkey % 10 < 8").select((F.col("o_custkey") % 10 + 1).cast("string").alias("supplier_id"), F.col("o_orderdate").cast("timestamp").alias("as_of"), mode.alias("mode"))
    return apply.update_supplier_freshness(s, runs)


@query("SELECT 'p' || p_partkey AS product_id, CASE WHEN p_size % 7 = 0 THEN upper(p_name) ELSE p_name END AS title FROM part WHERE (p_size % 7 = 0 AND upper(p_name) <> p_name) OR p_partkey % 11 = 0")
def e10_changed_only(spark: SparkSession, d: str) -> DataFrame:
    """All products are dated anew; those of every seventh size have another title, every eleventh part a new product. Dates aren't content."""
    k = F.col("p_partkey")
    p = A.read(spark, d, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("product_id"), F.col("p_name").alias("title"), F.lit("2024-01-01").alias("data_as_of"), k, "p_size")
    new = p.select("product_id", F.when(F.col("p_size") % 7 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), F.lit("2024-02-01").alias("data_as_of"))
    return canonical.changed_only(p.filter(k % 11 != 0).select("product_id", "title", "data_as_of"), new).select("product_id", "title")


@query(
    """SELECT (SELECT count(*) FROM part WHERE p_size % 5 <> 0) AS products, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS pending_images,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS running_imports, (SELECT count(*) FROM supplier WHERE s_suppkey % 4 = 0) AS failed_suppliers"""
)
def i9_catalog_status(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part").select(F.when(F.col("p_size") % 5 == 0, "merged").otherwise("active").alias("status"))
    i = A.read(spark, d, "lineitem").select(F.when(F.col("l_linestatus") == "O", "pending").otherwise("fetched").alias("status"))
    r = A.read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded").alias("status"))
    return catalog.catalog_status(p, i, r, A.suppliers(spark, d))


@query("SELECT DISTINCT l_orderkey::VARCHAR AS query_id, l_partkey::VARCHAR AS product_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 25")
def k5_filter_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each order's parts as candidates; only those of smaller sizes are allowed."""
    c = A.read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("query_id"), F.col("l_partkey").cast("string").alias("product_id")).distinct()
    return vectors.filter_candidates(c, A.read(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").cast("string").alias("product_id")))


@query("SELECT p_partkey AS product_id, p_partkey + CASE WHEN p_size % 2 = 0 THEN 1 ELSE -1 END AS candidate_id FROM part WHERE (p_partkey + CASE WHEN p_size % 2 = 0 THEN 0 ELSE -1 END) % 3 <> 0")
def h5_exclude_distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each part with a neighbour, in either order; those whose smaller number is divisible by three were decided to be different."""
    k = F.col("p_partkey")
    p = A.read(spark, d, "part").select(k.alias("product_id"), (k + F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1)).alias("candidate_id"))
    decided = p.select(F.least("product_id", "candidate_id").alias("a"), F.greatest("product_id", "candidate_id").alias("b")).filter("a % 3 = 0")
    return suggest.exclude_distinct_pairs(p, decided.union(decided))
