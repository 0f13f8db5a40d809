"""Queries for manual decisions: merges and splits, detached offers, overrides, reviews, the audit. `k` is a product's part key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalogia.operators import associations, ops
from catalogia.plans import adapter as A, sql as S
from catalogia.plans.queries import query
from catalogia.sources.scratch import saved

AT = "2024-01-30"


def _pid(k: Column) -> Column:
    return F.concat(F.lit("g:"), A.gtin_of(k))


def _k(product: Column | str) -> Column:
    """The part key that a product's id holds."""
    return F.substring(product, 5, 11).cast("long")


def _sql_pid(k: str) -> str:
    return f"'g:' || {S.gtin(k)}"


_LINK = "CASE WHEN l_suppkey % 2 = 0 THEN 'gtin' ELSE 'auto' END"


def _offers(spark: SparkSession, d: str) -> DataFrame:
    """What decisions read of offers, written once: a decision's tables come from them several times."""
    return saved(A.offers(spark, d).select("offer_id", "supplier_id", "product_id", "link_source", "gtin"), "decided-offers")


def _merge(spark: SparkSession, d: str, offers: DataFrame | None = None) -> tuple[dict[str, DataFrame], tuple[DataFrame, DataFrame, DataFrame]]:
    """Products 1 of each ten go into the one before; half of them with too short a reason. 2 to 4 of each ten are asked for in ways that are refused."""
    k = F.col("p_partkey")
    p = A.products(spark, d).withColumn("status", F.when(_k("product_id") % 10 == 4, "merged").otherwise("active"))
    o = (_offers(spark, d) if offers is None else offers).withColumn("link_source", F.when(F.col("supplier_id").cast("long") % 2 == 0, "gtin").otherwise("auto"))
    target = F.when(k % 10 == 1, _pid(k - 1)).when(k % 10 == 2, _pid(k)).when(k % 10 == 3, "none").otherwise(_pid(k - 4))
    wanted = A.parts(spark, d).filter("p_partkey % 10 between 1 and 4").select(_pid(k).alias("source_id"), target.alias("target_id"), F.when(k % 20 < 10, "the same article, seen").otherwise("same").alias("reason"), F.lit(AT).cast("timestamp").alias("at"))
    ids = A.identifiers(spark, d)
    return associations.merge_products(wanted, p, o, ids), (p, o, ids)


@query(f"WITH {S.off()} SELECT offer_id, CASE WHEN l_partkey % 20 = 1 THEN {_sql_pid('(l_partkey - 1)')} ELSE product_id END AS product_id, CASE WHEN l_partkey % 20 = 1 AND l_suppkey % 2 = 1 THEN 'manual' ELSE {_LINK} END AS link_source FROM off")
def g1_merge_products(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d)[0]["offers"].select("offer_id", "product_id", "link_source")


@query(f"SELECT {_sql_pid('p_partkey')} AS source_id, CASE p_partkey % 10 WHEN 1 THEN 'reason_too_short' WHEN 2 THEN 'same_product' WHEN 3 THEN 'unknown_product' ELSE 'already_merged' END AS why FROM part WHERE p_partkey % 10 BETWEEN 2 AND 4 OR p_partkey % 20 = 11")
def g1_refused_merges(spark: SparkSession, d: str) -> DataFrame:
    return _merge(spark, d, A.offers(spark, d))[0]["refused"].select("source_id", "why")


@query(f"WITH {S.off()} SELECT offer_id, CASE WHEN l_partkey % 40 = 1 THEN {_sql_pid('(l_partkey - 1)')} ELSE product_id END AS product_id, CASE WHEN l_partkey % 40 = 1 AND l_suppkey % 2 = 1 THEN 'manual' ELSE {_LINK} END AS link_source FROM off")
def g2_split_merge(spark: SparkSession, d: str) -> DataFrame:
    """Every second merge is undone."""
    m, _ = _merge(spark, d)
    undo = m["audit"].filter(_k(F.col("related_ids")[0]) % 40 == 21)
    return associations.split_merge(undo, m["products"], m["offers"], m["identifiers"], AT)["offers"].select("offer_id", "product_id", "link_source")


def _detach(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    o = _offers(spark, d)
    wanted = o.filter(F.col("supplier_id").cast("long") % 10 == 3).select("offer_id", F.lit("another article").alias("reason"), F.lit(AT).cast("timestamp").alias("at"))
    return associations.detach_offers(wanted, o)


_DETACHED = f"WITH {S.off()}, n AS (SELECT *, count(*) OVER (PARTITION BY product_id) AS n FROM off) SELECT offer_id, CASE WHEN {{w}} AND n > 1 THEN 'd:' || offer_id ELSE product_id END AS product_id, CASE WHEN {{w}} AND n > 1 THEN 'manual' ELSE 'gtin' END AS link_source FROM n"


@query(_DETACHED.format(w="l_suppkey % 10 = 3"))
def g3_detach_offers(spark: SparkSession, d: str) -> DataFrame:
    return _detach(spark, d)["offers"].select("offer_id", "product_id", "link_source")


@query(_DETACHED.format(w="l_suppkey % 10 = 3 AND l_partkey % 2 = 1"))
def g3_revert_detach(spark: SparkSession, d: str) -> DataFrame:
    """The offers of even parts go back."""
    m = _detach(spark, d)
    undo = m["audit"].filter(F.regexp_extract("entity_id", "P([0-9]+)$", 1).cast("long") % 2 == 0)
    return associations.revert_detach(undo, m["offers"], AT)["offers"].select("offer_id", "product_id", "link_source")


def _overrides(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    values = F.when(k % 20 == 0, F.create_map(F.lit("title"), F.concat(F.lit("New "), k.cast("string")))).otherwise(F.create_map(F.lit("title"), none, F.lit("brand"), F.lit("B")))
    wanted = A.read(spark, d, "part").filter("p_partkey % 10 = 0").select(_pid(k).alias("product_id"), values.alias("overrides"), F.lit(AT).cast("timestamp").alias("at"))
    return associations.set_overrides(wanted, A.products(spark, d))


_OVER = "SELECT {p} AS product_id, CASE WHEN p_partkey % 20 = 0{x} THEN 'New ' || p_partkey WHEN p_partkey % 20 <> 10 AND p_partkey % 50 = 0 THEN 'Special ' || p_name END AS override_title, CASE WHEN p_partkey % 20 = 10 THEN 'B' END AS override_brand FROM part"


@query(_OVER.format(p=_sql_pid("p_partkey"), x=""))
def g4_set_overrides(spark: SparkSession, d: str) -> DataFrame:
    return _overrides(spark, d)["products"].select("product_id", "override_title", "override_brand")


@query(_OVER.format(p=_sql_pid("p_partkey"), x=" AND FALSE"))
def g4_revert_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Those of every twentieth product are undone."""
    m = _overrides(spark, d)
    undo = m["audit"].filter(_k("entity_id") % 20 == 0)
    return associations.revert_overrides(undo, m["products"], AT)["products"].select("product_id", "override_title", "override_brand")


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return A.read(spark, d, "part").select(k.cast("string").alias("review_id"), F.lit("title").alias("kind"), _pid(k).alias("product_id"), _pid(k + 1).alias("candidate_product_id"), F.concat(F.lit("3|P"), k.cast("string")).alias("offer_id"), F.when(k % 7 == 0, "resolved").otherwise("open").alias("status"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=k.cast("int"))).alias("created_at"))


@query(
    f"""WITH {S.off()}, r AS (SELECT p_partkey AS k, {_sql_pid('p_partkey')} AS p, {_sql_pid('(p_partkey + 1)')} AS c FROM part)
SELECT 'review' AS what, k::VARCHAR AS a, CASE WHEN k % 7 = 0 OR k % 4 < 2 THEN 'resolved' WHEN k % 4 = 2 THEN 'dismissed' ELSE 'open' END AS b FROM r
UNION ALL SELECT 'pair', p, c FROM r WHERE k % 7 <> 0 AND k % 4 = 1 UNION ALL SELECT 'merge', p, c FROM r WHERE k % 7 <> 0 AND k % 4 = 0
UNION ALL SELECT 'offer', offer_id, CASE WHEN l_suppkey = 3 AND l_partkey % 7 <> 0 AND l_partkey % 4 = 1 THEN 'manual' ELSE 'conflict_hold' END FROM off"""
)
def g5_resolve_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Of each four reviews one is a merge, one keeps the two apart, one is dismissed, one is left."""
    k = F.col("review_id").cast("long")
    r = _reviews(spark, d)
    action = F.when(k % 4 == 0, "merge").when(k % 4 == 1, "keep_separate").otherwise("dismiss")
    wanted = r.filter(k % 4 < 3).select("review_id", action.alias("action"), F.lit("seen by hand").alias("reason"), F.lit(AT).cast("timestamp").alias("at"))
    out = associations.resolve_reviews(wanted, r, A.offers(spark, d).withColumn("link_source", F.lit("conflict_hold")), spark.createDataFrame([], "a string, b string"))
    rows = lambda what, name, a, b: out[name].select(F.lit(what).alias("what"), F.col(a).alias("a"), F.col(b).alias("b"))
    return rows("review", "reviews", "review_id", "status").union(rows("pair", "distinct_pairs", "a", "b")).union(rows("merge", "merges", "source_id", "target_id")).union(rows("offer", "offers", "offer_id", "link_source"))


def _audit(spark: SparkSession, d: str) -> DataFrame:
    e, none = F.col("event_id"), F.lit(None).cast("string")
    return A.read(spark, d, "events").select(
        e.cast("string").alias("event_id"), F.col("event_type").alias("action"), F.concat(F.lit("p"), (F.col("user_id") % 50).cast("string")).alias("entity_id"), F.array(F.concat(F.lit("p"), (F.col("user_id") % 50).cast("string"))).alias("related_ids"),
        none.alias("reason"), F.col("props").alias("data"), F.col("ts").cast("timestamp").alias("at"), F.when(e % 12 == 9, (e - 1).cast("string")).alias("reverts"), none.alias("reverted_by"),
    )


@query("SELECT e.event_id::VARCHAR AS event_id, CASE WHEN e.event_id % 12 = 8 THEN n.event_id::VARCHAR END AS reverted_by FROM events e LEFT JOIN events n ON n.event_id = e.event_id + 1 WHERE e.event_id % 2 = 0 OR e.event_id % 3 = 0")
def g6_append_audit(spark: SparkSession, d: str) -> DataFrame:
    """Even events are in the log; every third one is appended, and some of those undo the one before."""
    a, k = _audit(spark, d), F.col("event_id").cast("long")
    return associations.append_audit(a.filter(k % 2 == 0), a.filter(k % 3 == 0)).select("event_id", "reverted_by")


@query("SELECT event_id::VARCHAR AS event_id FROM events WHERE user_id % 50 = 7 ORDER BY ts DESC, event_id::VARCHAR LIMIT 50")
def g6_product_history(spark: SparkSession, d: str) -> DataFrame:
    return associations.product_history(_audit(spark, d), "p7").select("event_id")


@query(f"SELECT r.p_partkey::VARCHAR AS review_id, {_sql_pid('r.p_partkey')} AS product_id, r.p_name AS title, r.p_brand AS brand, {_sql_pid('(r.p_partkey + 1)')} AS candidate_product_id, c.p_name AS candidate_title FROM (SELECT * FROM part WHERE p_partkey % 7 <> 0 ORDER BY p_partkey DESC LIMIT 50) r LEFT JOIN part c ON c.p_partkey = r.p_partkey + 1")
def l12_list_reviews(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    cards = A.read(spark, d, "part").select(_pid(k).alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), A.gtin_of(k).alias("primary_gtin"))
    return ops.list_reviews(_reviews(spark, d), cards).select("review_id", "product_id", "title", "brand", "candidate_product_id", "candidate_title")
