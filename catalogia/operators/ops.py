"""Operational reports: counts, staleness, latency, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalogia.functions.schedule import feed_backoff, next_run


def _ago(as_of, **parts: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(**{k: F.lit(v) for k, v in parts.items()})


def supplier_stale(as_of) -> Column:
    return F.col("last_success_as_of").isNull() | (F.col("last_success_as_of") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.col("stale_after_hours")))


def supplier_stats(suppliers: DataFrame, offers: DataFrame, sources: DataFrame, mappings: DataFrame, as_of) -> DataFrame:
    """A row for each supplier. Each table is summed before it is joined."""
    o = offers.groupBy("supplier_id").agg(F.count_if("active").alias("active_offers"), F.count_if(~F.col("active")).alias("inactive_offers"))
    i = sources.groupBy("supplier_id").agg(F.count_if(F.col("status") == "pending").alias("pending_images"), F.count_if(F.col("status") == "failed").alias("failed_images"))
    m = mappings.groupBy("supplier_id").agg(F.count_if(F.col("category_id").isNull()).alias("unmapped_categories"))
    out = suppliers.select("supplier_id", "stale_after_hours", "last_success_as_of")
    for part in (o, i, m):
        out = out.join(part, "supplier_id", "left")
    names = ["active_offers", "inactive_offers", "pending_images", "failed_images", "unmapped_categories"]
    return out.select("supplier_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names), supplier_stale(as_of).alias("stale"))


def health_gauges(stale: DataFrame, runs: DataFrame, suppliers: DataFrame, changes: DataFrame, sources: DataFrame, as_of) -> DataFrame:
    """One row. stale: catalog.stale_offers' rows."""
    now = F.lit(as_of).cast("timestamp")
    parts = [
        stale.agg(F.count_if("stale").alias("stale_offers")),
        runs.agg(F.count_if((F.col("status") == "failed") & (F.col("created_at") >= _ago(as_of, days=7))).alias("failed_imports_7d")),
        suppliers.agg(F.count_if(F.col("feed_failures") > 0).alias("failed_feeds"), F.count_if(F.col("feed_enabled") & (F.col("next_run_at") < now - F.make_dt_interval(hours=F.lit(1)))).alias("overdue_feeds")),
        changes.agg(F.count_if(F.col("created_at") >= _ago(as_of, hours=24)).alias("changes_24h")),
        sources.agg(F.count_if(F.col("status") == "failed").alias("image_failures"), F.count_if(F.col("status") == "pending").alias("images_pending")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def search_latency(searches: DataFrame, as_of, exact: bool = True) -> DataFrame:
    """searches: created_at, status, timings (JSON). Of the last 7 days: total, failed, p95 of timings.total; approximate where the exact one is too dear."""
    ms = F.get_json_object("timings", "$.total").try_cast("double")
    p95 = F.percentile(ms, F.lit(0.95)) if exact else F.percentile_approx(ms, 0.95, 10_000).cast("double")
    return searches.filter(F.col("created_at") >= _ago(as_of, days=7)).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), p95.alias("p95_ms"))


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    """feedback_counts (verdict), review_counts (status, kind), image_status_counts (status), import_image_counts (run_id, status)."""
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def latest_failures(df: DataFrame, at: str, key: str, most: int = 50) -> DataFrame:
    """The last downloads or embeddings that failed or were blocked; those never tried come last, ties by key."""
    return df.filter("status in ('failed', 'blocked')").orderBy(F.desc_nulls_last(at), key).limit(most)


def orphan_objects(objects: DataFrame, assets: DataFrame, as_of, most: int = 20, share: float = 0.2) -> DataFrame:
    """objects: key, stored_at. Those without an asset that are a day old. None at all if there are no assets, or if over `most` and over `share` of the objects would go: then something else is wrong."""
    old = objects.filter(F.col("stored_at") < _ago(as_of, hours=24))
    lost = old.join(assets.select("key"), "key", "left_anti")
    n = lost.agg(F.count("*").alias("lost")).crossJoin(old.agg(F.count("*").alias("checked"))).crossJoin(assets.limit(1).agg(F.count("*").alias("assets")))
    ok = n.filter((F.col("assets") > 0) & ~((F.col("lost") > most) & (F.col("lost") > F.col("checked") * share))).select(F.lit(1).alias("ok"))
    return lost.crossJoin(ok).drop("ok")  # ok has one row or none


def expired_searches(searches: DataFrame, feedback: DataFrame, as_of) -> DataFrame:
    return searches.filter(F.col("expires_at") < F.lit(as_of).cast("timestamp")).join(feedback.select("search_id"), "search_id", "left_anti")


def stalled_images(sources: DataFrame, as_of, hours: int = 6) -> DataFrame:
    return sources.filter((F.col("status") == "pending") & (F.col("requested_at") < _ago(as_of, hours=hours)))


def due_feeds(suppliers: DataFrame, as_of, most: int = 50) -> DataFrame:
    return suppliers.filter(F.col("active") & F.col("feed_enabled") & (F.col("next_run_at") <= F.lit(as_of).cast("timestamp"))).orderBy("next_run_at", "supplier_id").limit(most)


def reschedule(feeds: DataFrame, as_of) -> DataFrame:
    """feeds: feed_kind, feed_time, feed_zone, feed_hours, feed_failures, busy. Adds next_run_at."""
    now = F.lit(as_of).cast("timestamp")
    at = next_run(F.col("feed_kind"), F.col("feed_time"), F.col("feed_zone"), F.col("feed_hours"), now)
    return feeds.withColumn("next_run_at", feed_backoff(F.col("feed_failures"), F.col("busy"), at, now))


def list_import_runs(runs: DataFrame, suppliers: DataFrame, as_of, supplier_id: str | None = None, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first; drafts only of the last day. One row more than asked for tells that there are more (has_more)."""
    r = runs.filter((F.col("status") != "uploaded") | (F.col("created_at") >= _ago(as_of, days=1)))
    for col, want in (("supplier_id", supplier_id), ("status", status)):
        if want is not None:
            r = r.filter(F.col(col) == want)
    page = r.orderBy(F.desc("created_at"), "run_id").offset(offset).limit(limit + 1)
    n = page.agg((F.count("*") > limit).alias("has_more"))
    shown = page.orderBy(F.desc("created_at"), "run_id").limit(limit).crossJoin(n)
    return shown.join(suppliers.select("supplier_id", F.col("name").alias("supplier_name")), "supplier_id", "left")


def list_reviews(reviews: DataFrame, products: DataFrame, status: str = "open", kind: str | None = None, most: int = 50) -> DataFrame:
    r = reviews.filter(F.col("status") == status)
    if kind is not None:
        r = r.filter(F.col("kind") == kind)
    page = r.orderBy(F.desc("created_at"), "review_id").limit(most)
    card = products.select("product_id", "title", "brand", "primary_gtin")
    left = card.toDF("product_id", "title", "brand", "gtin")
    right = card.toDF("candidate_product_id", "candidate_title", "candidate_brand", "candidate_gtin")
    return page.drop("gtin").join(left, "product_id", "left").join(right, "candidate_product_id", "left")
