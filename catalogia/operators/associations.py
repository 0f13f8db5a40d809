"""Manual identity decisions as batch updates of the tables, with an audit that can undo them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

EVENT = "event_id string, action string, entity_id string, related_ids array<string>, reason string, data string, at timestamp, reverts string, reverted_by string"


def event_id(action: str, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(action), *parts), 256), 1, 32)


def _event(df: DataFrame, action: str, entity: Column, related: Column, reason: Column, data: Column, at: Column, reverts: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(event_id(action, entity, at.cast("string")).alias("event_id"), F.lit(action).alias("action"), entity.alias("entity_id"), related.alias("related_ids"), reason.alias("reason"), data.alias("data"), at.alias("at"), (none if reverts is None else reverts).alias("reverts"), none.alias("reverted_by"))


def merge_products(decisions: DataFrame, products: DataFrame, offers: DataFrame, identifiers: DataFrame) -> dict[str, DataFrame]:
    """decisions: source_id, target_id, reason, at (a source at most once). Moves offers and identifiers to the target and marks the source merged.

    Refused (in `refused`, with why): a product with itself, one that is merged already, or, where both have identifiers, a reason of under 10 characters.
    Offers linked by GTIN stay so; others become manual. Each audit row holds exactly what moved.
    """
    status = products.select("product_id", "status")
    owned = identifiers.groupBy("product_id").agg(F.sort_array(F.collect_list("value")).alias("gtins"))
    d = decisions.join(status.toDF("source_id", "s_status"), "source_id", "left").join(status.toDF("target_id", "t_status"), "target_id", "left")
    d = d.join(owned.toDF("source_id", "s_gtins"), "source_id", "left").join(owned.select(F.col("product_id").alias("target_id"), F.lit(True).alias("t_has")), "target_id", "left")
    why = (
        F.when(F.col("source_id") == F.col("target_id"), "same_product")
        .when(F.col("s_status").isNull() | F.col("t_status").isNull(), "unknown_product")
        .when((F.col("s_status") == "merged") | (F.col("t_status") == "merged"), "already_merged")
        .when(F.col("s_gtins").isNotNull() & F.col("t_has") & (F.length(F.trim(F.coalesce("reason", F.lit("")))) < 10), "reason_too_short")
    )
    d = d.withColumn("why", why)
    ok = d.filter("why is null").select("source_id", "target_id", "reason", "at", F.coalesce("s_gtins", F.array().cast("array<string>")).alias("gtins"))
    to = ok.select(F.col("source_id").alias("product_id"), F.col("target_id").alias("_to"))
    o = offers.join(to, "product_id", "left")
    link = F.when(F.col("_to").isNotNull() & (F.col("link_source") != "gtin"), "manual").otherwise(F.col("link_source"))
    own = {"product_id": F.coalesce("_to", "product_id"), "link_source": link}
    moved = offers.join(to.select("product_id"), "product_id", "left_semi").groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("offer_id", "link_source"))).alias("offers"))
    e = ok.join(moved, F.col("source_id") == F.col("product_id"), "left")
    data = F.to_json(F.struct("source_id", "target_id", F.col("gtins"), F.col("offers")))
    p = products.join(to, "product_id", "left")
    mine = {"status": F.when(F.col("_to").isNotNull(), "merged").otherwise(F.col("status")), "merged_into_id": F.coalesce("_to", "merged_into_id")}
    return {
        "offers": o.select(*(own.get(c, F.col(c)).alias(c) for c in offers.columns)),
        "identifiers": identifiers.join(to, "product_id", "left").select(*((F.coalesce("_to", "product_id") if c == "product_id" else F.col(c)).alias(c) for c in identifiers.columns)),
        "products": p.select(*(mine.get(c, F.col(c)).alias(c) for c in products.columns)),
        "audit": _event(e, "product.merged", F.col("target_id"), F.array("source_id", "target_id"), F.col("reason"), data, F.col("at")),
        "refused": d.filter("why is not null").select("source_id", "target_id", "why"),
    }


MERGED = "source_id string, target_id string, gtins array<string>, offers array<struct<offer_id: string, link_source: string>>"


def split_merge(events: DataFrame, products: DataFrame, offers: DataFrame, identifiers: DataFrame, at) -> dict[str, DataFrame]:
    """Undoes merges (their audit rows): moved offers and identifiers go back, and so do later offers that came in by a moved GTIN."""
    e = events.filter((F.col("action") == "product.merged") & F.col("reverted_by").isNull()).select("event_id", "related_ids", F.from_json("data", MERGED).alias("d")).select("event_id", "related_ids", "d.*")
    back = e.select("source_id", "target_id", F.explode("offers").alias("m")).select(F.col("m.offer_id").alias("offer_id"), F.col("source_id").alias("_back"), F.col("target_id").alias("_from"), F.col("m.link_source").alias("_link"))
    codes = e.select(F.col("source_id").alias("_src"), F.col("target_id").alias("_tgt"), F.explode("gtins").alias("_g"))
    o = offers.join(back, "offer_id", "left").join(codes, (F.col("gtin") == F.col("_g")) & (F.col("product_id") == F.col("_tgt")), "left")
    explicit = F.col("_back").isNotNull() & (F.col("product_id") == F.col("_from"))
    later = ~F.coalesce(explicit, F.lit(False)) & F.col("_src").isNotNull() & (F.col("link_source") == "gtin")
    own = {"product_id": F.when(explicit, F.col("_back")).when(later, F.col("_src")).otherwise(F.col("product_id")), "link_source": F.when(explicit, F.col("_link")).otherwise(F.col("link_source"))}
    ids = identifiers.join(codes.select(F.col("_g").alias("value"), "_src"), "value", "left")
    p = products.join(e.select(F.col("source_id").alias("product_id"), F.lit(True).alias("_open")), "product_id", "left")
    mine = {"status": F.when(F.col("_open"), "active").otherwise(F.col("status")), "merged_into_id": F.when(~F.coalesce("_open", F.lit(False)), F.col("merged_into_id"))}
    none = F.lit(None).cast("string")
    return {
        "offers": o.select(*(own.get(c, F.col(c)).alias(c) for c in offers.columns)),
        "identifiers": ids.select(*((F.coalesce("_src", "product_id") if c == "product_id" else F.col(c)).alias(c) for c in identifiers.columns)),
        "products": p.select(*(mine.get(c, F.col(c)).alias(c) for c in products.columns)),
        "audit": _event(e, "product.split", F.col("target_id"), F.col("related_ids"), none, none, F.lit(at).cast("timestamp"), F.col("event_id")),
    }


def detach_offers(decisions: DataFrame, offers: DataFrame) -> dict[str, DataFrame]:
    """decisions: offer_id, reason, at. Each offer gets a product of its own, unless it is its product's only one."""
    n = offers.groupBy("product_id").agg(F.count("*").alias("n"))
    d = decisions.join(offers.select("offer_id", F.col("product_id").alias("_from"), F.col("link_source").alias("_link")), "offer_id").join(n.withColumnRenamed("product_id", "_from"), "_from")
    ok = d.filter("n > 1").withColumn("_to", F.concat(F.lit("d:"), F.col("offer_id")))
    o = offers.join(ok.select("offer_id", "_to"), "offer_id", "left")
    own = {"product_id": F.coalesce("_to", "product_id"), "link_source": F.when(F.col("_to").isNotNull(), "manual").otherwise(F.col("link_source"))}
    data = F.to_json(F.struct("offer_id", F.col("_from").alias("from_product_id"), F.col("_to").alias("to_product_id"), F.col("_link").alias("link_source")))
    return {"offers": o.select(*(own.get(c, F.col(c)).alias(c) for c in offers.columns)), "audit": _event(ok, "offer.detached", F.col("offer_id"), F.array("_from", "_to"), F.col("reason"), data, F.col("at")), "refused": d.filter("n <= 1").select("offer_id", F.lit("only_offer").alias("why"))}


def revert_detach(events: DataFrame, offers: DataFrame, at) -> dict[str, DataFrame]:
    """Back to the former product, if the offer hasn't moved again."""
    e = events.filter((F.col("action") == "offer.detached") & F.col("reverted_by").isNull()).select("event_id", "related_ids", F.from_json("data", "offer_id string, from_product_id string, to_product_id string, link_source string").alias("d")).select("event_id", "related_ids", "d.*")
    b = e.select("offer_id", F.col("from_product_id").alias("_f"), F.col("to_product_id").alias("_t"), F.col("link_source").alias("_l"), "event_id", "related_ids")
    j = offers.join(b, "offer_id", "left")
    hit = F.coalesce(F.col("product_id") == F.col("_t"), F.lit(False))
    own = {"product_id": F.when(hit, F.col("_f")).otherwise(F.col("product_id")), "link_source": F.when(hit, F.col("_l")).otherwise(F.col("link_source"))}
    none = F.lit(None).cast("string")
    return {"offers": j.select(*(own.get(c, F.col(c)).alias(c) for c in offers.columns)), "audit": _event(j.filter(hit), "offer.reattached", F.col("offer_id"), F.col("related_ids"), none, none, F.lit(at).cast("timestamp"), F.col("event_id"))}


OVERRIDES = ["title", "brand", "category_id", "image_id"]


def set_overrides(decisions: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """decisions: product_id, overrides (map; a null value clears the override), at. The audit holds the values before and after."""
    j = products.join(decisions.select("product_id", "overrides", "at"), "product_id", "left")
    has = lambda c: F.coalesce(F.map_contains_key("overrides", c), F.lit(False))
    own = {f"override_{c}": F.when(has(c), F.try_element_at("overrides", F.lit(c))).otherwise(F.col(f"override_{c}")) for c in OVERRIDES}
    side = lambda after: F.struct(*((own[f"override_{c}"] if after else F.col(f"override_{c}")).alias(c) for c in OVERRIDES))
    data = F.to_json(F.struct(side(False).alias("before"), side(True).alias("after")), {"ignoreNullFields": "false"})
    e = j.filter("overrides is not null")
    return {"products": j.select(*(own.get(c, F.col(c)).alias(c) for c in products.columns)), "audit": _event(e, "product.overridden", F.col("product_id"), F.array("product_id"), F.lit(None).cast("string"), data, F.col("at"))}


def revert_overrides(events: DataFrame, products: DataFrame, at) -> dict[str, DataFrame]:
    values = ", ".join(f"{c}: string" for c in OVERRIDES)
    e = events.filter((F.col("action") == "product.overridden") & F.col("reverted_by").isNull()).select("event_id", F.col("entity_id").alias("product_id"), F.from_json("data", f"before struct<{values}>, after struct<{values}>")["before"].alias("b"))
    j = products.join(e, "product_id", "left")
    own = {f"override_{c}": F.when(F.col("event_id").isNotNull(), F.col("b")[c]).otherwise(F.col(f"override_{c}")) for c in OVERRIDES}
    none = F.lit(None).cast("string")
    return {"products": j.select(*(own.get(c, F.col(c)).alias(c) for c in products.columns)), "audit": _event(j.filter("event_id is not null"), "product.override_reverted", F.col("product_id"), F.array("product_id"), none, none, F.lit(at).cast("timestamp"), F.col("event_id"))}


def resolve_reviews(decisions: DataFrame, reviews: DataFrame, offers: DataFrame, distinct_pairs: DataFrame) -> dict[str, DataFrame]:
    """decisions: review_id, action (merge, keep_separate, dismiss), reason, at. merges: decisions for merge_products; kept pairs are never proposed again, and their held offers become manual."""
    open_ = reviews.filter("status = 'open'").join(decisions, "review_id")
    status = F.when(F.col("action") == "dismiss", "dismissed").otherwise("resolved")
    done = open_.select("review_id", status.alias("_s"))
    new = reviews.join(done, "review_id", "left")
    kept = open_.filter("action = 'keep_separate'")
    pairs = kept.select(F.least("product_id", "candidate_product_id").alias("a"), F.greatest("product_id", "candidate_product_id").alias("b"))
    held = kept.filter("offer_id is not null").select("offer_id", F.lit(True).alias("_m")).distinct()
    o = offers.join(held, "offer_id", "left").withColumn("link_source", F.when(F.col("_m") & (F.col("link_source") == "conflict_hold"), "manual").otherwise(F.col("link_source"))).select(*offers.columns)
    return {
        "reviews": new.select(*((F.coalesce("_s", "status") if c == "status" else F.col(c)).alias(c) for c in reviews.columns)),
        "distinct_pairs": distinct_pairs.select("a", "b").union(pairs).distinct(),
        "offers": o,
        "merges": open_.filter("action = 'merge'").select(F.col("product_id").alias("source_id"), F.col("candidate_product_id").alias("target_id"), "reason", "at"),
    }


def append_audit(audit: DataFrame, events: DataFrame) -> DataFrame:
    """The log with the new events, repeats once; an event that undoes another is marked on both."""
    new = events.join(audit.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"]).select(*audit.columns)
    undone = new.filter("reverts is not null").groupBy(F.col("reverts").alias("_id")).agg(F.min("event_id").alias("_by"))
    both = audit.unionByName(new).join(undone, F.col("event_id") == F.col("_id"), "left")
    return both.select(*((F.coalesce("_by", "reverted_by") if c == "reverted_by" else F.col(c)).alias(c) for c in audit.columns))


def product_history(audit: DataFrame, product_id: str, most: int = 50) -> DataFrame:
    return audit.filter(F.array_contains("related_ids", product_id)).orderBy(F.desc("at"), "event_id").limit(most)
