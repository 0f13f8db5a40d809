"""Applying price lists to the stored offers, as joins and grouped minima instead of a walk over rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from catalogia.operators.canonical import CARRIED, refresh_touched
from catalogia.operators.changes import _json, diff_offers
from catalogia.operators.identity import detect_identity_conflicts
from catalogia.sources import store

COMMERCIAL = ["price", "currency", "vat_treatment", "vat_rate", "units_per_pack", "stock_quantity", "stock_status", "image_urls", "gtin"]
#: What applying a list asks of the stored offers that it meets.
MET = ["offer_id", "supplier_id", "supplier_sku", "product_id", "link_source", "active", "source_as_of", "created_at", "row_hash", *COMMERCIAL]
#: A snapshot with fewer codes than this share of the active offers removes nothing.
LEAST_COVERAGE = 0.5


def offer_id(supplier: Column, sku: Column) -> Column:
    return F.concat_ws("|", supplier, sku)


def match_existing(norm: DataFrame, offers: DataFrame) -> DataFrame:
    """norm with the stored offer of its supplier and sku as the struct `ex` (null if there is none)."""
    stored = offers.select(F.col("supplier_id").alias("_s"), F.col("supplier_sku").alias("_k"), F.struct("*").alias("ex"))
    return norm.join(stored, (F.col("supplier_id") == F.col("_s")) & (F.col("sku") == F.col("_k")), "left").drop("_s", "_k")


def resolve_duplicate_skus(matched: DataFrame) -> DataFrame:
    """Adds is_duplicate. A stored sku belongs to its first row of the run, whatever that is; a new one to its first valid row."""
    rows = Window.partitionBy("supplier_id", "sku", "run_id")
    claim = F.when(F.col("ex").isNotNull(), F.min("row_number").over(rows)).otherwise(F.min(F.when(F.col("offer").isNotNull(), F.col("row_number"))).over(rows))
    return matched.withColumn("is_duplicate", F.coalesce(F.col("sku").isNotNull() & (F.col("row_number") > claim), F.lit(False)))


def classify(rows: DataFrame) -> DataFrame:
    """Adds outcome: error, duplicate, outdated, unchanged, create or update."""
    ex = F.col("ex")
    return rows.withColumn(
        "outcome",
        F.when(F.col("sku").isNull(), "error")
        .when(F.col("is_duplicate"), "duplicate")
        .when(F.col("offer").isNull(), "error")
        .when(F.coalesce(ex["source_as_of"] > F.col("as_of"), F.lit(False)), "outdated")
        .when(F.coalesce(ex["active"] & (ex["row_hash"] == F.col("row_hash")), F.lit(False)), "unchanged")
        .when(ex.isNull(), "create")
        .otherwise("update"),
    )


def link_products(rows: DataFrame, identifiers: DataFrame, products: DataFrame) -> DataFrame:
    """Adds product_id, link_source, conflicts and new_gtin_product to rows that are created or updated.

    Identity is that of the stored owner, or of the first row in file order (earlier lists first) that reaches linking, for a new GTIN.
    Rows without a valid GTIN never meet: they don't take part in the join.
    """
    act = rows.filter(F.col("outcome").isin("create", "update"))
    gtin, same = F.col("offer.gtin"), F.col("ex").isNotNull() & F.col("ex.gtin").eqNullSafe(F.col("offer.gtin"))
    seeks = ~same & (F.col("offer.barcode_status") == "valid")
    asking = act.filter(seeks)
    owners = identifiers.select(F.col("value").alias("_g"), F.col("product_id").alias("owner")).join(products.select(F.col("product_id").alias("owner"), F.col("brand").alias("o_brand"), F.col("attributes").alias("o_attributes")), "owner", "left")
    first = asking.groupBy(gtin.alias("_g")).agg(F.min(F.struct("as_of", "supplier_id", "row_number", F.col("offer.brand").alias("brand"), F.map_entries("offer.attributes").alias("attributes"))).alias("f"))
    known = first.join(owners, "_g", "left").select(
        "_g", "owner", F.coalesce("o_brand", F.when(F.col("owner").isNull(), F.col("f.brand"))).alias("o_brand"),
        F.when(F.col("owner").isNull(), F.map_from_entries("f.attributes")).otherwise(F.col("o_attributes")).alias("o_attributes"),
        F.struct("f.as_of", "f.supplier_id", "f.row_number").alias("f"),
    )
    alone = F.concat_ws("|", F.lit("s:"), offer_id(F.col("supplier_id"), F.col("sku")), F.col("run_id"))
    j = asking.join(known, gtin == F.col("_g"))
    j = j.withColumn("is_first", F.col("owner").isNull() & (F.col("f") == F.struct("as_of", "supplier_id", "row_number")))
    is_first = F.col("is_first")
    conflicts = detect_identity_conflicts(F.col("offer.brand"), F.col("offer.attributes"), F.col("o_brand"), F.col("o_attributes"))
    j = j.withColumn("conflicts", F.when(~is_first, conflicts)).withColumn("owner", F.coalesce("owner", F.concat(F.lit("g:"), gtin)))
    clash = F.coalesce(F.size("conflicts") > 0, F.lit(False))
    names = act.columns
    linked = j.select(*names, F.when(clash, alone).otherwise(F.col("owner")).alias("product_id"), F.when(clash, "conflict_hold").otherwise("gtin").alias("link_source"), F.when(clash, F.col("conflicts")).alias("conflicts"), F.when(clash, F.col("owner")).alias("conflict_owner"), is_first.alias("new_gtin_product"))
    rest = act.filter(~F.coalesce(seeks, F.lit(False))).select(
        *names, F.when(same, F.col("ex.product_id")).otherwise(alone).alias("product_id"), F.when(same, F.col("ex.link_source")).otherwise("standalone").alias("link_source"),
        F.lit(None).cast(linked.schema["conflicts"].dataType).alias("conflicts"), F.lit(None).cast("string").alias("conflict_owner"), F.lit(False).alias("new_gtin_product"),
    )
    return linked.unionByName(rest)


def offer_changes(linked: DataFrame, had_active: DataFrame) -> DataFrame:
    """Changes of created and updated offers. had_active: supplier_id of suppliers with active offers before the run; others' first list makes no new_offer rows."""
    o, ex = F.col("offer"), F.col("ex")
    pick = lambda s: F.struct(*(s[c].alias(c) for c in COMMERCIAL))
    kind = "array<struct<change_type: string, old_value: string, new_value: string, pct: decimal(9,2)>>"
    one = lambda name, new: F.array(F.struct(F.lit(name).alias("change_type"), F.lit(None).cast("string").alias("old_value"), new.alias("new_value"), F.lit(None).cast("decimal(9,2)").alias("pct"))).cast(kind)
    none = F.array().cast(kind)
    told = _json(price=o["price"].cast("string"), currency=o["currency"], stock_status=o["stock_status"], stock_quantity=o["stock_quantity"])
    d = linked.join(had_active.select("supplier_id", F.lit(True).alias("had")).distinct(), "supplier_id", "left")
    diff = F.concat(diff_offers(pick(ex), pick(o), F.col("compare_images")).cast(kind), F.when(~ex["active"], one("reactivated", told)).otherwise(none))
    both = F.when(F.col("outcome") == "update", diff).when(F.col("had"), one("new_offer", told)).otherwise(none)
    rows = d.select("run_id", "supplier_id", offer_id(F.col("supplier_id"), F.col("sku")).alias("offer_id"), "product_id", F.col("as_of").alias("created_at"), F.explode(both).alias("c"))
    return rows.select("run_id", "supplier_id", "offer_id", "product_id", "c.*", "created_at")


def updated_offers(offers: DataFrame, classified: DataFrame, linked: DataFrame) -> DataFrame:
    """The new offers table: created and updated rows, freshness of unchanged ones, marks of those that were only seen, and all others as they were.

    linked: with category_id, as resolve_categories gives it.
    """
    names = offers.columns
    o = F.col("offer")
    keep = {
        "offer_id": offer_id(F.col("supplier_id"), F.col("sku")),
        "supplier_id": F.col("supplier_id"),
        "supplier_sku": F.col("sku"),
        "product_id": F.col("product_id"),
        "link_source": F.col("link_source"),
        "category_id": F.col("category_id"),
        "active": F.lit(True),
        "source_as_of": F.col("as_of"),
        "created_at": F.coalesce("ex.created_at", "as_of"),
        "row_hash": F.col("row_hash"),
        "last_import_id": F.col("run_id"),
        "last_row_number": F.col("row_number"),
    }
    new = linked.select(*((keep[n] if n in keep else o[n]).cast(offers.schema[n].dataType).alias(n) for n in names))
    seen = classified.filter(F.col("ex").isNotNull() & F.col("outcome").isin("error", "outdated", "unchanged") & ~F.col("is_duplicate"))
    fresh = F.when(F.col("outcome") == "unchanged", F.col("as_of"))
    seen = seen.select(F.col("ex.offer_id").alias("offer_id"), F.col("run_id").alias("_run"), F.col("row_number").alias("_row"), fresh.alias("_fresh"))
    old = offers.join(new.select("offer_id"), "offer_id", "left_anti").join(seen, "offer_id", "left")
    own = {
        "source_as_of": F.greatest("source_as_of", "_fresh"),
        "last_import_id": F.coalesce("_run", "last_import_id"),
        "last_row_number": F.coalesce("_row", "last_row_number"),
    }
    return old.select(*(own.get(n, F.col(n)).cast(offers.schema[n].dataType).alias(n) for n in names)).unionByName(new)


def snapshot_guard(runs: DataFrame, classified: DataFrame, offers_before: DataFrame, suppliers: DataFrame) -> DataFrame:
    """run_id, supplier_id, as_of, snapshot_result: why a snapshot removes nothing, or apply. Delta runs have no row."""
    rows = classified.groupBy("run_id").agg(F.count_if(F.col("sku").isNotNull()).alias("with_sku"), F.count_if(F.exists("issues", lambda i: i["code"].isin("missing_sku", "sku_precision_lost"))).alias("bad_keys"))
    active = offers_before.filter("active").groupBy("supplier_id").agg(F.count("*").alias("active_before"))
    r = runs.filter("mode = 'snapshot'").select("run_id", "supplier_id", "as_of").join(rows, "run_id", "left").join(active, "supplier_id", "left").join(suppliers.select("supplier_id", "last_snapshot_as_of"), "supplier_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    why = (
        F.when(zero("bad_keys") > 0, "unreadable_keys")
        .when(F.col("as_of") < F.col("last_snapshot_as_of"), "older_than_last_snapshot")
        .when((zero("active_before") > 0) & (zero("with_sku") < zero("active_before") * LEAST_COVERAGE), "low_coverage")
        .otherwise("applied")
    )
    return r.select("run_id", "supplier_id", "as_of", why.alias("snapshot_result"))


def deactivate_missing(offers: DataFrame, guard: DataFrame) -> tuple[DataFrame, DataFrame]:
    """offers after removal, and `removed` changes. Only active offers that the run didn't see and whose data isn't newer go."""
    g = guard.filter("snapshot_result = 'applied'").select(F.col("run_id").alias("_run"), "supplier_id", F.col("as_of").alias("_as_of"))
    j = offers.join(g, "supplier_id", "left")
    gone = F.coalesce(F.col("active") & ~F.col("last_import_id").eqNullSafe(F.col("_run")) & F.col("_run").isNotNull() & (F.col("source_as_of") <= F.col("_as_of")), F.lit(False))
    j = j.withColumn("_gone", gone)
    own = {"active": F.col("active") & ~F.col("_gone"), "source_as_of": F.when(F.col("_gone"), F.greatest("source_as_of", "_as_of")).otherwise(F.col("source_as_of"))}
    after = j.select(*(own.get(c, F.col(c)).alias(c) for c in offers.columns))
    old = _json(price=F.col("price").cast("string"), currency=F.col("currency"), stock_status=F.col("stock_status"), stock_quantity=F.col("stock_quantity"))
    none = F.lit(None)
    removed = j.filter("_gone").select(F.col("_run").alias("run_id"), "supplier_id", "offer_id", "product_id", F.lit("removed").alias("change_type"), old.alias("old_value"), none.cast("string").alias("new_value"), none.cast("decimal(9,2)").alias("pct"), F.col("_as_of").alias("created_at"))
    return after, removed


def open_reviews(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new's rows without self-pairs and without those that are open already for the kind and the unordered pair; repeats once."""
    pair = [F.least("product_id", "candidate_product_id").alias("a"), F.greatest("product_id", "candidate_product_id").alias("b")]
    there = existing.filter("status = 'open'").select("kind", *pair).distinct()
    n = new.filter("product_id <> candidate_product_id").withColumns({"a": F.least("product_id", "candidate_product_id"), "b": F.greatest("product_id", "candidate_product_id")})
    return n.dropDuplicates(["kind", "a", "b"]).join(there, ["kind", "a", "b"], "left_anti").drop("a", "b")


def relink_events(linked: DataFrame) -> DataFrame:
    """Known offers whose product changed; a manual link that was overruled asks for a review."""
    d = linked.filter(F.col("ex").isNotNull() & (F.col("product_id") != F.col("ex.product_id")))
    return d.select("run_id", F.col("ex.offer_id").alias("offer_id"), F.col("ex.product_id").alias("from_product_id"), F.col("product_id").alias("to_product_id"), F.col("ex.gtin").alias("old_gtin"), F.col("offer.gtin").alias("new_gtin"), (F.col("ex.link_source") == "manual").alias("needs_review"))


def resolve_categories(offers: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """offers with category_id by supplier and raw category, and the mappings with unseen raw categories added (without a category)."""
    joined = offers.drop("category_id").join(mappings.select("supplier_id", "category_raw", "category_id"), ["supplier_id", "category_raw"], "left").select(*offers.columns)
    unseen = offers.filter("category_raw is not null").select("supplier_id", "category_raw").distinct().join(mappings, ["supplier_id", "category_raw"], "left_anti")
    return joined, mappings.unionByName(unseen.withColumn("category_id", F.lit(None).cast("string")))


def remap_category(offers: DataFrame, mappings: DataFrame, supplier_id: str, category_raw: str, category_id: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New offers and mappings after one mapping's edit, and the products to refresh."""
    hit = (F.col("supplier_id") == supplier_id) & (F.col("category_raw") == category_raw)
    put = lambda df: df.withColumn("category_id", F.when(hit, F.lit(category_id)).otherwise(F.col("category_id")))
    return put(offers), put(mappings), offers.filter(hit).select("product_id").distinct()


def category_counts(offers: DataFrame, mappings: DataFrame) -> DataFrame:
    n = offers.filter("active").groupBy("supplier_id", "category_raw").agg(F.count("*").alias("offers"))
    return mappings.join(n, ["supplier_id", "category_raw"], "left").withColumn("offers", F.coalesce("offers", F.lit(0)))


def sync_offer_images(linked: DataFrame, sources: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New pending sources, and the offer_images after the run: offers of the run have exactly their listed urls, in order."""
    urls = linked.filter("compare_images").select("supplier_id", offer_id(F.col("supplier_id"), F.col("sku")).alias("offer_id"), F.posexplode("offer.image_urls").alias("position", "url"))
    pending = urls.select("supplier_id", "url").distinct().join(sources, ["supplier_id", "url"], "left_anti").withColumn("status", F.lit("pending"))
    done = linked.filter("compare_images").select(offer_id(F.col("supplier_id"), F.col("sku")).alias("offer_id"))
    return pending, links.join(done, "offer_id", "left_anti").unionByName(urls.select(*links.columns))


def run_counters(classified: DataFrame, linked: DataFrame, changes: DataFrame) -> DataFrame:
    """A row for each run."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    main = classified.groupBy("run_id").agg(
        F.count("*").alias("rows_processed"),
        F.count_if(F.col("sku").isNotNull()).alias("rows_with_sku"),
        n("error", "duplicate").alias("rows_error"),
        F.count_if(F.exists("issues", lambda i: i["severity"] == "warning")).alias("rows_with_warnings"),
        n("create").alias("offers_created"),
        n("update").alias("offers_updated"),
        n("unchanged").alias("offers_unchanged"),
        n("outdated").alias("offers_skipped_outdated"),
        F.count_if((F.col("outcome") == "update") & ~F.col("ex.active")).alias("offers_reactivated"),
    )
    made = linked.groupBy("run_id").agg(F.count_if(F.col("new_gtin_product") | F.col("product_id").startswith("s:") & ~F.coalesce(F.col("product_id") == F.col("ex.product_id"), F.lit(False))).alias("products_created"), F.count_if(F.col("ex").isNotNull() & (F.col("product_id") != F.col("ex.product_id"))).alias("offers_relinked"), F.count_if(F.col("conflicts").isNotNull()).alias("conflicts_opened"))
    kinds = ["price", "availability", "stock", "images", "barcode", "new_offer", "reactivated", "removed"]
    by = changes.groupBy("run_id").agg(*(F.count_if(F.col("change_type") == k).alias(f"changes_{k}") for k in kinds))
    return main.join(made, "run_id", "left").join(by, "run_id", "left").na.fill(0)


def update_supplier_freshness(suppliers: DataFrame, runs: DataFrame) -> DataFrame:
    r = runs.groupBy("supplier_id").agg(F.max("as_of").alias("_a"), F.max(F.when(F.col("mode") == "snapshot", F.col("as_of"))).alias("_s"))
    j = suppliers.join(r, "supplier_id", "left")
    own = {"last_success_as_of": F.greatest("last_success_as_of", "_a"), "last_snapshot_as_of": F.greatest("last_snapshot_as_of", "_s")}
    return j.select(*(own.get(c, F.col(c)).alias(c) for c in suppliers.columns))


def touched_products(classified: DataFrame, linked: DataFrame, removed: DataFrame) -> DataFrame:
    """product_id of products whose canonical row may change: those of written offers, before and after, of confirmed offers, and of removed ones."""
    after = linked.select("product_id")
    before = linked.filter("ex is not null").select(F.col("ex.product_id").alias("product_id"))
    confirmed = classified.filter("outcome = 'unchanged'").select(F.col("ex.product_id").alias("product_id"))
    return after.union(before).union(confirmed).union(removed.select("product_id")).filter("product_id is not null").distinct()


def known_pictures(offers: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """offer_id, position, asset_id, status of each offer's pictures, with the offer's CARRIED: sources are kept by supplier and address."""
    of = links.join(offers.select("offer_id", *CARRIED), "offer_id")
    return of.join(sources.select("supplier_id", "url", "status", "asset_id"), ["supplier_id", "url"]).select("offer_id", "position", "asset_id", "status", *CARRIED)


def _born(linked: DataFrame, products: DataFrame) -> DataFrame:
    """Rows of the products table for products that the run made; identity is that of their first row."""
    first = F.min(F.struct("as_of", "supplier_id", "row_number", F.col("offer.brand").alias("brand"), F.map_entries("offer.attributes").alias("attributes")))
    new = linked.join(products.select("product_id"), "product_id", "left_anti").groupBy("product_id").agg(first.alias("f"))
    own = {"product_id": F.col("product_id"), "status": F.lit("active"), "brand": F.col("f.brand"), "attributes": F.map_from_entries("f.attributes")}
    return new.select(*(own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in products.schema))


def _reviews(linked: DataFrame, relinks: DataFrame) -> DataFrame:
    clash = linked.filter("conflict_owner is not null")
    own = offer_id(F.col("supplier_id"), F.col("sku")).alias("offer_id")
    gtin, is_open = F.col("offer.gtin").alias("gtin"), F.lit("open").alias("status")
    asked = clash.select(F.lit("gtin_conflict").alias("kind"), "product_id", F.col("conflict_owner").alias("candidate_product_id"), own, gtin, is_open)
    manual = relinks.filter("needs_review").select(
        F.lit("gtin_changed").alias("kind"), F.col("to_product_id").alias("product_id"), F.col("from_product_id").alias("candidate_product_id"), "offer_id", F.col("new_gtin").alias("gtin"), is_open
    )
    return asked.unionByName(manual)


def _issues(classified: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows' own issues, and those of applying: repeated skus, outdated rows, conflicts of identity."""
    said = lambda severity, field, code: F.struct(F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field"), F.lit(code).alias("code"), F.col("sku").alias("value"))
    more = F.when(F.col("outcome") == "duplicate", said("error", "sku", "duplicate_sku")).when(F.col("outcome") == "outdated", said("warning", None, "outdated_row"))
    rows = classified.select("run_id", "supplier_id", "row_number", F.explode(F.concat("issues", F.array_compact(F.array(more)))).alias("i"))
    held = linked.filter("conflict_owner is not null").select(
        "run_id", "supplier_id", "row_number", F.lit("warning").alias("severity"), F.lit("barcode").alias("field"), F.lit("gtin_conflict").alias("code"), F.col("offer.barcode_raw").alias("value")
    )
    return rows.select("run_id", "supplier_id", "row_number", "i.*").unionByName(held)


def _empty(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def apply_import(norm: DataFrame, runs: DataFrame, state: dict[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> dict[str, DataFrame]:
    """The whole step as one job. At most one run a supplier in a call.

    state:
      offers, identifiers, suppliers, reviews (kind, product_id, candidate_product_id, offer_id, gtin, status);
      products: product_id, status, and what else a product has of its own (overrides, merged_into_id; brand and attributes if there is no canonical table);
      category_mappings (supplier_id, category_raw, category_id), image_sources (supplier_id, url, asset_id, status), offer_images (offer_id, position, url):
      empty where left out;
      canonical: what refresh_products made of the tables. Where it is given, the products that the run touches are refreshed, and only they.

    keep (such as scratch.saved) holds the tables that several results are made from; for results that aren't asked for it may leave those that have
    the name of a result, and removed, as they are. Returns the same tables anew, and issues, changes, counters, relinks,
    guard, refreshed (the canonical rows whose content changed) and fresher (product_id of all rows that were made anew).
    """
    offers_before = state["offers"]
    mappings = state.get("category_mappings", _empty(norm, "supplier_id string, category_raw string, category_id string"))
    sources = state.get("image_sources", _empty(norm, "supplier_id string, url string, asset_id string, status string"))
    links = state.get("offer_images", _empty(norm, "offer_id string, position int, url string"))
    canonical = state.get("canonical")
    identity = state["products"] if canonical is None else canonical
    classified = keep(classify(resolve_duplicate_skus(match_existing(norm, offers_before.select(*MET)))), "classified")
    linked = link_products(classified.drop("issues", "mode"), state["identifiers"], identity.select("product_id", "brand", "attributes"))
    linked, mappings = resolve_categories(linked.withColumns({"category_raw": F.col("offer.category_raw"), "category_id": F.lit(None).cast("string")}), mappings)
    linked = keep(linked, "linked")
    offers = updated_offers(offers_before, classified, linked)
    guard = snapshot_guard(runs, classified, offers_before, state["suppliers"])
    offers, removed = deactivate_missing(offers, guard)
    offers, removed = keep(offers, "offers"), keep(removed, "removed")
    changes = keep(offer_changes(linked, offers_before.filter("active").select("supplier_id")).unionByName(removed), "changes")
    pending, links = sync_offer_images(linked, sources, links)
    pending, links = keep(pending, "pending"), keep(links, "offer_images")
    sources = sources.unionByName(pending.select("supplier_id", "url", "status"), allowMissingColumns=True)
    identifiers = state["identifiers"].unionByName(linked.filter("new_gtin_product").select("product_id", F.col("offer.gtin").alias("value")).distinct())
    products = state["products"].unionByName(_born(linked, state["products"]))
    relinks = relink_events(linked)
    suppliers = update_supplier_freshness(state["suppliers"], runs)
    new_pictures = pending.groupBy("supplier_id").agg(F.count("*").alias("images_new"))
    counters = run_counters(classified, linked, changes).join(runs.select("run_id", "supplier_id").join(new_pictures, "supplier_id").drop("supplier_id"), "run_id", "left").na.fill(0)
    out = {
        "offers": offers,
        "identifiers": identifiers,
        "products": products,
        "suppliers": suppliers,
        "reviews": state["reviews"].unionByName(open_reviews(_reviews(linked, relinks), state["reviews"])),
        "category_mappings": mappings,
        "image_sources": sources,
        "offer_images": links,
        "issues": _issues(classified, linked),
        "changes": changes,
        "counters": counters,
        "relinks": relinks,
        "guard": guard,
    }
    if canonical is not None:
        touched = keep(touched_products(classified, linked, removed), "touched")
        out["fresher"] = touched
        out["canonical"], out["refreshed"] = refresh_touched(canonical, touched, products, offers, suppliers, known_pictures(offers.join(touched, "product_id", "left_semi"), links, sources), identifiers, keep)
    return out


#: Tables of the store that a run adds rows to; every other is replaced.
ADDED = ("changes", "issues", "counters", "relinks")
#: Tables that are kept in parts by a column's hash, so that a run writes only the parts with rows that it touches.
IN_PARTS = {"offers": "supplier_id", "canonical": "product_id"}
STATE = ("offers", "identifiers", "products", "suppliers", "reviews", "category_mappings", "image_sources", "offer_images", "canonical")


def run_import(spark: SparkSession, root: str, run_id: str, norm: DataFrame, runs: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> bool:
    """apply_import on the tables of the store at root, committed as one: all tables change, or none. False if run_id is committed already.

    The store holds the tables of STATE. A failed run is repeated by calling this again with the same arguments.
    """
    if store.is_committed(spark, root, run_id):
        return False
    before = store.latest(spark, root)
    state = {k: store.load(spark, root, k, before) for k in before.tables if k in STATE}
    of, written = runs.select("supplier_id"), {}

    def hold(df: DataFrame, name: str) -> DataFrame:
        """Results that others are made from are written where the store keeps them, and nowhere else."""
        if name in STATE:
            written[name], df = store.replace(spark, root, before, run_id, name, df, IN_PARTS.get(name), of if name == "offers" else None)
        elif name in ADDED:
            written[name], df = store.append(spark, root, before, run_id, name, df)
        else:
            df = keep(df, name)
        return df

    out = apply_import(norm, runs, state, hold)
    touched = {"offers": of, "canonical": out["fresher"]}
    return store.commit(spark, root, run_id, {k: out[k] for k in STATE} | {k: v for k, v in written.items() if k in STATE}, {k: written.get(k, out[k]) for k in ADDED}, IN_PARTS, touched)
