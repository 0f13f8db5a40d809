"""Catalogue queries: filters, codes, text, pages, facets, product sheets."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from catalogia.functions.gtin import parse_barcode
from catalogia.functions.text import fold_text, words
from catalogia.operators.pricing import evaluate_price

PAGE_MAX, OFFSET_MAX, COUNT_MAX, TOKENS, WORD_LEAST, SKU_SCORE = 96, 10_000, 10_001, 8, 0.6, 10.0
_DIGITS = re.compile(r"\d{6,14}", re.ASCII)


def filter_catalog(products: DataFrame, offers: DataFrame, supplier_id: str | None = None, brand: str | None = None, category_id: str | None = None, min_price: float | None = None, max_price: float | None = None, available: bool | None = None, has_gtin: bool | None = None, has_image: bool | None = None, with_empty: bool = False) -> DataFrame:
    """Active products. Prices bind products whose best price is in EUR only."""
    out = products.filter("status = 'active'")
    if not with_empty:
        out = out.filter("offer_count > 0")
    if brand is not None:
        out = out.filter(F.lower("brand") == brand.lower())
    if category_id is not None:
        out = out.filter(F.col("category_id") == category_id)
    for bound, low in ((min_price, True), (max_price, False)):
        if bound is not None:
            out = out.filter((F.col("best_price_currency") == "EUR") & ((F.col("best_unit_price") >= bound) if low else (F.col("best_unit_price") <= bound)))
    if available is not None:
        out = out.filter((F.col("available_supplier_count") > 0) == available)
    if has_gtin is not None:
        out = out.filter(F.col("has_gtin") == has_gtin)
    if has_image is not None:
        out = out.filter((F.col("image_count") > 0) == has_image)
    if supplier_id is not None:
        out = out.join(offers.filter(F.col("active") & (F.col("supplier_id") == supplier_id)).select("product_id"), "product_id", "left_semi")
    return out


def _code_hits(offers: DataFrame, identifiers: DataFrame, q: str) -> DataFrame:
    """product_id, score, matched_by of all offers and identifiers with the code, several a product. Spaces and hyphens within a barcode's digits don't count."""
    code, digits = q.strip(), re.sub(r"[\s-]", "", q)
    barcode = digits if _DIGITS.fullmatch(digits) else code
    g = offers.sparkSession.range(1).select(parse_barcode(F.lit(barcode)).alias("b")).first()["b"]["gtin14"]
    hits = [offers.filter(F.trim("barcode_raw") == barcode).select("product_id", F.lit(2).alias("score"), F.lit("barcode").alias("matched_by")), offers.filter(F.lower("supplier_sku") == code.lower()).select("product_id", F.lit(1).alias("score"), F.lit("sku").alias("matched_by"))]
    if g:
        for t, c in ((identifiers, "value"), (offers, "gtin")):
            hits.append(t.filter(F.col(c) == g).select("product_id", F.lit(3).alias("score"), F.lit("gtin").alias("matched_by")))
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    return found


def code_search(products: DataFrame, offers: DataFrame, identifiers: DataFrame, q: str) -> DataFrame:
    """product_id, score, matched_by of active products with the code: a GTIN (3), a raw barcode (2) or a sku, whatever its case (1)."""
    best = _code_hits(offers, identifiers, q).groupBy("product_id").agg(F.max(F.struct("score", "matched_by")).alias("m"))
    return best.join(products.filter("status = 'active'").select("product_id"), "product_id", "left_semi").select("product_id", "m.score", "m.matched_by")


def search(products: DataFrame, offers: DataFrame, identifiers: DataFrame, q: str) -> DataFrame:
    """product_id, score, matched_by: digits that are the code of something are searched as a code, all else (a model's number, a part of a barcode) as text."""
    if _DIGITS.fullmatch(re.sub(r"[\s-]", "", q)) and not _code_hits(offers, identifiers, q).isEmpty():
        return code_search(products, offers, identifiers, q).withColumn("score", F.col("score").cast("double"))
    by = F.when(F.col("score") >= SKU_SCORE, "sku").otherwise("text")  # without a sku a score is at most 2
    return text_search(products, offers, q).withColumn("matched_by", by)


def word_similarity(query: str, text: Column) -> Column:
    """The best trigram similarity of the query with a run of whole words of the text (its folded words, at most as many as hold the query's trigrams)."""

    def grams(word: str) -> set[str]:
        padded = f"  {word} "
        return {padded[i : i + 3] for i in range(len(padded) - 2)}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        from itertools import chain

        want = set(chain.from_iterable(grams(w) for w in query.split()))

        def best(t: str | None) -> float:
            ws = [grams(w) for w in (t or "").split()]
            top = 0.0
            for i, first in enumerate(ws):
                if not first & want:
                    continue
                run: set[str] = set()
                for g in ws[i : i + len(want) + 1]:
                    run |= g
                    shared = len(run & want)
                    top = max(top, shared / (len(run) + len(want) - shared))
                    if len(run) > len(want) / max(top, 1e-9):
                        break
            return top

        return texts.map(best)

    return score(text)


def text_search(products: DataFrame, offers: DataFrame, q: str) -> DataFrame:
    """product_id, score: all of the first TOKENS folded words start a word of search_text, or a run of words is WORD_LEAST similar, or an active offer's sku is q.

    A run that is similar enough shares at least WORD_LEAST of the query's trigrams: the similarity, which is a Python step, runs only over texts that hold so many.
    """
    spark = products.sparkSession
    folded = spark.range(1).select(fold_text(F.lit(q)).alias("f")).first()["f"]
    tokens = folded.split()[:TOKENS]
    p = products.filter("status = 'active'").select("product_id", fold_text(F.col("search_text")).alias("t"))
    w = words(F.col("t"))
    all_start = F.lit(bool(tokens))
    exact = F.lit(0.0)
    for t in tokens:
        all_start = all_start & (F.substring("t", 1, len(t)) == t) | all_start & F.contains(F.col("t"), F.lit(f" {t}"))
        exact = exact + F.array_contains(w, t).cast("double")
    sku = offers.filter(F.col("active") & (F.lower("supplier_sku") == q.strip().lower())).select("product_id").distinct().withColumn("is_sku", F.lit(True))
    p = p.join(sku, "product_id", "left").withColumn("is_sku", F.coalesce("is_sku", F.lit(False))).withColumn("starts", all_start)
    grams = {f"  {t} "[i : i + 3] for t in tokens for i in range(len(t) + 1)}
    padded = F.concat(F.lit("  "), F.replace(F.col("t"), F.lit(" "), F.lit("   ")), F.lit(" "))
    shared = F.lit(0)
    for g in sorted(grams):
        shared = shared + F.contains(padded, F.lit(g)).cast("int")
    near = shared >= max(1, math.ceil(WORD_LEAST * len(grams) - 1e-9))
    p = p.filter(F.col("is_sku") | F.col("starts") | near).withColumn("ws", word_similarity(" ".join(tokens), F.col("t")))
    p = p.filter(F.col("is_sku") | F.col("starts") | (F.col("ws") >= WORD_LEAST))
    score = F.when(F.col("is_sku"), SKU_SCORE).otherwise(0.0) + exact / max(1, len(tokens)) + F.col("ws")
    return p.select("product_id", score.alias("score"))


SORTS = {
    "updated": [F.desc_nulls_last, "data_as_of"],
    "price": [F.asc_nulls_last, "best_unit_price"],
    "title": [F.asc_nulls_last, "title"],
    "relevance": [F.desc_nulls_last, "score"],
}


def sort_page(df: DataFrame, sort: str = "updated", limit: int = 48, offset: int = 0) -> DataFrame:
    """A page in a total order (ties by product_id): a top-k, never a whole sort."""
    way, col = SORTS[sort]
    return df.orderBy(way(col), "product_id").offset(min(max(offset, 0), OFFSET_MAX)).limit(min(max(limit, 1), PAGE_MAX))


def capped_total(df: DataFrame) -> DataFrame:
    return df.limit(COUNT_MAX).agg(F.count("*").alias("total"))


def stale_offers(offers: DataFrame, suppliers: DataFrame, as_of) -> DataFrame:
    """Active offers with `stale`: older than their supplier's limit, or the last import failed after them."""
    s = suppliers.select("supplier_id", "stale_after_hours", "last_import_status", "last_import_finished_at")
    now = F.lit(as_of).cast("timestamp")
    old = F.col("source_as_of") < now - F.make_dt_interval(hours=F.col("stale_after_hours"))
    failed = (F.col("last_import_status") == "failed") & (F.col("last_import_finished_at") > F.col("source_as_of"))
    return offers.filter("active").join(s, "supplier_id", "left").withColumn("stale", F.coalesce(old, F.lit(False)) | F.coalesce(failed, F.lit(False)))


def facets(products: DataFrame, offers: DataFrame, suppliers: DataFrame, brands: int = 300) -> DataFrame:
    """facet (supplier, brand, category), value, n: products with active offers of each supplier (0 is kept), the most frequent brands, and all categories."""
    p = products.filter("status = 'active' and offer_count > 0")
    by_supplier = offers.filter("active").join(p.select("product_id"), "product_id", "left_semi").groupBy("supplier_id").agg(F.count_distinct("product_id").alias("n"))
    s = suppliers.select("supplier_id").join(by_supplier, "supplier_id", "left").select(F.lit("supplier").alias("facet"), F.col("supplier_id").alias("value"), F.coalesce("n", F.lit(0)).alias("n"))
    b = p.filter("brand is not null").groupBy(F.col("brand").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(brands)
    c = p.filter("category_id is not null").groupBy(F.col("category_id").alias("value")).agg(F.count("*").alias("n"))
    return s.unionByName(b.select(F.lit("brand").alias("facet"), "value", "n")).unionByName(c.select(F.lit("category").alias("facet"), "value", "n"))


def product_sheet(ids: DataFrame, products: DataFrame, offers: DataFrame, suppliers: DataFrame, identifiers: DataFrame, images: DataFrame, reviews: DataFrame, changes: DataFrame, as_of, days: int = 90) -> DataFrame:
    """A row for each asked product: its offers (evaluated; active first, then priority, name, sku), gtins, gallery, open reviews and the changes of the last days. The asked ids bound every list."""
    want = ids.select("product_id").distinct()
    mine = offers.join(want, "product_id", "left_semi").join(suppliers.select("supplier_id", "name", F.col("priority").alias("supplier_priority")), "supplier_id", "left")
    line = F.struct((~F.col("active")).alias("inactive"), F.col("supplier_priority").alias("priority"), "name", "supplier_sku", "offer_id", F.col("net_unit_price").cast("string").alias("net_unit_price"), "comparable", F.array_join("reasons", ",").alias("reasons"), "stock_status")
    o = evaluate_price(mine).groupBy("product_id").agg(F.array_sort(F.collect_list(line)).alias("offers"))
    g = identifiers.join(want, "product_id", "left_semi").groupBy("product_id").agg(F.array_sort(F.collect_set("value")).alias("gtins"))
    shown = mine.select("product_id", "offer_id", "supplier_priority").join(images.filter("status = 'fetched'").select("offer_id", "position", "asset_id"), "offer_id")
    i = shown.groupBy("product_id", "asset_id").agg(F.min(F.struct("supplier_priority", "position")).alias("at")).groupBy("product_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "asset_id"))), lambda x: x["asset_id"]).alias("gallery"))
    r = reviews.filter("status = 'open'").select(F.explode(F.array("product_id", "candidate_product_id")).alias("product_id"), "kind").groupBy("product_id").agg(F.array_sort(F.collect_list("kind")).alias("open_reviews"))
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    c = changes.filter(F.col("created_at") >= since).join(want, "product_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("recent_changes"))
    out = products.join(want, "product_id", "left_semi")
    for part in (o, g, i, r.join(want, "product_id", "left_semi"), c):
        out = out.join(part, "product_id", "left")
    return out


def lookup_barcodes(codes: DataFrame, offers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """codes: code. code, product_id, matched_by: by GTIN, else by the raw barcode of an offer."""
    c = codes.select("code").distinct().withColumn("g", parse_barcode(F.col("code"))["gtin14"])
    by_gtin = c.join(identifiers.select(F.col("value").alias("g"), "product_id"), "g").select("code", "product_id", F.lit("gtin").alias("matched_by"))
    rest = c.join(by_gtin.select("code"), "code", "left_anti")
    by_raw = rest.join(offers.select(F.trim("barcode_raw").alias("raw"), "product_id").distinct(), F.trim("code") == F.col("raw")).select("code", "product_id", F.lit("barcode").alias("matched_by"))
    return by_gtin.union(by_raw).distinct()


def catalog_status(products: DataFrame, images: DataFrame, runs: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row of counts: products, pending_images, running_imports, failed_suppliers."""
    one = lambda df, cond, name: df.agg(F.count_if(cond).alias(name))
    parts = [one(products, F.col("status") == "active", "products"), one(images, F.col("status") == "pending", "pending_images"), one(runs, F.col("status") == "running", "running_imports"), one(suppliers, F.col("last_import_status") == "failed", "failed_suppliers")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
