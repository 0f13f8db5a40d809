"""Images and vectors: exact nearest images for a set of queries, products behind them, and retrieval quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Queries that are sent to the tasks at once; more go in further passes over the vectors.
QUERY_BLOCK = 1_024
MOST_CANDIDATES = 24


def dedupe_images(files: DataFrame) -> DataFrame:
    """files: path, content. One row a SHA-256: the first path."""
    return files.select(F.sha2("content", 256).alias("sha256"), "path", F.length("content").alias("bytes")).groupBy("sha256").agg(F.min("path").alias("path"), F.first("bytes").alias("bytes"), F.count("*").alias("copies"))


def difference_hash(pixels: Column) -> Column:
    """16 hexadecimal digits of 64 bits, row by row: whether a pixel of a 9 by 8 grey image is brighter than its right neighbour."""
    bit = lambda i: F.when(F.try_element_at(pixels, i + F.floor(i / 8).cast("int") + 1) > F.try_element_at(pixels, i + F.floor(i / 8).cast("int") + 2), "1").otherwise("0")
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), "")
    half = lambda k: F.lpad(F.lower(F.conv(F.substring(bits, k, 32), 2, 16)), 8, "0")
    return F.when(F.size(pixels) == 72, F.concat(half(1), half(33)))


def nearest_images(queries: DataFrame, embeddings: DataFrame, model_key: str, k: int = 200) -> DataFrame:
    """queries: query_id, embedding; embeddings: asset_id, model_key, status, embedding. query_id, rank, asset_id, score (cosine); ties by asset_id.

    Exact. A block of queries (by a hash of their ids) goes to the tasks, each task keeps its k best over all its batches, and only those are exchanged.
    Vectors of another length than the query's take no part.
    """
    spark = queries.sparkSession
    q = queries.select("query_id", "embedding")
    blocks = -(-q.count() // QUERY_BLOCK)
    names = "query_id string, asset_id string, score double"
    found = None
    base = embeddings.filter((F.col("model_key") == model_key) & (F.col("status") == "done")).select(F.col("asset_id").cast("string").alias("asset_id"), F.col("embedding").cast("array<double>").alias("v"))
    for at in range(blocks):
        block = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == at).collect()
        if not block:
            continue
        ids = [str(r["query_id"]) for r in block]
        m = np.array([r["embedding"] for r in block], np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        sent = spark.sparkContext.broadcast((ids, m))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            best = [(np.empty(0), np.empty(0, object)) for _ in ids]
            for b in batches:
                keep = [i for i, v in enumerate(b.column("v").to_pylist()) if v is not None and len(v) == m.shape[1]]
                if not keep:
                    continue
                b = b.take(pa.array(keep))
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(keep), -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                s = m @ x.T
                names = np.array(b.column("asset_id").to_pylist(), object)
                n = min(k, len(names))
                for i, row in enumerate(s):
                    edge = np.partition(-row, n - 1)[n - 1]
                    top = np.flatnonzero(-row <= edge)
                    score, name = np.concatenate((best[i][0], row[top])), np.concatenate((best[i][1], names[top]))
                    first = np.lexsort((name.astype(str), -score))[:k]
                    best[i] = score[first], name[first]
            for query, (score, name) in zip(ids, best):
                if len(score):
                    yield pa.RecordBatch.from_arrays([pa.array([query] * len(score)), pa.array(name.tolist()), pa.array(score)], ["query_id", "asset_id", "score"])

        part = base.mapInArrow(scan, names)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], names).withColumn("rank", F.lit(0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "asset_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "asset_id", "score")


def aggregate_by_product(hits: DataFrame, links: DataFrame) -> DataFrame:
    """hits: query_id, asset_id, score; links: asset_id, product_id (of active offers and products). For each product its best image, the number of hits, and whether that image is of several products."""
    l = links.select("asset_id", "product_id").distinct()  # noqa: E741
    owners = l.groupBy("asset_id").agg(F.count("*").alias("owners"))
    j = hits.join(l, "asset_id").join(owners, "asset_id")
    best = F.min(F.struct((-F.col("score")).alias("s"), "asset_id", "owners"))
    a = j.groupBy("query_id", "product_id").agg(best.alias("b"), F.count("*").alias("hits"))
    return a.select("query_id", "product_id", (-F.col("b.s")).alias("score"), F.col("b.asset_id").alias("asset_id"), "hits", (F.col("b.owners") > 1).alias("shared"))


def filter_candidates(candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    return candidates.join(allowed.select("product_id"), "product_id", "left_semi")


def barcode_evidence(queries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """queries: query_id, codes (array of parsed GTIN-14). The product of the first code that the catalogue has."""
    c = queries.select("query_id", F.posexplode("codes").alias("pos", "value")).join(identifiers.select("value", "product_id"), "value")
    return c.groupBy("query_id").agg(F.min(F.struct("pos", "product_id", "value")).alias("m")).select("query_id", "m.product_id", F.col("m.value").alias("gtin"))


def classify_candidates(candidates: DataFrame, evidence: DataFrame, possible: float, similar: float, most: int = MOST_CANDIDATES) -> DataFrame:
    """Barcode-confirmed products first; then possible and similar ones by score; weaker ones are hidden. At most `most` a query; scores to 3 decimals."""
    j = candidates.join(evidence.select("query_id", "product_id", F.lit(True).alias("confirmed")), ["query_id", "product_id"], "full_outer")
    level = F.when(F.col("confirmed"), "confirmed").when(F.col("score") >= possible, "possible").when(F.col("score") >= similar, "similar")
    j = j.withColumn("level", level).filter("level is not null")
    w = Window.partitionBy("query_id").orderBy(F.coalesce("confirmed", F.lit(False)).desc(), F.desc_nulls_last("score"), "product_id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("query_id", "rank", "product_id", "level", F.round("score", 3).alias("score"))


def evaluate_retrieval(ranked: DataFrame, queries: DataFrame, possible: float, similar: float) -> DataFrame:
    """ranked: query_id, rank, product_id, score; queries: query_id, expected (null: absent), accepted (array of products with the same picture). One row of measures."""
    top = ranked.groupBy("query_id").agg(F.min_by("product_id", "rank").alias("first"), F.max("score").alias("best"))
    good = ranked.join(queries, "query_id").withColumn("strict", F.col("product_id") == F.col("expected")).withColumn("lenient", F.col("strict") | F.coalesce(F.array_contains("accepted", F.col("product_id")), F.lit(False)))
    at = good.groupBy("query_id").agg(F.min(F.when(F.col("strict"), F.col("rank"))).alias("strict_at"), F.min(F.when(F.col("lenient"), F.col("rank"))).alias("lenient_at"))
    q = queries.join(top, "query_id", "left").join(at, "query_id", "left")
    there, absent = F.col("expected").isNotNull(), F.col("expected").isNull()
    share = lambda c: F.avg(F.when(there, F.coalesce(c, F.lit(False)).cast("double")))
    a = q.agg(
        F.count_if(there).alias("positives"),
        F.count_if(absent).alias("negatives"),
        share(F.col("strict_at") <= 1).alias("recall_at_1"),
        share(F.col("strict_at") <= 5).alias("recall_at_5"),
        share(F.col("lenient_at") <= 1).alias("lenient_at_1"),
        share(F.col("lenient_at") <= 5).alias("lenient_at_5"),
        F.count_if(absent & (F.col("best") >= possible)).alias("false_matches"),
        F.count_if(F.coalesce(F.col("best"), F.lit(-1.0)) < similar).alias("abstained"),
        F.min(F.when(there & (F.col("strict_at") == 1), F.col("best"))).alias("lowest_correct"),
        F.max(F.when(absent, F.col("best"))).alias("highest_negative"),
        F.min("best").alias("score_min"),
    )
    quantiles = order_statistics(q, "best", {"score_p50": 0.5, "score_p95": 0.95})
    threshold = F.when(F.col("lowest_correct") > F.coalesce("highest_negative", F.lit(-1.0)), F.col("lowest_correct"))
    return a.crossJoin(F.broadcast(quantiles)).withColumn("suggested_threshold", threshold)  # one row each


def order_statistics(df: DataFrame, value: str, shares: dict[str, float], width: float = 1e-3) -> DataFrame:
    """One row: for each name the value at place floor(share * n) of the n non-null values in order (places from 0, the last one at most); null if there is none.

    Values are counted by ranges of `width` first; only the ranges that hold a place are looked into. No list of all values is made.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c")).withColumn("range", F.floor(F.col("v") / width))
    ranges = counts.groupBy("range").agg(F.sum("c").alias("m"))
    upto = ranges.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("before"), "m")  # scores lie within a few units: a few thousand ranges
    n = ranges.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"))
    place = lambda s: F.least(F.floor(F.col("n") * s), F.col("n") - 1)
    holds = lambda s, start, size: (F.col(start) <= place(s)) & (place(s) < F.col(start) + F.col(size))
    wanted = F.lit(False)
    for s in shares.values():
        wanted = wanted | holds(s, "before", "m")
    few = upto.crossJoin(F.broadcast(n)).filter(wanted)
    inner = counts.join(F.broadcast(few), "range")
    inner = inner.withColumn("at", F.col("before") + F.sum("c").over(Window.partitionBy("range").orderBy("v")) - F.col("c"))
    return inner.agg(*(F.max(F.when(holds(s, "at", "c"), F.col("v"))).alias(name) for name, s in shares.items()))


def missing_embeddings(assets: DataFrame, embeddings: DataFrame, model_key: str) -> DataFrame:
    return assets.join(embeddings.filter((F.col("model_key") == model_key) & (F.col("status") == "done")).select("asset_id"), "asset_id", "left_anti")


def index_coverage(assets: DataFrame, embeddings: DataFrame, model_key: str) -> DataFrame:
    e = embeddings.filter(F.col("model_key") == model_key).select("asset_id", "status")
    state = lambda s: F.count_if(F.col("status") == s)
    return assets.select("asset_id").join(e, "asset_id", "left").agg(F.count_distinct("asset_id").alias("assets"), state("done").alias("indexed"), state("failed").alias("failed"), F.count_if(F.coalesce("status", F.lit("pending")) == "pending").alias("pending"))


def _of_active_offers(links: DataFrame, offers: DataFrame, *columns: str) -> DataFrame:
    """offer_id, url and these columns of the links of active offers. Links that carry them (with active) aren't joined."""
    if {*columns, "active"} <= {*links.columns}:
        return links.filter("active").select("offer_id", "url", *columns)
    return links.select("offer_id", "url").join(offers.filter("active").select("offer_id", *columns), "offer_id")


def images_due_recheck(sources: DataFrame, links: DataFrame, offers: DataFrame, as_of, hours: int = 20, most: int = 5000) -> DataFrame:
    """The longest unchecked fetched sources of each supplier that an active offer uses."""
    cut = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    used = _of_active_offers(links, offers, "supplier_id").select("supplier_id", "url").distinct()
    due = sources.filter((F.col("status") == "fetched") & (F.coalesce("checked_at", "fetched_at") < cut)).join(used, ["supplier_id", "url"], "left_semi")
    w = Window.partitionBy("supplier_id").orderBy(F.coalesce("checked_at", "fetched_at"), "url")
    return due.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def image_replaced_changes(checked: DataFrame, links: DataFrame, offers: DataFrame, run_id: str, as_of) -> DataFrame:
    """checked: supplier_id, url, old_sha, new_sha. One change for each offer, with all its pictures that are new at the same address."""
    new = checked.filter(F.col("old_sha").isNotNull() & F.col("new_sha").isNotNull() & (F.col("old_sha") != F.col("new_sha")))
    rows = _of_active_offers(links, offers, "supplier_id", "product_id").join(new, ["supplier_id", "url"])
    g = rows.groupBy("supplier_id", "offer_id", "product_id").agg(F.array_sort(F.collect_set(F.struct("url", "old_sha", "new_sha"))).alias("all"))
    side = lambda f: F.to_json(F.struct(F.size("all").alias("count"), F.transform("all", lambda x: F.struct(x["url"].alias("url"), x[f].alias("sha256"))).alias("images")))
    return g.select(F.lit(run_id).alias("run_id"), "supplier_id", "offer_id", "product_id", F.lit("image_replaced").alias("change_type"), side("old_sha").alias("old_value"), side("new_sha").alias("new_value"), F.lit(None).cast("decimal(9,2)").alias("pct"), F.lit(as_of).cast("timestamp").alias("created_at"))
