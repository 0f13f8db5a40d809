"""Duplicate suggestions: products with similar titles, and those with the same picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from catalogia.functions.text import fold_text, trigram_similarity, trigrams
from catalogia.operators.identity import brands_conflict
from catalogia.sources.scratch import saved

CANDIDATE, SUGGESTED, MOST = 0.3, 0.6, 5


def suggestion_sources(products: DataFrame, touched: DataFrame) -> DataFrame:
    return products.filter((F.col("status") == "active") & ~F.col("has_gtin") & (F.length("title") >= 4)).join(touched.select("product_id"), "product_id", "left_semi")


def _gram_sets(texts: DataFrame, name: str) -> DataFrame:
    """id, text, grams and their number of each different text. An id may belong to several texts: pairs are told by the texts themselves."""
    t = texts.select(F.col(name).alias("text")).distinct()
    return t.select(F.xxhash64("text").alias("id"), "text", trigrams(F.col("text")).alias("grams")).withColumn("n", F.size("grams")).filter("n > 0")


def similar_texts(left: DataFrame, right: DataFrame, least: float = CANDIDATE) -> DataFrame:
    """left: a; right: b (folded texts). Pairs a, b whose trigram sets' similarity (shared over all) is `least` or above, with it.

    Sizes first: a text with more than 1 / least times the grams of the largest left one can't be similar to any. Then an inverted index: of sets so similar,
    the first n - ceil(least * n) + 1 grams of both, the rarest first, share one. Only ids and sizes go through it, a hot gram is split by Spark's skew
    join, and each candidate pair is compared once, by its whole sets. Nothing is capped.
    """
    x, y = _gram_sets(left, "a"), _gram_sets(right, "b")
    most = x.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))  # one row
    y = y.crossJoin(F.broadcast(most)).filter(F.col("n") * least <= F.col("most")).drop("most")
    freq = y.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))

    def first_grams(t: DataFrame, id_: str, n: str) -> DataFrame:
        rows = t.select("id", "n", F.explode("grams").alias("gram")).join(freq, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("id", "n").orderBy("df", "gram"))
        few = rows.withColumn("r", rank).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
        return few.select(F.col("id").alias(id_), F.col("n").alias(n), "gram")

    met = first_grams(x, "i", "nx").join(first_grams(y, "j", "ny"), "gram").filter((F.col("nx") >= F.col("ny") * least - 1e-9) & (F.col("ny") >= F.col("nx") * least - 1e-9))
    pairs = met.select("i", "j").distinct()
    pairs = pairs.join(x.select(F.col("id").alias("i"), F.col("text").alias("a"), F.col("grams").alias("gx")), "i").join(y.select(F.col("id").alias("j"), F.col("text").alias("b"), F.col("grams").alias("gy")), "j")
    shared = F.size(F.array_intersect("gx", "gy"))
    return pairs.select("a", "b", (shared / (F.size("gx") + F.size("gy") - shared)).alias("similarity")).filter(F.col("similarity") >= least)


#: Bits of the map of the titles' trigrams. Two trigrams at one bit only make classes finer.
_BITS = 1 << 16


def _gram_map(grams: DataFrame) -> DataFrame:
    """grams: gram. One row: bits, an array of longs with a bit for each gram."""
    h = grams.select(F.pmod(F.xxhash64("gram"), F.lit(_BITS)).cast("int").alias("h"))
    longs = h.groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, h & 63)")).alias("bits"))
    found = longs.agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"))
    return found.select(F.transform(F.sequence(F.lit(0), F.lit(_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("bits"))


def _set_in(gram: Column) -> Column:
    h = F.pmod(F.xxhash64(gram), F.lit(_BITS)).cast("int")
    return F.bit_get(F.element_at("bits", F.shiftright(h, 6) + 1), h.bitwiseAND(63)) == 1


def _classes(titles: DataFrame, products: DataFrame, least: float) -> DataFrame:
    """titles: grams; products: candidate_id, title_key, b. The products that can be similar to a title, as candidate_id, title_key, n, held.

    held is the concatenation of b's grams that titles have, in order, n the number of all its grams: products with the same title_key, n and held are
    alike for every title. A text so similar has at least least * n of the titles' grams.
    """
    y = products.withColumn("grams", trigrams(F.col("b"))).crossJoin(F.broadcast(_gram_map(titles.select(F.explode("grams").alias("gram")))))
    y = y.select("candidate_id", "title_key", F.size("grams").alias("n"), F.array_join(F.sort_array(F.filter("grams", _set_in)), "").alias("held"))
    return y.filter((F.col("held") != "") & (F.length("held") >= 3 * (F.col("n") * least - 1e-9)))


def _similar_classes(x: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """x: a, grams, n; classes: cid, n, held. Pairs a, cid of at least that similarity, by the index of similar_texts.

    Of a class only the grams that titles have go through it: all others come first in the common order, so they only shorten its prefix.
    """
    y = classes.withColumn("grams", F.transform(F.sequence(F.lit(0), (F.length("held") / 3 - 1).cast("int")), lambda i: F.substring(F.col("held"), i * 3 + 1, F.lit(3))))
    freq = y.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))

    def first_grams(t: DataFrame, key: str, n: str) -> DataFrame:
        few = F.size("grams") - F.ceil(F.col("n") * least - 1e-9) + 1
        rows = t.select(key, F.col("n").alias(n), few.alias("few"), F.explode("grams").alias("gram")).join(freq, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        rank = F.row_number().over(Window.partitionBy(key).orderBy("df", "gram"))
        return rows.withColumn("r", rank).filter("r <= few").select(key, n, "gram")

    met = first_grams(x, "a", "nx").join(first_grams(y, "cid", "ny"), "gram").filter((F.col("nx") >= F.col("ny") * least - 1e-9) & (F.col("ny") >= F.col("nx") * least - 1e-9))
    both = met.select("a", "cid").distinct().join(x.select("a", F.col("grams").alias("gx")), "a").join(y.select("cid", "n", F.col("grams").alias("gy")), "cid")
    shared = F.size(F.array_intersect("gx", "gy"))
    return both.filter(shared / (F.size("gx") + F.col("n") - shared) >= least).select("a", "cid")


def title_candidates(sources: DataFrame, products: DataFrame, least: float = CANDIDATE, most: int = MOST, decided: DataFrame | None = None) -> DataFrame:
    """product_id, candidate_id, similarity: of the other active products whose search text is similar to the title (`least` or above), the `most` with
    the most similar titles, ties by id, without pairs of decided (a < b). Products without a title neither ask nor are found.

    A title is compared once, however many products ask with it, and products that no title can tell apart (_classes) are compared once. Of what a title
    finds, `need` can matter: `most`, one more for the product itself, and one for each pair that was decided for it. So classes behind enough products
    with more similar titles, and all but the first `need` members of a class, are left out before members are named; each product then takes its own
    places of its title's list.
    """
    titled = lambda df: df.withColumn("key", fold_text(F.col("title"))).filter("key <> ''")
    s = titled(sources).select("product_id", F.col("key").alias("a"))
    p = titled(products.filter("status = 'active'")).select(F.col("product_id").alias("candidate_id"), F.col("key").alias("title_key"), fold_text(F.col("search_text")).alias("b"))
    if decided is None:
        s = s.withColumn("spare", F.lit(0))
    else:
        sides = decided.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("product_id")).groupBy("product_id").agg(F.count("*").cast("int").alias("spare"))
        s = s.join(sides, "product_id", "left").withColumn("spare", F.coalesce("spare", F.lit(0)))
    asked = s.groupBy("a").agg((F.max("spare") + most + 1).alias("need"))
    x = asked.withColumn("grams", trigrams(F.col("a"))).withColumn("n", F.size("grams")).filter("n > 0")
    alike = ["title_key", "n", "held"]
    in_class = Window.partitionBy(*alike).orderBy("candidate_id")
    # A class goes by its smallest product.
    members = saved(_classes(x, p, least).withColumns({"cid": F.first("candidate_id").over(in_class), "place": F.row_number().over(in_class)}), "members")
    classes = saved(members.groupBy("cid").agg(F.count("*").alias("size")).join(members.filter("place = 1").select("cid", *alike), "cid"), "classes")
    near = _similar_classes(x, classes, least).join(classes.select("cid", "title_key", "size"), "cid").join(x.select("a", "need"), "a")
    titles = near.select("a", "title_key").distinct().withColumn("similarity", trigram_similarity(F.col("a"), F.col("title_key")))
    near = near.join(titles, ["a", "title_key"])
    before = F.sum("size").over(Window.partitionBy("a").orderBy(F.desc("similarity"))) - F.sum("size").over(Window.partitionBy("a", "similarity"))
    near = near.withColumn("before", before).filter("before < need")
    places = near.select("a", "cid", "similarity", "need", F.explode(F.sequence(F.lit(1), F.least("need", "size").cast("int"))).alias("place"))
    far = asked.agg(F.coalesce(F.max("need"), F.lit(0)).alias("far"))  # one row
    named = members.select("cid", "place", "candidate_id").crossJoin(F.broadcast(far)).filter("place <= far").drop("far")
    top = places.join(named, ["cid", "place"]).withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "candidate_id"))).filter("r <= need")
    mine = s.select("product_id", "a", F.explode(F.sequence(F.lit(1), F.col("spare") + most + 1)).alias("r"))
    found = mine.join(top.select("a", "r", "candidate_id", "similarity"), ["a", "r"]).filter("product_id <> candidate_id").select("product_id", "candidate_id", "similarity")
    if decided is not None:
        found = exclude_distinct_pairs(found, decided)
    return found.withColumn("r", F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("similarity"), "candidate_id"))).filter(F.col("r") <= most).select("product_id", "candidate_id", "similarity")


def same_image_pairs(links: DataFrame) -> DataFrame:
    """links: product_id, asset_id. Pairs that share a picture, as a star: each product with the smallest that has the picture. A picture of thousands makes thousands of rows, not their square."""
    l = links.select("product_id", "asset_id").distinct()  # noqa: E741
    first = l.groupBy("asset_id").agg(F.min("product_id").alias("first"))
    return l.join(first, "asset_id").filter("product_id <> first").select(F.col("first").alias("product_id"), F.col("product_id").alias("candidate_id")).distinct()


def exclude_distinct_pairs(pairs: DataFrame, decided: DataFrame) -> DataFrame:
    """Without those that were decided to be different (decided: a < b)."""
    named = pairs.withColumns({"a": F.least("product_id", "candidate_id"), "b": F.greatest("product_id", "candidate_id")})
    return named.join(decided.select("a", "b").distinct(), ["a", "b"], "left_anti").drop("a", "b")


def suggest_duplicates(sources: DataFrame, products: DataFrame, decided: DataFrame, links: DataFrame, least: float = SUGGESTED) -> DataFrame:
    """product_id, candidate_id, score, reasons: similar titles of brands that don't conflict. A shared picture is only a further reason.

    Decided pairs (a < b) are left out before the best are taken. Pictures (links: product_id, asset_id) are looked up for the few candidates alone.
    """
    near = title_candidates(sources, products, decided=decided).filter(F.col("similarity") >= least)
    brand = products.select("product_id", "brand")
    both = near.join(brand, "product_id").join(brand.select(F.col("product_id").alias("candidate_id"), F.col("brand").alias("other_brand")), "candidate_id")
    ok = both.filter(~brands_conflict(F.col("brand"), F.col("other_brand")))
    has = links.select("product_id", "asset_id").filter("asset_id is not null").distinct()
    theirs = has.withColumnRenamed("product_id", "candidate_id")
    shared = ok.select("product_id", "candidate_id").join(has, "product_id").join(theirs, ["candidate_id", "asset_id"]).select("product_id", "candidate_id").distinct()
    ok = ok.join(shared.withColumn("same_image", F.lit(True)), ["product_id", "candidate_id"], "left")
    same_brand = F.col("brand").isNotNull() & F.col("other_brand").isNotNull()
    reasons = F.array_compact(F.array(F.lit("title_similarity"), F.when(same_brand, "same_brand"), F.when(F.col("same_image"), "same_image")))
    return ok.select("product_id", "candidate_id", F.col("similarity").alias("score"), reasons.alias("reasons"))
