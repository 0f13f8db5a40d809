"""Connected components of a link table by repeated joins; nothing is gathered on the driver but one count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalogia.llm import common

MAX_ROUNDS = 60
#: A node with more neighbours is a hub: its rows aren't brought together to tell them its smallest neighbour.
HUB = 10_000


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root: the smallest node that can be reached, for every node of a link.

    Each round links every node's larger neighbours to its smallest one, then every node's smaller neighbours to the smallest
    (large star, small star): chains shrink by halves, and a hub's rows are summed in the tasks before they are exchanged.
    Loops and repeated links do no harm. There can't be more hubs than links / HUB; they are broadcast up to common.SMALL_ROWS of them. The table of each round is written to the shared folder.
    """
    edges = common.saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for k in range(MAX_ROUNDS):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        hubs, upward = least.filter(F.col("n") > HUB).select("u", "m"), both.filter("v > u")
        least = least.select("u", "m")
        met = upward.join(least, "u")
        if n_hubs := hubs.count():
            hubs = common.small_or_not(common.saved(hubs, f"hubs-{k}"), n_hubs)
            met = upward.join(hubs.select("u"), "u", "left_anti").join(least, "u").unionByName(upward.join(hubs, "u"))
        large = met.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = common.saved(small.filter("u <> v").distinct(), f"links-{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("v").agg(F.first("v").alias("root")).select(F.col("v").alias("node"), "root")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
