"""Rows as most lists have them are normalised on a short way, with the same result."""

from pyspark.sql import functions as F

from catalogia.functions import cells
from catalogia.operators import mapping, normalize
from catalogia.plans import adapter as A
from catalogia.sources import pricelists


def test_plain_cells_take_the_short_way(spark):
    """What most rows hold came to functions on arrays, which run uncompiled, and through every step of cleaning."""
    fields = F.create_map(*[x for f, c in (("sku", "S"), ("price", "P")) for x in (F.lit(f), F.array(F.lit(c)))])
    m = F.struct(fields.alias("fields"), F.lit(None).alias("tiers")).cast(mapping.MAPPING_TYPE)
    runs = spark.range(1).select(F.lit("r").alias("run_id"), F.lit("delta").alias("mode"), F.lit(A.NOW).cast("timestamp").alias("as_of"), F.lit(",").alias("decimal_separator"), m.alias("mapping"), A.list_defaults().alias("defaults"))
    runs = spark.createDataFrame(runs.collect(), runs.schema)
    rows = spark.createDataFrame([("r", "1", 2, {"S": "A b", "P": "1,5"}, None, None, None), ("r", "1", 3, {"S": " A  b ", "P": "€ 1,5"}, None, None, None)], pricelists.STAGED)
    n = normalize.normalize_rows(rows, runs, mapping.mapped_fields(runs))
    a, b = n.orderBy("row_number").collect()
    assert a.offer == b.offer and a.row_hash == b.row_hash and str(a.offer.price) == "1.5000"
    plan = n.select("offer")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_filter" not in plan and "parse_url" not in plan
    with_tiers = runs.withColumn("mapping", F.col("mapping").withField("tiers", F.array(F.struct(F.lit("P").alias("column"), F.lit(5).alias("min_qty")))))
    assert mapping.mapped_fields(with_tiers) == {"sku", "price", mapping.PRICE_TIERS}


def test_plain_addresses_and_texts_are_what_the_long_way_makes_of_them(spark):
    odd = ["http://a/b", "http://a/b https://c.d/e", "http://a/b  http://c/d", "http://a/b\n", "http://a", "http://A/b", "http://1.2/x", "http://a/b,http://c/d", " http://a/b", "http://a-/b", "x", "", None, "http://a/" + "b" * 2048]
    df = spark.createDataFrame([(c,) for c in odd], "c string").coalesce(1)
    parsed = F.transform(cells.split_urls(F.col("c")), cells.parse_http_url)
    rows = df.select("c", cells.plain_urls(F.col("c")).alias("plain"), parsed.alias("long")).collect()
    assert [r.c for r in rows if r.plain] == odd[:2]
    assert all([x.value for x in r.long] == r.c.split(" ") and not any(x.code for x in r.long) for r in rows if r.plain)
