"""Price comparison: only offers whose price means the same are compared, by the exact net price of a single unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def net_price(price: Column, vat_treatment: Column, vat_rate: Column) -> Column:
    """decimal(20,6), half up: the net price as it is, or the gross one without its rate."""
    gross = F.round(((price * 100).cast("decimal(18,6)") / (vat_rate + 100).cast("decimal(11,6)")), 6).cast("decimal(20,6)")
    return F.when(vat_treatment == "net", price.cast("decimal(20,6)")).when(vat_treatment == "gross", gross)


def unit_price(net: Column, units: Column) -> Column:
    return F.round(net.cast("decimal(16,6)") / units.cast("decimal(11,0)"), 6).cast("decimal(20,6)")


def evaluate_price(offers: DataFrame) -> DataFrame:
    """offers with reasons, comparable, net_price, unit_exact (6 decimals, for ranking), net_pack_price, net_unit_price (4 decimals), net_derived_from_gross."""
    price, units = F.col("price"), F.col("units_per_pack")
    no_units = units.isNull() | (units == 0)
    reason = lambda cond, name: F.when(cond, F.lit(name))
    reasons = F.array_compact(
        F.array(
            reason(~F.col("active"), "inactive"),
            F.when(price.isNull(), "missing_price").when(price == 0, "zero_price"),
            reason(F.coalesce("currency", F.lit("")) == "", "missing_currency"),
            F.when(price.isNotNull() & (F.col("vat_treatment") == "gross") & F.col("vat_rate").isNull(), "gross_without_rate").when(price.isNotNull() & ~F.col("vat_treatment").isin("net", "gross"), "unknown_vat"),
            reason(no_units, "unknown_pack"),
        )
    )
    out = offers.withColumn("reasons", reasons).withColumn("comparable", F.size("reasons") == 0).withColumn("net_price", net_price(price, F.col("vat_treatment"), F.col("vat_rate")))
    out = out.withColumn("unit_exact", F.when(~no_units, unit_price(F.col("net_price"), units)))
    return out.withColumns(
        {
            "net_pack_price": F.round("net_price", 4).cast("decimal(18,4)"),
            "net_unit_price": F.round("unit_exact", 4).cast("decimal(18,4)"),
            "net_derived_from_gross": (F.col("vat_treatment") == "gross") & F.col("net_price").isNotNull(),
        }
    )


BEST = ["offer_id", "supplier_id", "unit_price", "currency", "stock_status", "moq", "units_per_pack"]


def summarize_prices(offers: DataFrame) -> DataFrame:
    """offers: active and inactive, with supplier_priority. A row for each product_id: currency, best and cheaper_sold_out (structs), comparable_count, not_comparable_count, other_currencies.

    Two aggregates, both combined in the tasks first: by product and currency, then the few currencies of a product.
    """
    e = evaluate_price(offers.filter("active"))
    order = F.struct(
        F.col("unit_exact"), F.coalesce("moq", F.lit(1)).alias("moq1"), F.col("supplier_priority"), F.col("offer_id"),
        "supplier_id", F.col("net_unit_price").alias("unit_price"), "currency", "stock_status", "moq", "units_per_pack",
    )
    sold_out = F.coalesce(F.col("stock_status") == "out_of_stock", F.lit(False))
    by = e.groupBy("product_id", "currency").agg(
        F.count_if("comparable").alias("n"),
        F.count_if(~F.col("comparable")).alias("others"),
        F.min(F.when(F.col("comparable") & ~sold_out, order)).alias("b"),
        F.min(F.when(F.col("comparable") & sold_out, order)).alias("s"),
    )
    rank = F.struct((-F.col("n")).alias("n"), (F.col("currency") != "EUR").alias("eur"), "currency", F.col("b"), F.col("s"))
    top = by.groupBy("product_id").agg(
        F.min(F.when(F.col("n") > 0, rank)).alias("t"),
        F.sum("n").alias("comparable_count"),
        F.sum("others").alias("not_comparable_count"),
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.col("currency")))).alias("all"),
    )
    as_best = lambda x: F.when(x.isNotNull(), F.struct(*(x[c].alias(c) for c in BEST)))
    b, s = F.col("t.b"), F.col("t.s")
    cheaper = F.when(b.isNull() | (s["unit_exact"] < b["unit_exact"]), s)
    return top.select(
        "product_id",
        F.col("t.currency").alias("currency"),
        as_best(b).alias("best"),
        as_best(cheaper).alias("cheaper_sold_out"),
        "comparable_count",
        "not_comparable_count",
        F.filter("all", lambda c: c != F.col("t.currency")).alias("other_currencies"),
    )


def price_change_pct(old: Column, new: Column) -> Column:
    """Half up at 6, then 2 decimals; null from 0 or beyond what (9,2) holds."""
    raw = F.round(((new - old).cast("decimal(16,4)") * 100).cast("decimal(20,4)").cast("decimal(20,6)") / F.nullif(old, F.lit(0).cast("decimal(14,4)")).cast("decimal(14,4)"), 6)
    return F.when(F.abs(raw) <= 9_999_999, F.round(raw, 2)).cast("decimal(9,2)")
