"""Whether an offer may be the trade item that its GTIN belongs to: brand and a few attributes, never the title."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalogia.functions.text import let, normalize_attribute, normalize_brand

IDENTITY_ATTRIBUTES = ["color", "size", "variant", "net_content", "pieces"]


def brands_conflict(a: Column, b: Column) -> Column:
    """Both known and different; one that holds the other (3 letters or more) is the same brand."""

    def of(p: Column) -> Column:
        x, y = p["x"], p["y"]
        first = F.length(x) <= F.length(y)
        holds = F.when(first, (F.length(x) >= 3) & F.contains(y, x)).otherwise((F.length(y) >= 3) & F.contains(x, y))
        return F.coalesce((x != y) & ~holds, F.lit(False))

    return let(F.struct(normalize_brand(a).alias("x"), normalize_brand(b).alias("y")), of)


def detect_identity_conflicts(brand: Column, attributes: Column, product_brand: Column, product_attributes: Column) -> Column:
    """array<struct<code, field, offer_value, product_value>>: the brand first, then the attributes in order."""
    found = lambda code, field, a, b: F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), a.alias("offer_value"), b.alias("product_value"))
    unlike = lambda a, b: F.coalesce(a != b, F.lit(False))
    # Equal texts are no conflict, nor is one that is missing: most rows need no folding, which runs uncompiled.
    odd, items = unlike(brand, product_brand), [F.when(brands_conflict(brand, product_brand), found("brand_mismatch", "brand", brand, product_brand))]
    for field in IDENTITY_ATTRIBUTES:
        a, b = F.try_element_at(attributes, F.lit(field)), F.try_element_at(product_attributes, F.lit(field))
        odd = odd | unlike(a, b)
        items.append(F.when(normalize_attribute(a) != normalize_attribute(b), found("attribute_mismatch", field, a, b)))
    return F.when(odd, F.array_compact(F.array(*items))).otherwise(F.array().cast("array<struct<code: string, field: string, offer_value: string, product_value: string>>"))
