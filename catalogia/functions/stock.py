"""Stock and availability: an unknown quantity stays null, and words never become quantities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalogia.functions.cells import MAX_INT, is_empty_cell
from catalogia.functions.text import let, trimmed

#: What suppliers write, in the order in which it is looked up (fixed values).
AVAILABILITY_WORDS = [
    ("out_of_stock", r"non disponibile|esaurit[oa]|out of stock|sold ?out|non disp\.?|no|0 disponibili|terminat[oa]|unavailable"),
    ("on_order", r"in arrivo|su ordinazione|in riordino|backorder|on order|preorder|pre-?ordine|in produzione|da ordinare"),
    ("low_stock", r"scarsa disponibilit[aà]|ultimi pezzi|pochi pezzi|limited|low|low stock|disponibilit[aà] limitata"),
    ("in_stock", r"disponibile|in stock|available|s[iì]|yes|y|ok|in magazzino|pronta consegna|disp\.?"),
]
#: Units of a delivery time (fixed values).
WEEKS, DAYS = r"settimane|settimana|sett|weeks?|w", r"gg|g|giorni|giorno|days?|d"
MAX_LEAD_DAYS = 3650


def availability_text(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(trimmed(c), r"(?U)\s+", " "), F.lit(""))


def availability_from_text(c: Column) -> Column:
    return let(availability_text(c), availability_of)


def availability_of(t: Column) -> Column:
    out = F.when(t == "", "unknown")
    out = out.when(t.rlike(r"^[<>]=?\s*[0-9]+$|^[0-9]+\+$"), F.when(t.rlike(r"^<=?\s*0$"), "out_of_stock").otherwise("in_stock"))
    for status, words in AVAILABILITY_WORDS:
        out = out.when(t.rlike(rf"(?iu)^({words})$"), status)
    return out.otherwise("unknown")


def quantity_parts(s: Column) -> Column:
    """struct(s, whole, minus, n, some) of a trimmed text."""
    whole = s.rlike("^[0-9]+([.,]0+)?$")
    n = F.when(whole, F.coalesce(F.regexp_extract(s, "^([0-9]+)", 1).try_cast("decimal(38,0)"), F.lit(MAX_INT + 1)))
    some = F.coalesce(whole, F.lit(False)) | ~is_empty_cell(s)
    return F.struct(s.alias("s"), whole.alias("whole"), (s.startswith("-") & s.rlike("^-[0-9]+([.,]0+)?$")).alias("minus"), n.alias("n"), some.alias("some"))


def quantity_of(p: Column) -> Column:
    some, n, no = p["some"], p["n"], F.lit(False)
    return F.struct(
        F.when(some & (n <= MAX_INT), n).cast("int").alias("quantity"),
        F.when(some & ~p["whole"] & ~p["minus"], p["s"]).alias("text"),
        F.coalesce(some & p["minus"], no).alias("negative"),
        F.coalesce(some & (n > MAX_INT), no).alias("out_of_range"),
    )


def split_quantity_cell(c: Column) -> Column:
    """struct(quantity int, text, negative, out_of_range)."""
    return let(let(trimmed(c), quantity_parts), quantity_of)


def resolve_stock(quantity: Column, text: Column) -> Column:
    """The status: the text's where the quantity is unknown; else the quantity's, which on_order and low_stock refine."""
    return let(availability_from_text(text), lambda said: resolved_stock(quantity, said))


def resolved_stock(quantity: Column, said: Column) -> Column:
    return F.when(quantity.isNull(), said).when(quantity == 0, F.when(said == "on_order", "on_order").otherwise("out_of_stock")).otherwise(F.when(said == "low_stock", "low_stock").otherwise("in_stock"))


def is_available(status: Column) -> Column:
    return status.isin("in_stock", "low_stock")


def lead_time_of(s: Column) -> Column:
    """Days of a trimmed text in lower case."""
    form = rf"^([0-9]+)(?:\s*[-–a/]\s*([0-9]+))?\s*({DAYS}|{WEEKS})?\.?\s*(lavorativi)?$"
    high = F.regexp_extract(s, form, 2)
    n = F.when(high != "", high).otherwise(F.regexp_extract(s, form, 1)).try_cast("decimal(38,0)")
    days = n * F.when(F.regexp_extract(s, form, 3).rlike(f"^({WEEKS})$"), 7).otherwise(1)
    return F.when(~is_empty_cell(s) & s.rlike(form) & (days <= MAX_LEAD_DAYS), days).cast("int")


def parse_lead_time_days(c: Column) -> Column:
    """The upper end of a range, in days; null beyond ten years or where it isn't understood."""
    return let(trimmed(F.lower(c)), lead_time_of)
