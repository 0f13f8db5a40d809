"""GTIN validation in Column expressions. Codes are never repaired; the canonical form has 14 digits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from catalogia.functions.text import let, trimmed


def gs1_check_digit(body: Column) -> Column:
    """Weights 3, 1, 3, ... from the right."""
    digits = F.transform(F.reverse(F.split(body, "(?<=.)(?=.)")), lambda d: d.try_cast("int"))
    return F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x, lambda total: (10 - total % 10) % 10)


def is_valid_check_digit(code: Column) -> Column:
    return let(code, _checked)


def _checked(digits: Column) -> Column:
    n = F.length(digits)
    return gs1_check_digit(digits.substr(F.lit(1), n - 1)) == digits.substr(n, F.lit(1)).try_cast("int")


def is_restricted_circulation(digits: Column) -> Column:
    """Numbers for use within a shop or firm, coupons and refunds; 8-digit codes by their first digit, also in their 14-digit form.

    The ranges are GS1's (fixed values).
    """
    g = F.lpad(digits, 14, "0")
    short = (F.length(digits) == 8) | g.startswith("000000")
    first = F.when(F.length(digits) == 8, F.substring(digits, 1, 1)).otherwise(F.substring(g, 7, 1))
    p = F.substring(g, 2, 3).try_cast("int")
    inside = p.between(20, 29) | p.between(40, 59) | p.between(200, 299) | p.between(980, 984) | p.between(990, 999)
    return F.when(short, first.isin("0", "2")).otherwise(inside)


def barcode_text(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit(""))


def barcode_parts(t: Column) -> Column:
    """struct(t, grouped, digits, long) of a trimmed text; long: the digits with zeros before them, 14 in all."""
    grouped = t.rlike("^[0-9]+([ -][0-9]+)+$")
    digits = F.when(grouped, F.translate(t, " -", "")).otherwise(t)
    return F.struct(t.alias("t"), grouped.alias("grouped"), digits.alias("digits"), F.lpad(digits, 14, "0").alias("long"))


def _check_holds(long: Column) -> Column:
    """Of 14 digits: weights 3, 1, 3, ... from the right."""
    digit = lambda k: F.substring(long, k, 1).try_cast("int")
    total = digit(1) * 3
    for k in range(2, 14):
        total = total + (digit(k) * 3 if k % 2 else digit(k))
    return F.coalesce((total + digit(14)) % 10 == 0, F.lit(False))


def barcode_issue(p: Column) -> Column:
    """struct(form, issue) of the parts."""
    t, digits = p["t"], p["digits"]
    n = F.length(digits)
    form = F.when(n == 8, "EAN-8").when(n == 12, "UPC-A").when(n == 13, "EAN-13").when(n == 14, "GTIN-14")
    issue = (
        F.when(t == "", F.lit(None))
        .when(~digits.rlike("^[0-9]+$"), F.when(t.rlike("^[0-9]+([.,][0-9]+)?[eE][+-]?[0-9]+$"), "scientific_notation").otherwise("not_digits"))
        .when(form.isNull(), "unsupported_length")
        .when(p["long"] == "0" * 14, "all_zeros")
        .when(~_check_holds(p["long"]), "bad_check_digit")
    )
    return F.struct(form.alias("form"), issue.alias("issue"))


def barcode_of(p: Column, q: Column, raw: Column) -> Column:
    """struct(status, raw, gtin14, format, issue, formatting_removed) of the parts and their issue."""
    t, digits, issue = p["t"], p["digits"], q["issue"]
    status = F.when(t == "", "missing").when(issue.isNotNull(), "invalid").when(is_restricted_circulation(digits), "restricted").otherwise("valid")
    return F.struct(
        status.alias("status"),
        raw.alias("raw"),
        F.when((t != "") & issue.isNull(), p["long"]).alias("gtin14"),
        F.when((t != "") & digits.rlike("^[0-9]+$"), q["form"]).alias("format"),
        issue.alias("issue"),
        (p["grouped"] & (t != "")).alias("formatting_removed"),
    )


def parse_barcode(c: Column) -> Column:
    """struct(status, raw, gtin14, format, issue, formatting_removed)."""
    both = let(let(barcode_text(c), barcode_parts), lambda p: F.struct(p.alias("p"), barcode_issue(p).alias("q")))
    return let(both, lambda x: barcode_of(x["p"], x["q"], c))


def display_gtin(g: Column) -> Column:
    return F.when(g.startswith("0"), g.substr(F.lit(2), F.length(g))).otherwise(g)


def expand_upc_e(c: Column) -> Column:
    """The 12-digit form of an 8-digit zero-suppressed code; null if it isn't one or its check digit is wrong."""
    d = [F.substring(c, k, 1) for k in range(1, 9)]
    zeros = lambda n: F.lit("0" * n)
    last = d[6]
    body = (
        F.when(last.isin("0", "1", "2"), F.concat(d[1], d[2], last, zeros(4), d[3], d[4], d[5]))
        .when(last == "3", F.concat(d[1], d[2], d[3], zeros(5), d[4], d[5]))
        .when(last == "4", F.concat(d[1], d[2], d[3], d[4], zeros(5), d[5]))
        .otherwise(F.concat(d[1], d[2], d[3], d[4], d[5], zeros(4), last))
    )
    return let(F.concat(d[0], body, d[7]), lambda full: F.when(c.rlike("^[01][0-9]{7}$") & F.coalesce(is_valid_check_digit(full), F.lit(False)), full))
