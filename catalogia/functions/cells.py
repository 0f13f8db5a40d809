"""Parsing of untrusted price-list cells. Each parser gives a value and a code; both are null for an empty cell."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from catalogia.functions.text import let, trimmed

#: Cells that mean nothing (fixed values).
EMPTY_MARKERS = ["", "-", "--", "n/a", "n.a.", "na", "n/d", "nd", "null", "none", "#n/d", "#n/a"]
CURRENCY_MARK = r"(€|eur|euro|\$|usd|£|gbp|chf)"
MAX_URL = 2048
MAX_INT = 2_000_000_000
#: HTML entities that are decoded in descriptions (fixed values).
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'")]


_EMPTY = "(?i)^(?:" + "|".join(map(re.escape, EMPTY_MARKERS)) + ")$"
_LONGEST = max(map(len, EMPTY_MARKERS))


#: What most cells look like. Such cells take none of the steps that they would come out of as they are; all others take every step.
_PLAIN_TEXT, _PLAIN_MOST = r"^[!-~]+(?: [!-~]+)*\z", 500
_PLAIN_NUMBER = r"^-?[0-9]+(?:[.,][0-9]+)?\z"
_PLAIN_URL = r"https?://[a-z]+(?:\.[a-z]+)*/[A-Za-z0-9._~/-]*"
_PLAIN_URLS = rf"^{_PLAIN_URL}(?: {_PLAIN_URL})*\z"


def is_empty_cell(c: Column) -> Column:
    return _is_empty(trimmed(c))


def _is_empty(t: Column) -> Column:
    return F.coalesce((F.length(t) <= _LONGEST) & t.rlike(_EMPTY), F.lit(True))


def _result(value: Column, code: Column, kind: str) -> Column:
    return F.struct(F.when(code.isNull(), value).cast(kind).alias("value"), code.alias("code"))


# A parser is a cleaning of the cell and a reading of the cleaned text. Where many cells are parsed at once, each step is a column of its own; for a single
# expression, `let` holds the step's value.


def decimal_text(c: Column, sep: str | Column = ".") -> Column:
    """The cell without marks of currency, its decimal separator as a point and its thousands as commas; null for an empty cell."""
    t = F.translate(trimmed(c), "\u00a0", " ")
    bare = trimmed(F.regexp_replace(F.regexp_replace(t, rf"(?i)^{CURRENCY_MARK}\s*", ""), rf"(?i)\s*{CURRENCY_MARK}$", ""))
    t = F.when(t.rlike("[^-0-9., ]"), bare).otherwise(t)

    def turned(x: Column) -> Column:
        other = F.translate(x, ",.", ".,")
        if isinstance(sep, str):
            return other if sep == "," else x
        return F.when(sep == ",", other).otherwise(x)

    return F.when(c.rlike(_PLAIN_NUMBER), turned(c)).when(~is_empty_cell(c), turned(t))


def decimal_of(t: Column) -> Column:
    """struct(value decimal(38,4), code) of a cleaned text. Thousands only in groups of three; a leading group is never 0."""
    value = F.translate(t, ", ", "").try_cast("decimal(38,4)")
    right = t.rlike(r"^-?(?:[1-9][0-9]{0,2}(?:[, ][0-9]{3})+|[0-9]+)(?:\.[0-9]+)?$")
    other = t.rlike(r"^-?[0-9]+,[0-9]{1,2}$|^-?0,[0-9]+$")
    code = F.when(~right, F.when(other, "decimal_separator_mismatch").otherwise("invalid_number")).when(t.isNotNull() & value.isNull(), "invalid_number").when(t.rlike(r"\.[0-9]{5,}$"), "too_many_decimals")
    return _result(value, code, "decimal(38,4)")


def numeric_of(c: Column) -> Column:
    """struct(value decimal(38,4), code) of a cell that the file gives as a number."""
    number = F.round(trimmed(c).try_cast("double").try_cast("decimal(38,12)"), 4)
    return _result(F.when(~is_empty_cell(c), number), F.when(~is_empty_cell(c) & number.isNull(), F.lit("invalid_number")), "decimal(38,4)")


def parse_decimal(c: Column, sep: str | Column = ".", is_numeric: Column | None = None) -> Column:
    text = let(decimal_text(c, sep), decimal_of)
    return text if is_numeric is None else F.when(F.coalesce(is_numeric, F.lit(False)), numeric_of(c)).otherwise(text)


def int_of(d: Column) -> Column:
    """struct(value int, code) of a decimal."""
    v = d["value"]
    code = F.when(d["code"].isNotNull(), d["code"]).when(v != F.floor(v), "not_integer").when(v < 0, "negative").when(v > MAX_INT, "out_of_range")
    return _result(F.when(code.isNull(), v), code, "int")


def parse_non_negative_int(c: Column, sep: str | Column = ".", is_numeric: Column | None = None) -> Column:
    return let(parse_decimal(c, sep, is_numeric), int_of)


def parse_currency(c: Column) -> Column:
    s = F.upper(trimmed(c))
    code = F.when(s.isin("€", "EURO"), "EUR").when(s == "$", "USD").when(s == "£", "GBP").otherwise(s)
    return _result(F.when(~is_empty_cell(c), code), F.when(~is_empty_cell(c) & ~code.rlike("^[A-Z]{3}$"), F.lit("invalid_currency")), "string")


def vat_cell(c: Column) -> Column:
    return F.when(~is_empty_cell(c), trimmed(F.regexp_replace(trimmed(c), "%$", "")))


def vat_of(d: Column, c: Column | None = None, is_numeric: Column | None = None) -> Column:
    """struct(value, code) of a rate. A numeric cell c between 0 and 1 is a fraction; typed text between 0 and 1 is an error, never multiplied."""
    v = d["value"]
    code = F.when(d["code"].isNotNull(), d["code"]).when((v < 0) | (v >= 100), "invalid_vat_rate").when((v > 0) & (v < 1), "vat_rate_fraction")
    typed = _result(v, code, "decimal(38,4)")
    if is_numeric is None:
        return typed
    n = trimmed(c).try_cast("double")
    share = F.struct(F.round((n * 100).cast("decimal(20,8)"), 4).cast("decimal(38,4)").alias("value"), F.lit(None).cast("string").alias("code"))
    return F.when(F.coalesce(is_numeric & (n > 0) & (n < 1), F.lit(False)), share).otherwise(typed)


def parse_vat_rate(c: Column, sep: str | Column = ".", is_numeric: Column | None = None) -> Column:
    return let(parse_decimal(vat_cell(c), sep, is_numeric), lambda d: vat_of(d, c, is_numeric))


def url_parts(s: Column) -> Column:
    """struct(s, right, url, empty) of a trimmed text."""
    form = r"^(?i)(https?)://([^/?#\\\s@]+)([/?#].*)?$"
    rest = F.regexp_replace(F.regexp_extract(s, form, 3), " ", "%20")
    url = F.concat(F.lower(F.regexp_extract(s, form, 1)), F.lit("://"), F.lower(F.regexp_extract(s, form, 2)), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))
    return F.struct(s.alias("s"), s.rlike(form).alias("right"), url.alias("url"), is_empty_cell(s).alias("empty"))


def url_of(p: Column) -> Column:
    good = p["right"] & F.try_parse_url(p["url"], F.lit("HOST")).isNotNull()
    code = F.when(p["empty"], F.lit(None)).when(F.length(p["s"]) > MAX_URL, "url_too_long").when(~F.coalesce(good, F.lit(False)), "invalid_url")
    return _result(F.when(~p["empty"], p["url"]), code, "string")


def parse_http_url(c: Column) -> Column:
    """Absolute http or https only; scheme and host in lower case, an empty path as /, spaces escaped."""
    return let(let(trimmed(c), url_parts), url_of)


def split_urls(c: Column) -> Column:
    parts = F.split(c, r"(?i)[|;\n\r\t ]+|,(?=\s*https?:)")
    return F.when(is_empty_cell(c), F.array().cast("array<string>")).otherwise(F.filter(F.transform(parts, trimmed), lambda x: x != ""))


def to_plain_text(c: Column, most: int = 5000) -> Column:
    t = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</p>|</li>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        t = F.regexp_replace(t, entity, char)
    t = trimmed(F.regexp_replace(F.regexp_replace(t, r"[ \t\f\x0B]+", " "), r"(?U)\s*\n\s*", "\n"))
    cut = F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)
    return F.when(~is_empty_cell(c) & (t != ""), cut)


def plain_urls(c: Column) -> Column:
    """Whether split_urls cuts the cell at single spaces, and parse_http_url leaves every part as it is and finds no fault."""
    return F.coalesce((F.length(c) <= MAX_URL) & c.rlike(_PLAIN_URLS), F.lit(False))


def clean_text(c: Column, most: int = 500) -> Column:
    s = trimmed(F.regexp_replace(c, r"(?U)\s+", " "))
    plain = (F.length(c) <= _PLAIN_MOST) & c.rlike(_PLAIN_TEXT)
    return F.when(plain, F.when(~_is_empty(c), F.substring(c, 1, most))).when(~is_empty_cell(c) & (s != ""), F.substring(s, 1, most))


def csv_cell(c: Column) -> Column:
    """For a ;-separated file: a cell that a spreadsheet could take for a formula gets a leading apostrophe, unless it is a plain number."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.when(s.rlike(r"^[=+\-@\t\r]") & ~s.rlike(r"^[-+]?[0-9]+([.,][0-9]+)?$"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike('[";\\n\\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def stable_hash(*cols: Column) -> Column:
    """SHA-256 of a JSON text with nulls written and map keys in order: equal values, equal hashes."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def sorted_map(c: Column) -> Column:
    return F.array_sort(F.map_entries(c))
