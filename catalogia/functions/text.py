"""Text folding and trigram similarity as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Company forms that a brand's name doesn't need (fixed values).
LEGAL_SUFFIXES = ["srl", "srls", "spa", "sas", "snc", "inc", "ltd", "llc", "gmbh", "ag", "sa", "sl", "bv", "co", "corp", "limited", "company", "group", "kg", "ohg", "sarl", "ab", "oy", "as"]


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters that are left without them."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and "a" <= b[0] <= "z" and all(unicodedata.combining(x) for x in b[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _accents()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it: nested parsers would double the expression at every level."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Unicode's white space (fixed values).
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def fold_text(c: Column) -> Column:
    """Lower case, without marks; & as the word and; anything else that isn't a letter or digit as one space."""
    bare = F.regexp_replace(F.lower(c), "[̀-ͯ]", "")
    bare = F.regexp_replace(F.translate(bare, _MARKED, _PLAIN), "&", " and ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def words(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda w: w != "")


def normalize_brand(c: Column) -> Column:
    kept = F.filter(words(fold_text(c)), lambda w: ~w.isin(LEGAL_SUFFIXES))
    return F.nullif(F.array_join(kept, ""), F.lit(""))


def normalize_attribute(c: Column) -> Column:
    return F.nullif(F.regexp_replace(fold_text(c), " ", ""), F.lit(""))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each folded word, with two spaces before it and one behind."""
    grams = F.transform(words(fold_text(c)), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda k: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where either side has none."""

    def of(p: Column) -> Column:
        x, y = p["x"], p["y"]
        shared = F.size(F.array_intersect(x, y))
        return F.when((F.size(x) <= 0) | (F.size(y) <= 0), F.lit(0.0)).otherwise(shared / (F.size(x) + F.size(y) - shared))

    return let(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y")), of)
