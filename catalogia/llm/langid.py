"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3 characters of padded words), in order. A document's own
list is compared with each profile by the out-of-place distance: the sum, over the document's n-grams, of how far their ranks differ;
an n-gram that the profile lacks costs PROFILE. The language with the smallest distance is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from catalogia.llm import common

PROFILE = 300
#: Training documents a language, chosen by a hash of their ids; all are used where there are fewer.
TRAIN_DOCS = 3_000
UNKNOWN = "und"
_GAP = 0


def _symbol_table() -> np.ndarray:
    """For each character of the basic plane: itself in lower case if it is a letter, else the gap."""
    out = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Letters in lower case, with one gap before, between and after runs of them; letters beyond the basic plane count as one letter, all else there as a gap."""
    if not _TABLE:
        _TABLE.append(_symbol_table())
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    s = _TABLE[0][np.minimum(cp, 0xFFFF)]
    if cp.size and cp.max() > 0xFFFF:
        far = np.flatnonzero(cp > 0xFFFF)
        kinds, which = np.unique(cp[far], return_inverse=True)
        s[far] = np.array([0xFFFD if chr(c).isalpha() else _GAP for c in kinds.tolist()], np.int64)[which]
    s = np.concatenate(([_GAP], s, [_GAP]))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != _GAP) | (s[:-1] != _GAP)
    return s[keep]


def grams(s: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 symbols, without the gap alone: 16 bits a symbol, shorter ones in the lower bits."""
    one = s[s != _GAP]
    two = s[:-1] << 16 | s[1:]
    three = s[:-2] << 32 | s[1:-1] << 16 | s[2:]
    mid = s[1:-1] != _GAP  # no n-gram goes over a gap; a leading gap makes a code with high zero bits, told apart by the length bit
    return np.concatenate((one, two | 1 << 48, three[mid] | 1 << 49))


def ranked(codes: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent codes, the most frequent first, ties to the smaller code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        sure, edge = values[counts > least], values[counts == least]
        counts = np.concatenate((counts[counts > least], np.full(most - len(sure), least)))
        values = np.concatenate((sure, edge[: most - len(sure)]))
    return values[np.argsort(-counts, kind="stable")]


def train_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[int]]]:
    """Profiles of each non-null language of docs. Counts are summed in the tasks before they are exchanged; the driver gets PROFILE rows a language.

    At most about TRAIN_DOCS documents a language are counted.
    """
    spark = docs.sparkSession
    src = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in src.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    cut = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1 << 30, int(TRAIN_DOCS / n * (1 << 30)))))])
    chosen = src.filter(F.pmod(F.xxhash64(F.lit("profile"), "doc_id"), F.lit(1 << 30)) <= cut[F.col("lang")])
    common.small_batches(spark, 500)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                by.setdefault(lang, []).append(grams(symbols(text)))
            for lang, parts in by.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    total = chosen.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= PROFILE)
    found: dict[str, list[tuple[int, int]]] = {}
    for r in top.select("lang", "gram", "r").collect():
        found.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return [(k, [g for _, g in sorted(v)]) for k, v in sorted(found.items())]


class Judge:
    """All profiles in one sorted table: the code, and its rank in each language."""

    def __init__(self, profiles: list[tuple[str, list[int]]]):
        self.langs = [k for k, _ in profiles]
        self.codes = np.array(sorted({g for _, p in profiles for g in p}) or [0], np.int64)
        self.ranks = np.full((len(self.codes), len(profiles)), -1, np.int64)
        for j, (_, p) in enumerate(profiles):
            self.ranks[np.searchsorted(self.codes, np.array(p, np.int64)), j] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and 1 - distance / the largest distance there can be. No letter, or no profile: und, 0. Ties: the first by name."""
        s = symbols(text or "")
        if len(s) < 2 or not self.langs:
            return UNKNOWN, 0.0
        mine = ranked(grams(s))
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        there = np.where((self.codes[at] == mine)[:, None], self.ranks[at], -1)
        apart = np.where(there < 0, PROFILE, np.abs(there - np.arange(len(mine))[:, None]))
        total = apart.sum(0)
        best = int(np.argmin(total))
        return self.langs[best], float(1 - total[best] / (PROFILE * len(mine)))


_JUDGES: dict[str, Judge] = {}


def language_of(text: Column, profiles: list[tuple[str, list[int]]]) -> Column:
    """A struct of lang_pred and score for each text; whole texts.

    The profiles are PROFILE numbers a language, so they go with the task.
    """
    key = repr(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        if key not in _JUDGES:
            _JUDGES[key] = Judge(profiles)
        return pd.DataFrame([_JUDGES[key].predict(t) for t in texts], columns=["lang_pred", "score"])

    return judged(text.cast("string"))


def predict_languages(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from the documents outside the held-out fold and predicts all: doc_id, held_out, lang_pred, score. A row for each row.

    Null ids count as the fold of the empty text; repeated rows get equal results. Null texts, texts without a letter, and all texts where there is nothing
    to learn, are `und` with score 0. Whole texts of any length. An empty table has no rows; other columns don't matter, also where they are called alike.
    """
    fold = common.fold_of("doc_id", folds)
    profiles = train_profiles(docs.filter(fold != held))
    common.small_batches(docs.sparkSession, 1000)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == held).alias("held_out"), language_of(F.col("text"), profiles).alias("said"))
    return src.select("doc_id", "held_out", "said.lang_pred", "said.score")


def keep_identified(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """docs without those whose text is in none of the learned languages: null, no letter, or no n-gram of any profile."""
    profiles = train_profiles(docs.filter(common.fold_of("doc_id", folds) != held))
    common.small_batches(docs.sparkSession, 1000)
    said = common.new_name(docs, "said")
    return docs.withColumn(said, language_of(F.col("text"), profiles)).filter((F.col(said)["lang_pred"] != UNKNOWN) & (F.col(said)["score"] > 0)).drop(said)
