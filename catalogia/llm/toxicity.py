"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents (P) are labels. The unlabelled ones (U) are a sample of all documents of the training fold, whether or not the label table
covers them and whatever it says of them. With the class prior p and the logistic loss l, the risk
p E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - p E_P[l(f, -1)])  is minimised over a linear function f of hashed n-grams: the second term is the
risk on negatives, which an estimate must not bring below zero; where it does, a step goes the other way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from catalogia.llm import common

#: Confirmed documents, and unlabelled ones, that the classifier is fitted on, at most about so many each (chosen by a hash of id and text).
TRAIN_DOCS = 8_000
#: Features: buckets of n-grams, of these lengths in bytes, of words with a space at both ends.
BUCKETS, SIZES = 1 << 20, (4, 5, 6, 7)
#: Buckets that the model knows at most, and in how many of the documents they must be. Those whose shares of confirmed and of unlabelled documents
#: differ by less than LEAST_Z standard deviations aren't used: they are noise.
FEATURES, LEAST_DOCS, LEAST_Z = 3_000, 5, 5.0
THRESHOLD = 0.7
#: Bytes of text whose n-grams are looked at at once.
SLICE = 1 << 19
#: Every ASCII byte that is no letter or digit becomes a space.
_WORD_BYTES = np.array([c if c > 127 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_MULTIPLIER, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (text's number, bucket), repeats included, of whole texts in lower case (null: empty), slice by slice. No n-gram goes over a word's end."""
    gap, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    padded = pc.binary_join_element_wise(gap, pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), none)), gap, none)
    if not len(padded):
        return
    ends = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = _WORD_BYTES[np.frombuffer(padded.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + max(SIZES) - 1]
        most = min(SLICE, len(part))
        gaps = np.concatenate(([0], np.cumsum(part == 32)))
        code = np.zeros(len(part), np.uint64)
        for n in range(1, max(SIZES) + 1):
            count = len(part) - n + 1
            if count <= 0:
                break
            code = code[:count] * _MULTIPLIER + part[n - 1 :] + np.uint64(1)
            if n in SIZES:
                inner = gaps[n - 1 : n - 1 + count] - gaps[1 : 1 + count] == 0
                start = np.flatnonzero(inner[:most])
                bucket = ((code[start] ^ (code[start] >> np.uint64(29))) * _MIX >> np.uint64(44)).astype(np.int64)
                yield np.searchsorted(ends, start + at, "right") - 1, bucket


def found_features(texts: pa.Array, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (text's number, feature), in order; lookup: the feature of each bucket, or -1."""
    width = int(lookup.max()) + 1 if len(lookup) else 0
    got = []
    for text, bucket in gram_buckets(texts):
        feature = lookup[bucket]
        hit = feature >= 0
        if hit.any():
            got.append(np.unique(text[hit] * width + feature[hit]))
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.divmod(np.unique(np.concatenate(got)), width)


def risks(f: np.ndarray, confirmed: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """p E_P[l(f, +1)], E_U[l(f, -1)] - p E_P[l(f, -1)], and the derivatives of both by f. confirmed: which rows are P; the others are U."""
    p, u = confirmed, ~confirmed
    n_p, n_u = max(1, int(p.sum())), max(1, int(u.sum()))
    up = 1 / (1 + np.exp(-np.clip(f, -500, 500)))  # derivative of l(f, -1); that of l(f, +1) is up - 1
    minus, plus = np.logaddexp(0, f), np.logaddexp(0, -f)
    positive = prior * plus[p].sum() / n_p
    negative = minus[u].sum() / n_u - prior * minus[p].sum() / n_p
    return float(positive), float(negative), prior * np.where(p, up - 1, 0) / n_p, np.where(u, up / n_u, -prior * up / n_p)


def fit_nnpu(rows: list[np.ndarray], confirmed: np.ndarray, prior: float, n_features: int, steps: int = 300, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float, int]:
    """Weights, bias, and how many steps went up the negatives' risk because it was below zero. rows: the features of each document.

    Full-batch Adam; decay weighs half the sum of the squared weights.
    """
    confirmed = confirmed.astype(bool)
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    upward = 0
    for t in range(1, steps + 1):
        f = np.bincount(owner, w[flat], len(rows)) + b
        _, negative, d_positive, d_negative = risks(f, confirmed, prior)
        upward += negative < 0
        g = d_positive + d_negative if negative >= 0 else -d_negative
        grad = np.append(np.bincount(flat, g[owner], n_features) + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= float(step[-1])
    return w, b, upward


def decision_bias(f: np.ndarray, prior: float, threshold: float, covered: int) -> float:
    """What to add to f so that about the prior's share of the unlabelled documents scores at the threshold or above.

    The prior is known from `covered` documents, f of another sample: the share may be off by two standard errors of their difference, and a tenth less or a
    twentieth more. The cut lies in the middle of the widest gap between neighbouring values of f in that range (the highest, if several), so documents with
    equal values are on one side.
    """
    down = np.sort(f)[::-1]
    spread = 2 * np.sqrt(prior * (1 - prior) * (1 / max(1, covered) + 1 / max(1, len(f))))
    low = min(len(f) - 1, max(1, int((0.9 * prior - spread) * len(f))))
    high = min(len(f) - 1, max(low, int(np.ceil((1.05 * prior + spread) * len(f)))))
    if len(f) < 2:
        return 0.0
    gaps = down[low - 1 : high] - down[low : high + 1]
    k = low + int(np.argmax(gaps))
    cut = (down[k - 1] + down[k]) / 2 if gaps.max() > 0 else down[0] + 1
    return float(np.log(threshold / (1 - threshold)) - cut)


def _distinct_sample(rows: DataFrame, bound: int, count: int) -> DataFrame:
    """text of about bound of the different (doc_id, text), chosen by a hash of both: however often one row is repeated, it is one."""
    cut = min(1 << 30, int(bound / max(1, count) * (1 << 30)))
    key = F.xxhash64(F.lit("toxicity"), "doc_id", "text")
    return rows.filter(F.pmod(key, F.lit(1 << 30)) < F.lit(cut)).select("text", F.col("doc_id").alias("_d"), key.alias("_h")).dropDuplicates(["_d", "_h"]).select("text")


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, threshold: float = THRESHOLD) -> dict:
    """The model of the given training documents: buckets, weights, bias. A model without buckets scores all texts alike.

    Labels are one a document (the largest toxic value of repeated rows; null ids and null values say nothing). The prior, if not given, is the share of
    toxic documents among those that the labels cover; their other rows teach nothing by being labelled. Without a toxic or without another document
    there is nothing to learn. The driver gets the features of at most about 2 * TRAIN_DOCS documents, never a text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    known = common.saved(ids.join(marks, "doc_id", "left"), "toxic-labels")
    n_docs, n, n_toxic = known.agg(F.sum("rows"), F.count("toxic"), F.sum("toxic")).first()
    n_toxic = n_toxic or 0
    if prior is None:
        prior = n_toxic / n if n else 0.0
    constant = {"buckets": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))), "prior": prior}
    if not n_toxic or not 0 < prior < 1:
        return constant
    # The chosen ids are bounded by TRAIN_DOCS, so they may be sent to all tasks.
    toxic = common.sampled(known.filter("toxic = 1").select("doc_id"), "doc_id", TRAIN_DOCS, n_toxic)
    confirmed = docs.join(F.broadcast(toxic), "doc_id").dropDuplicates(["doc_id"]).select("text")
    both = confirmed.withColumn("confirmed", F.lit(1)).union(_distinct_sample(docs, TRAIN_DOCS, n_docs).withColumn("confirmed", F.lit(0)))
    src = common.saved(both, "toxic-sample")
    sizes = {r["confirmed"]: r["count"] for r in src.groupBy("confirmed").count().collect()}
    if len(sizes) < 2:
        return constant
    common.small_batches(spark, 500)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int32)
        for b in batches:
            if not b.num_rows:
                continue
            side = b.column("confirmed").to_numpy()
            pairs = [np.unique(text * BUCKETS + bucket) for text, bucket in gram_buckets(b.column("text"))]
            text, bucket = np.divmod(np.unique(np.concatenate(pairs)), BUCKETS)
            for k in (0, 1):
                total[k] += np.bincount(bucket[side[text] == k], minlength=BUCKETS).astype(np.int32)
        there = np.flatnonzero(total.sum(0))
        for at in range(0, len(there), 100_000):
            x = there[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(total[0, x].astype(np.int64)), pa.array(total[1, x].astype(np.int64))], ["bucket", "u", "p"])

    count = src.mapInArrow(counted, "bucket long, u long, p long").groupBy("bucket").agg(F.sum("u").cast("double").alias("u"), F.sum("p").cast("double").alias("p"))
    share = (F.col("u") + F.col("p")) / (sizes[0] + sizes[1])
    z = (F.col("p") / sizes[1] - F.col("u") / sizes[0]) / F.sqrt(share * (1 - share) * (1 / sizes[0] + 1 / sizes[1]) + 1e-12)
    top = count.filter(F.col("u") + F.col("p") >= LEAST_DOCS).withColumn("z", z).filter(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "bucket").limit(FEATURES)
    buckets = np.array(sorted(r["bucket"] for r in top.select("bucket").collect()), np.int64)
    if not len(buckets):
        return constant

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(buckets)
        for b in batches:
            text, feature = found_features(b.column("text"), lookup)
            ends = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))), b.column("confirmed").cast(pa.int32())], ["known", "confirmed"])

    rows = src.mapInArrow(numbers, "known array<int>, confirmed int").toArrow()
    got = sorted(zip(rows.column("confirmed").to_pylist(), map(tuple, rows.column("known").to_pylist())))
    w, _, _ = fit_nnpu([np.array(k, np.int64) for _, k in got], np.array([c for c, _ in got]), prior, len(buckets))
    bias = decision_bias(np.array([w[list(k)].sum() for c, k in got if not c]), prior, threshold, n)
    return {"buckets": buckets, "weights": w, "bias": bias, "prior": prior}


def _lookup(buckets: np.ndarray) -> np.ndarray:
    out = np.full(BUCKETS, -1, np.int64)
    out[buckets] = np.arange(len(buckets))
    return out


def toxicity_of(text: Column, model: dict) -> Column:
    """The score (0 to 1) of each whole text; null and empty texts get the score of no n-gram. The model is at most FEATURES numbers."""
    buckets, weights, bias = model["buckets"], model["weights"], float(model["bias"])

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = _lookup(buckets)
        for texts in parts:
            f = np.full(len(texts), bias)
            if len(buckets):
                text, feature = found_features(pa.array(texts, pa.string(), from_pandas=True), lookup)
                f += np.bincount(text, weights[feature], len(texts))
            yield pd.Series(1 / (1 + np.exp(-np.clip(f, -30, 30))))

    return scored(text.cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = THRESHOLD, prior: float | None = None) -> DataFrame:
    """Learns from the documents and labels outside the held-out fold and scores all documents: doc_id, held_out, score, predicted. A row for each row.

    Null ids count as the fold of the empty text and are never labelled; repeated rows get equal scores; other columns of docs don't matter, also
    where they are called like those of the result.
    """
    fold = common.fold_of("doc_id", folds)
    model = train(docs.filter(fold != held), labels.filter(fold != held), prior, threshold)
    common.small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == held).alias("held_out"), toxicity_of(F.col("text"), model).alias("score"))
    return src.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_harmless(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = THRESHOLD, prior: float | None = None) -> DataFrame:
    """docs without those that the model, learned outside the held-out fold, scores at the threshold or above. All columns are kept as they are."""
    fold = common.fold_of("doc_id", folds)
    model = train(docs.filter(fold != held), labels.filter(fold != held), prior, threshold)
    common.small_batches(docs.sparkSession)
    mine = common.new_name(docs, "toxicity")
    return docs.withColumn(mine, toxicity_of(F.col("text"), model)).filter(F.col(mine) < threshold).drop(mine)
