"""Periodic runs of words: maximal stretches that repeat with some smallest period.

Texts of a task are laid side by side as numbers, a number of its own between two texts, so that nothing matches across them. Periods below DIRECT are
found by comparing the words with themselves at each lag. Longer ones are found scale by scale: at scale w (16, 32, ...) every window of w starts picks its
smallest w-gram by hash; two windows a period apart inside a run hold the same words and so pick starts a period apart. Equal picks at 2w to 4w words give
the lag, and hashes of prefixes give how far the words agree at that lag on both sides.

Grams that repeat within half their length lie in runs that smaller scales have found, and would be picked everywhere; they are left out. A longer run
whose first periods hold only such grams is two touching runs of one short period, so the lags of such neighbours are tried, too. Every agreement is checked
word by word. Work is n log n words, plus the words of the runs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Periods below this are found by comparing at each lag.
DIRECT = 32
#: The shortest run.
LEAST = 12
#: Words of texts that are laid side by side (or one text, if it is longer).
WORDS = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_NONE = np.empty((0, 3), np.int64)


class Words:
    """Numbers of words, with hashes of their prefixes."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        v = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(31)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(29)
        self.powers = _powers(_BASE, n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v * self.powers[:n], dtype=np.uint64)))

    def grams(self, w: int, n: int) -> np.ndarray:
        """Hashes of the w words from each of the first starts, as far as they lie in the first n words."""
        return (self.sums[w : n + 1] - self.sums[: n + 1 - w]) * _powers(pow(_BASE, -1, 1 << 64), n + 1 - w)

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Whether `size` words from i and from the later j are the same, by their hashes."""
        return (self.sums[i + size] - self.sums[i]) * self.powers[j - i] == self.sums[j + size] - self.sums[j]

    def agree(self, i: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each i whose word is that at i + lag: the first start and the end (not included) of the words around i that equal those a lag later."""
        n = len(self.x)
        left, right = np.zeros_like(i), np.zeros_like(i)
        step = 1 << max(0, n.bit_length() - 1)
        while step:
            room = i + lag + right + step <= n
            at = np.where(room, i + right, 0)
            right += np.where(room & self.same(at, at + lag, np.where(room, step, 0)), step, 0)
            room = i - left - step >= 0
            at = np.where(room, i - left - step, 0)
            left += np.where(room & self.same(at, at + lag, np.where(room, step, 0)), step, 0)
            step >>= 1
        return i - left, i + right


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _direct(x: np.ndarray, lag: int) -> np.ndarray:
    at = np.flatnonzero(x[lag:] == x[:-lag])
    if not len(at):
        return _NONE
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1
    keep = last - first >= max(LEAST - lag, lag)
    return np.stack((first[keep], last[keep] + lag, np.full(int(keep.sum()), lag)), 1)


def _picked(words: Words, w: int, n: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts that some window of w starts picks, in order, and the hashes of their grams."""
    grams = words.grams(w, n)
    m = len(grams)
    bits = np.uint64(m.bit_length())
    key = (grams >> bits << bits) | np.arange(m, dtype=np.uint64)
    top = np.uint64(2**64 - 1)
    inner = known[(known[:, 2] <= w // 2) & (known[:, 1] - known[:, 0] >= w) & (known[:, 1] - w < m)]
    if len(inner):
        change = np.zeros(m + 1, np.int32)
        np.add.at(change, inner[:, 0], 1)
        np.add.at(change, inner[:, 1] - w + 1, -1)
        key[np.cumsum(change[:-1]) > 0] = top
    padded = np.full(-(-m // w) * w, top)
    padded[:m] = key
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: m - w + 1], before[w - 1 : m])
    at = (least[least != top] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    at = at[np.diff(at, prepend=-1) != 0]
    return at, grams[at]


def _pairs(at: np.ndarray, grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lags of equal picks that lie 2w to 4w words apart. Equal picks are over w / 2 apart, so seven neighbours are enough."""
    order = np.argsort(grams, kind="stable")
    at, grams = at[order], grams[order]
    first, lags = [], []
    for d in range(1, 8):
        lag = at[d:] - at[:-d]
        hit = (grams[d:] == grams[:-d]) & (lag >= 2 * w) & (lag < 4 * w)
        first.append(at[:-d][hit])
        lags.append(lag[hit])
    return np.concatenate(first), np.concatenate(lags)


def _touching(words: Words, w: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lags of 2w to 4w words for neighbouring runs of one short period that touch and repeat the same words."""
    k = known[(known[:, 2] <= w // 2) & (known[:, 1] - known[:, 0] >= 2 * w)]
    k = k[np.lexsort((k[:, 0], k[:, 2]))]
    first, lags = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in zip(*(k[:-1], k[1:])):
        q = int(a[2])
        if b[2] != q or b[0] > a[1]:
            continue
        turns = np.arange(a[0], a[0] + q)
        turn = turns[words.same(turns, np.full(q, b[0]), q)]
        if len(turn):
            shift = int(b[0] - turn[0]) % q
            p = np.arange(2 * w + (shift - 2 * w) % q, min(4 * w, (b[1] - a[0]) // 2 + 1), q)
            first.append(np.maximum(a[0], b[0] - p))
            lags.append(p)
    return np.concatenate(first), np.concatenate(lags)


def _checked(x: np.ndarray, start: int, end: int, lag: int, seed: int) -> tuple[int, int]:
    """The stretch around seed as it really is: hashes may have told too much."""
    if np.array_equal(x[start : end - lag], x[start + lag : end]):
        return start, end
    unlike = np.flatnonzero(x[start : end - lag] != x[start + lag : end]) + start
    at = int(np.searchsorted(unlike, seed))
    return (int(unlike[at - 1]) + 1 if at else start), (int(unlike[at]) + lag if at < len(unlike) else end)


def runs_of(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Every run of texts laid side by side, as rows of start, end and period by start and period.

    sizes: the texts' numbers of words, the longest first; in x, each text is followed by a number that stands nowhere else.
    """
    known = np.concatenate([_NONE, *(_direct(x, lag) for lag in range(1, min(DIRECT, len(x))))])
    known = _least_periods(known)
    ends = np.cumsum(sizes + 1)
    w, words = DIRECT // 2, None
    while (n := int(ends[int((sizes >= 4 * w).sum()) - 1]) if len(sizes) and sizes[0] >= 4 * w else 0):
        words = words or Words(x[:n])
        picked, touching = _pairs(*_picked(words, w, n, known), w), _touching(words, w, known[known[:, 1] <= n])
        seed, lag = np.concatenate((picked[0], touching[0])), np.concatenate((picked[1], touching[1]))
        if len(seed):
            hit = x[seed] == x[seed + lag]
            seed, lag = seed[hit], lag[hit]
            first, last = words.agree(seed, lag)
            keep = last - first >= lag
            rows, at = np.unique(np.stack((first[keep], last[keep] + lag[keep], lag[keep]), 1), axis=0, return_index=True)
            seed = seed[keep][at]
            real = [(*_checked(x, int(s), int(e), int(p), int(i)), int(p)) for (s, e, p), i in zip(rows, seed)]
            rows = np.array([r for r in real if r[1] - r[0] >= 2 * r[2]], np.int64).reshape(-1, 3)
            known = _least_periods(np.concatenate((known, rows)))
        w *= 2
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def _least_periods(rows: np.ndarray) -> np.ndarray:
    """A stretch that has several periods counts with the smallest."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    return rows[np.concatenate((np.ones(min(1, len(rows)), bool), (np.diff(rows[:, :2], axis=0) != 0).any(1)))] if len(rows) else rows


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def _laid_out(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as numbers, one text after the other, and the texts' sizes."""
    flat = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    sizes = np.array([len(t) for t in texts], np.int64)
    x = np.empty(len(flat) + len(texts), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    own = np.zeros(len(x), bool)
    own[ends] = True
    x[~own] = flat.indices.to_numpy(zero_copy_only=False)
    x[ends] = len(flat.dictionary) + np.arange(len(texts))
    return x, sizes


def _found(ids: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    ids, texts = [ids[k] for k in order], [texts[k] for k in order]
    x, sizes = _laid_out(texts)
    known = runs_of(x, sizes)
    begins = np.cumsum(sizes + 1) - sizes - 1
    cuts = np.searchsorted(known[:, 0], np.append(begins, len(x)))
    all_runs, collapsed = [], []
    for k, words in enumerate(texts):
        mine = known[cuts[k] : cuts[k + 1]]
        mine = np.column_stack((mine[:, 0] - begins[k], mine[:, 1] - mine[:, 0], mine[:, 2]))
        if len(mine):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, mine[:, 0] + mine[:, 2], 1)
            np.add.at(change, mine[:, 0] + mine[:, 1], -1)
            words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
        all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine.tolist()])
        collapsed.append(b" ".join(words).decode())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(all_runs, _OUT.field("runs").type), pa.array(collapsed, pa.string())], schema=_OUT)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length and smallest period in words, by start and period) and collapsed (the text's words without later periods).

    Words are parted by blanks and the controls 9 to 13. A run is a stretch of at least LEAST words and two periods that can't be extended. A word goes if
    any run holds it after that run's first period. A row for each row of docs, repeated ids and null ids included; a null text has no words and so no runs
    and an empty collapsed text. Other columns don't matter. Whole texts: the longest text of a task takes about 100 bytes a word there. No exchange.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, size = [], [], 0
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids.append(i)
                texts.append(text.as_py().encode().split())
                size += len(texts[-1])
                if size >= WORDS:
                    yield _found(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield _found(ids, texts)

    return src.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
