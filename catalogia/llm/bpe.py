"""Byte-level BPE by a hierarchical-bitmap rank queue.

Symbols of a pre-token form a doubly linked list over byte positions. For each merge rank a bucket holds the positions of the
pairs that merge to it; a bitmap of two levels marks the ranks whose buckets hold anything, so the lowest rank is two
find-first-set steps away, however long the pre-token is. A merge leaves old entries in their buckets; they are skipped when met.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from catalogia.llm import common
from catalogia.llm.wordpieces import PATTERN, WordEncoder

FAN = 256
#: Ids that are decoded at once.
DECODED_IDS = 1 << 20


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: pairs merge by lowest rank, the leftmost first."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    get = ranks.get
    nxt = list(range(1, n + 2))
    prv = list(range(-1, n))
    pair = [-1] * (n + 1)
    buckets: dict[int, list[int]] = {}
    low: dict[int, int] = {}
    high = 0
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            pair[i] = r
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                w = r // FAN
                low[w] = low.get(w, 0) | 1 << r % FAN
                high |= 1 << w
    while high:
        w = (high & -high).bit_length() - 1
        bits = low[w]
        r = w * FAN + (bits & -bits).bit_length() - 1
        bucket = buckets[r]
        if len(bucket) > 1:
            p = heappop(bucket)
        else:
            p = bucket[0]
            del buckets[r]
            bits &= bits - 1
            low[w] = bits
            if not bits:
                high &= high - 1
        if pair[p] != r:
            continue
        q = nxt[p]
        end = nxt[q]
        nxt[p] = end
        prv[end] = p
        pair[q] = -1
        new = get(piece[p : nxt[end]]) if end < n else None
        a, before = p, prv[p]
        while True:  # the merged symbol's pair, then that of the symbol before it
            if new is None:
                pair[a] = -1
            else:
                pair[a] = new
                if new in buckets:
                    heappush(buckets[new], a)
                else:
                    buckets[new] = [a]
                    x = new // FAN
                    low[x] = low.get(x, 0) | 1 << new % FAN
                    high |= 1 << x
            if before < 0:
                break
            a, before = before, -1
            new = get(piece[a:end])
    out = []
    i = 0
    while i < n:
        out.append(ranks[piece[i : nxt[i]]])
        i = nxt[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


_CODECS: dict[tuple[str, str], "Codec"] = {}


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.ends = np.cumsum([0, *map(len, self.bytes_of)])
        self.encoder = WordEncoder(self._words, self._whole, cuts=pattern == PATTERN)

    def _words(self, words: list[bytes]) -> list[bytes]:
        return [array("I", merge(w, self.ranks)).tobytes() for w in words]

    def _whole(self, texts: list[str]) -> list[bytes]:
        cut = [[w.encode("utf-8", "replace") for w in self.pattern.findall(t)] for t in texts]
        words = list(set().union(*cut))
        ids = dict(zip(words, self.encoder.remembered(words)))
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    def encode(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        yield from self.encoder.encode(texts)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, gathered from one flat table: for each id its place there, then all places in between."""
        out = []
        for at in range(0, len(ids), 4 * DECODED_IDS):
            x = np.frombuffer(ids[at : at + 4 * DECODED_IDS], np.uint32)
            start, size = self.ends[x], self.ends[x + 1] - self.ends[x]
            before = np.cumsum(size) - size
            out.append(self.flat[np.repeat(start - before, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(out)


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes each text (null: empty), decodes the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    A row for each row of docs, repeated ids included; an empty text has no ids. No exchange.
    """
    common.small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            names, counts, sums, backs, kept = b.column("doc_id"), [], [], [], []
            for ids in c.encode(b.column("text")):
                counts.append(len(ids) // 4)
                sums.append(hashlib.sha256(ids).hexdigest())
                backs.append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            cols = [names, pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * keep_ids, schema=_schema(keep_ids))

    return src.mapInArrow(run, schema)


def _schema(keep_ids: bool) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.binary())] * keep_ids)
