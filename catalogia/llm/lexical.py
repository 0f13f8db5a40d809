"""Ranked lexical search by scanning the documents with an automaton of all query terms.

The terms of the items, each guarded by a blank on both sides, make one Aho-Corasick automaton. A document's bytes are folded (separators to blanks, A-Z
to a-z) and go through it once; what it reports are the terms' occurrences, and each term leads to the items that ask for it. No index of the documents
is made, and nothing of a document is shuffled but its score where it is among a task's best of an item. Two scans: one counts documents, terms and in how
many documents each term stands; the other, which needs these counts, ranks.

Items go to the tasks in blocks of a bounded number of bytes; more blocks are more scans.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


#: Bytes of items whose terms go to every task at once.
BLOCK_BYTES = 16 << 20
#: Bytes of documents that are scanned before their hits are added up.
SCAN_BYTES = 4 << 20
#: Scores (of a document for an item) that are held at once.
HELD_SCORES = 1 << 22
#: Parts in which an item's best of all tasks are first compared.
PARTS = 64
#: Each byte of a document: letters in lower case, digits and all bytes from 128 on as they are, else a blank.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def folded(text: str) -> bytes:
    """The text's terms between blanks; with a blank at both ends."""
    return b" " + text.encode().translate(FOLDED) + b" "


class Queries:
    """The terms of a block of items: their numbers, and for each the items that ask for it and how often."""

    def __init__(self, texts: list[str | None]):
        asked = [folded(t or "").split() for t in texts]
        self.n_items = len(texts)
        self.terms = sorted(set().union(*asked))
        number = {t: k for k, t in enumerate(self.terms)}
        pairs = np.array([(number[t], i) for i, a in enumerate(asked) for t in a], np.int64).reshape(-1, 2)
        pairs, self.times = np.unique(pairs, axis=0, return_counts=True)
        self.items = pairs[:, 1]
        self.begins = np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))


_AUTOMATA: dict[int, object] = {}


def _automaton(key: int, terms: list[bytes]):
    """Built once in each worker."""
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            made.add_word(f" {term.decode('latin-1')} ", k)
        made.make_automaton()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def _counted(automaton, texts: list[bytes], n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of folded texts: the text's place, the term and its occurrences, by text and term."""
    hits = [np.fromiter((k for _, k in automaton.iter(t.decode("latin-1"))), np.int64) for t in texts]
    keys = np.concatenate([h + i * n_terms for i, h in enumerate(hits)]) if hits else np.empty(0, np.int64)
    keys, tf = np.unique(keys, return_counts=True)
    return keys // max(1, n_terms), keys % max(1, n_terms), tf


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and folded texts, some bytes at a time."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
            ids.append(i)
            texts.append(folded(text.as_py()))
            size += len(texts[-1])
            if size >= SCAN_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _statistics(docs: DataFrame, queries, key: int) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and each query term's number of documents: the driver gets a row a query term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        automaton, df, n, size = None, np.zeros(len(q.terms), np.int64), 0, 0
        for _, texts in _scanned(batches):
            sizes = [len(t.split()) for t in texts]
            n, size = n + sum(map(bool, sizes)), size + sum(sizes)
            if q.terms:
                automaton = automaton or _automaton(key, q.terms)
                df += np.bincount(_counted(automaton, texts, len(q.terms))[1], minlength=len(df))
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(there, [-1, -2]), pa.int64()), pa.array(np.append(df[there], [n, size]), pa.int64())], ["term", "n"])

    found = dict(docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    return found.pop(-1, 0), found.pop(-2, 0), found


class _Best:
    """The k best documents of each item so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int, n_items: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.score, self.id, self.null = (np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """scores: documents x items."""
        doc, item = np.nonzero(scores >= self.least)
        if not len(doc):
            return
        names = np.array([i or 0 for i in ids], np.int64)
        null = np.array([i is None for i in ids], bool)
        self.item, self.score = np.append(self.item, item), np.append(self.score, scores[doc, item])
        self.id, self.null = np.append(self.id, names[doc]), np.append(self.null, null[doc])
        order = np.lexsort((self.id, self.null, -self.score, self.item))
        place = np.arange(len(order)) - np.searchsorted(self.item[order], self.item[order])
        order, place = order[place < self.k], place[place < self.k]
        self.item, self.score, self.id, self.null = self.item[order], self.score[order], self.id[order], self.null[order]
        full = place == self.k - 1
        self.least[self.item[full]] = self.score[full]


def _best_of_tasks(docs: DataFrame, queries, key: int, n: int, length: int, df: dict[int, int], k: int) -> DataFrame:
    """item_no, doc_id, score: each task's k best documents of each item."""
    weights = np.zeros(max(df, default=0) + 1, np.int64)
    for term, count in df.items():
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * count + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        automaton, best = _automaton(key, q.terms), _Best(k, q.n_items)
        asked = np.diff(q.begins)
        for ids, texts in _scanned(batches):
            doc, term, tf = _counted(automaton, texts, len(q.terms))
            m = np.array([25 + 75 * len(t.split()) * n // length for t in texts], np.int64)
            part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            rows = max(1, HELD_SCORES // q.n_items)
            for at in range(0, len(texts), rows):
                some = slice(*np.searchsorted(doc, (at, at + rows)))
                scores = np.zeros((min(rows, len(texts) - at), q.n_items), np.int64)
                cuts = np.append(np.arange(some.start, some.stop, 1 << 15), some.stop)
                for a, b in zip(cuts[:-1], cuts[1:]):  # a bounded number of hits at once, each for all items that ask for it
                    times = asked[term[a:b]]
                    place = np.repeat(q.begins[term[a:b]] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
                    np.add.at(scores, (np.repeat(doc[a:b] - at, times), q.items[place]), np.repeat(part[a:b], times) * q.times[place])
                best.add(scores, ids[at : at + rows])
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int64()), pa.array(best.id, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())], ["item_no", "doc_id", "score"])

    return docs.mapInArrow(run, "item_no long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, as op11's contract scores them.

    Each row of items is an item of its own, and each row of docs a document of its own, repeated and null ids included; equal scores go by ascending
    doc_id, null ids last. A null text has no terms; items without terms, and empty tables, have no rows. Whole texts: a task holds one text at a time
    besides SCAN_BYTES of them. Other columns don't matter. Only rows of the tasks' best are exchanged; an item's best meet in PARTS parts first.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for b in range(blocks):
        rows = sorted(asked.filter(block == b).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        q = Queries([r.text for r in rows])
        queries = spark.sparkContext.broadcast(q)
        key = hash((spark.sparkContext.applicationId, queries._jbroadcast.id()))
        n, length, df = _statistics(src, queries, key)
        if not df:
            continue
        best = _best_of_tasks(src, queries, key, n, length, df, k)
        for group in (["item_no", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))], ["item_no"]):
            order = Window.partitionBy(*group).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item_no long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        found.append(best.join(F.broadcast(names), "item_no").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
