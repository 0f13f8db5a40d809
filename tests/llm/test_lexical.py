import math
import random
import re
from collections import Counter

import pytest

from catalogia.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    words = [(i, terms(t)) for i, t in docs]
    n, length = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in words:
            tf = Counter(w)
            m = 100 - 75 + 75 * len(w) * n // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def results(df):
    return sorted(map(repr, map(tuple, df.select("item_id", "rank", "doc_id", "score").collect())))


def wanted(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("block_bytes", [lexical.BLOCK_BYTES, 400])
def test_ranked_equals_brute_force(spark, block_bytes, monkeypatch):
    rng = random.Random(7)
    words = [*"abcdefgh", "Éa", "éa", "x1", "12", "a b", "KK", "ß"]
    some = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", "\n", ". ", "_"]) for _ in range(n))
    docs = [(i, some(rng.randrange(0, 60))) for i in range(120)] + [(200, None), (201, ""), (202, " .,-"), (None, "a b c"), (None, "a b c"), (7, "a b c"), (300, "h " * 5000)]
    items = [(i, some(rng.randrange(1, 12))) for i in range(25)] + [(30, None), (31, "..."), (32, "zzz nowhere"), (3, "a a a b"), (3, "a a a b"), (None, "c")]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    monkeypatch.setattr(lexical, "HELD_SCORES", 100)
    assert results(lexical.ranked(d, q, block_bytes=block_bytes)) == wanted(brute(docs, items))


def test_equal_scores_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(40)] + [(90, "other")], "doc_id long, text string").repartition(6)
    items = spark.createDataFrame([("q", "words")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in lexical.ranked(docs, items).orderBy("rank").collect()] == [(k + 1, k) for k in range(10)]
    for d, q in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id = 90"), items)):
        assert lexical.ranked(d, q).collect() == []
    assert dict(lexical.ranked(docs, items).dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}
