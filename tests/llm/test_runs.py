import hashlib
import random
import zlib

import numpy as np

from catalogia.llm import queries as llm_queries, runs


def brute(x):
    """Every run by comparing at each lag."""
    n, best = len(x), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            if i - s + p >= max(12, 2 * p):
                best.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def found(texts):
    texts = sorted(([str(w).encode() for w in t] for t in texts), key=len, reverse=True)
    x, sizes = runs._laid_out(texts)
    known, begins = runs.runs_of(x, sizes), np.cumsum(sizes + 1) - sizes - 1
    cuts = np.searchsorted(known[:, 0], np.append(begins, len(x)))
    return texts, [[(int(s - begins[k]), int(e - s), int(p)) for s, e, p in known[cuts[k] : cuts[k + 1]]] for k in range(len(texts))]


def some_text(rng):
    kind, n = rng.randrange(6), rng.randrange(400)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(50) for _ in range(n)]
    if kind == 2:  # stretches of many periods
        out = []
        while len(out) < n:
            unit = [rng.randrange(rng.choice([1, 2, 3, 100])) for _ in range(rng.randrange(1, 120))]
            out += (unit * rng.randrange(1, 6))[: rng.randrange(1, 600)]
        return out[:800]
    if kind == 3:  # touching runs of one period, out of step
        unit = [rng.randrange(2) for _ in range(rng.randrange(1, 7))]
        shift = rng.randrange(len(unit))
        return [9] * rng.randrange(3) + (unit * 300)[: rng.randrange(20, 300)] + (unit * 300)[shift:][: rng.randrange(20, 300)] + [rng.randrange(3) for _ in range(rng.randrange(20))]
    if kind == 4:  # Fibonacci words: as many runs as can be
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b
    t = [0]  # Thue-Morse, on which hashes modulo 2 ** 64 fail
    while len(t) < n:
        t = t + [1 - v for v in t]
    return t


def test_runs_equal_brute_force():
    rng = random.Random(3)
    total = 0
    for _ in range(25):
        for text, mine in zip(*found([some_text(rng) for _ in range(12)])):
            want = brute(text)
            total += len(want)
            assert mine == want
    assert total > 3000


def test_hashes_that_tell_too_much_are_checked(monkeypatch):
    texts = [[1, 2, 3] * 200 + [4] + [5, 6, 7] * 50, list(range(900)) * 3 + [0, 2, 1] * 40]
    want = [brute(t) for t in sorted(texts, key=len, reverse=True)]
    same = runs.Words.same
    monkeypatch.setattr(runs.Words, "same", lambda self, i, j, size: same(self, i, j, size) | (np.asarray(size) == 1))
    assert all(set(w) <= set(m) for w, m in zip(want, found(texts)[1]))


def test_one_word_and_long_texts():
    _, (one,) = found([[0] * 50_000])
    assert one == [(0, 50_000, 1)]
    unit = list(range(7_000))
    _, (long,) = found([unit * 3 + [3]])
    assert long == [(0, 21_000, 7_000)]
    assert found([[], [], [1]])[1] == [[], [], []] and found([])[1] == []


def test_periodic_runs(spark):
    texts = [None, "", " \t\n", "a b " * 10 + "end", "x y z " * 12, "same same", "same same", "w " * 30_000]
    docs = spark.createDataFrame([(i, t, [1], "c") for i, t in enumerate(texts)], "doc_id long, text string, runs array<int>, collapsed string").repartition(3)
    rows = {r.doc_id: r for r in runs.periodic_runs(docs).collect()}
    assert len(rows) == len(texts)
    assert all(rows[i].n_words == 0 and rows[i].runs == [] and rows[i].collapsed == "" for i in (0, 1, 2))
    assert [tuple(r) for r in rows[3].runs] == [(0, 20, 2)] and rows[3].collapsed == "a b end"
    assert [tuple(r) for r in rows[4].runs] == [(0, 12, 1)] and rows[4].collapsed == "x y z"
    assert rows[5].collapsed == "same same" and rows[7].collapsed == "w"
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    named = spark.createDataFrame([(None, "q " * 12), (3, "q " * 12), (3, "q")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.collapsed) for r in runs.periodic_runs(named).collect()) == [(False, "q"), (False, "q"), (True, "q")]


def test_op13_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(80)}" for _ in range(rng.randrange(0, 300))) for _ in range(150)] + [None, "", "\n", "one"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.asDict() for r in llm_queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for i, t in rows:
        words, h = (t or "").split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j] if j < a else words[a + (j - a) % p] for j in range(n)]
            planted += 1
        all_runs = brute(words)
        gone = {j for s, size, p in all_runs for j in range(s + p, s + size)}
        best = min(all_runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        assert got[i] == {
            "doc_id": i, "n_runs": len(all_runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if all_runs else None,
            "runs_sha256": hashlib.sha256("".join(f"{s},{size},{p}\n" for s, size, p in all_runs).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest(),
        }
    assert planted > 5 and len(got) == len(rows)
    assert dict(llm_queries.op13_periodic_runs(spark, str(tmp_path)).dtypes)["exponent_milli"] == "bigint"
