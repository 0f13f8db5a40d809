import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from catalogia.llm import components, simhash

ODD = [None, "", " \t\n", "one", "a b c", "A B\tC", "a b c d", "a b c d e", "é ü ß x y", "same words here again ok", "same words here again ok"]


def brute_print(text, size):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, radius):
    """prints: {id: int}"""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def corpus():
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for _ in range(12):
        base = rnd.choices(vocab, k=rnd.randrange(20, 400))
        texts += [" ".join(base)] * 2
        for _ in range(8):
            t = list(base)
            for _ in range(rnd.randrange(1, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            texts.append(" ".join(t))
    return texts


def test_fingerprints_against_brute_force():
    rnd = random.Random(4)
    long = " ".join(rnd.choices([f"w{i}" for i in range(5000)], k=20_000))
    for t in [*corpus()[:60], long]:
        assert int.from_bytes(simhash.fingerprint(t, 4), "big") == brute_print(t, 4)
        assert simhash.fingerprint(t, 4, 8)[:8] == simhash.fingerprint(t, 4)


def test_spark_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('éa b c d') h").first().h & (2**64 - 1)
    assert got == int(simhash.shingle_hashes("éa b c d", 4)[0])


def test_cover_holds_a_triple_of_any_four_positions():
    cover = simhash.cover_of_eight()
    assert len(cover) == 20 and all(any(set(c) <= set(four) for c in cover) for four in combinations(range(8), 4))


def test_linked_fingerprints(spark):
    rows = [(i * 3 - 5, t, i, "x") for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep long, list string").repartition(4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.linked_fingerprints(docs).collect()}
    prints = {i: brute_print(t, 4) for i, t, *_ in rows}
    classes = brute_classes(prints, 4)
    assert got == {i: (f"{prints[i]:016x}", classes[i]) for i in prints}
    assert len(set(classes.values())) < len(classes) - 30


@pytest.mark.parametrize("hot", [3, 70, 2048])
def test_lists_cut_into_blocks_lose_no_link(spark, hot):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**63))
    prints = {0: base}
    for i in range(1, 150):  # a chain of near fingerprints and some far ones
        far = int(rng.integers(0, 2**63)) if i % 10 == 0 else None
        prev = prints[i - 1]
        for b in rng.integers(0, 63, 3):
            prev ^= 1 << int(b)
        prints[i] = far if far is not None else prev
    df = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in prints.items()], "rep long, fingerprint binary")
    links = simhash.link(df, 8, 4, simhash.cover_of_eight(), 4, hot=hot)
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert {i: roots.get(i, i) for i in prints} == brute_classes(prints, 4)


def test_hubs_and_limits_of_broadcasts_change_nothing(spark, monkeypatch):
    """With every node of more than two links a hub, and nothing small enough to be broadcast, components and links are the same."""
    rng = np.random.default_rng(9)
    edges = [(0, i) for i in range(1, 40)] + [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(119, 0)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {r.node: r.root for r in components.components(df).collect()}
    texts = [f"common words of all {' '.join(rng.choice(['p', 'q', 'r', 's'], 6))}" for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(components, "HUB", 2)
    monkeypatch.setattr(components.common, "SMALL_ROWS", 0)
    assert {r.node: r.root for r in components.components(df).collect()} == want
    monkeypatch.setattr(simhash, "HOT", 4)
    prints = simhash.common.saved(simhash.fingerprints(docs, 4).groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "prints")
    roots = {r.node: r.root for r in components.components(simhash.link(prints, 8, 4, simhash.cover_of_eight(), 4, hot=4)).collect()}
    reps = {bytes(r.fingerprint): r.rep for r in prints.collect()}
    mine = {r.doc_id: reps[bytes(r.fingerprint)] for r in simhash.fingerprints(docs, 4).collect()}
    assert {i: roots.get(rep, rep) for i, rep in mine.items()} == linked


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(rnd.randrange(1000, 1100), rnd.randrange(1000, 1100)) for _ in range(60)] + [(7, 7), (101, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root if x != 7}


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.linked_fingerprints(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "q r s t u v"), (9, None), (2, "")], schema)
    got = sorted(simhash.linked_fingerprints(docs).collect(), key=str)
    by = [(r.doc_id, r.component_id) for r in got]
    assert sorted(by, key=str) == sorted([(5, 5), (5, 5), (None, 5), (None, None), (9, 2), (2, 2)], key=str)


def jaccard(a, b, k=5):
    s = [{tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_keep_one_of_each(spark):
    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    rows, copies, clean = [], {}, set()
    for i in range(60):
        base = rnd.choices(vocab, k=300)
        rows.append((i * 10, " ".join(base)))
        clean.add(i * 10)
        if i % 3 == 0:
            near = list(base)
            for _ in range(3):
                near[rnd.randrange(300)] = rnd.choice(vocab)
            rows += [(i * 10 + 1, " ".join(near)), (i * 10 + 2, " ".join(base))]
            copies[i * 10 + 1] = copies[i * 10 + 2] = i * 10
        if i % 3 == 1:  # a third of the words shared: not a copy
            rows.append((i * 10 + 3, " ".join(base[:120] + rnd.choices(vocab, k=180))))
            clean.add(i * 10 + 3)
    rows += [(9000, None), (9001, ""), (None, "null id text here ok"), (9002, "w1 w2"), (9002, "w1 w2")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = simhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert clean <= set(kept) and {9000, 9001, None} <= set(kept) and kept.count(9002) == 1
    texts = dict(rows)
    assert all(jaccard(texts[c], texts[o]) >= 0.8 for c, o in copies.items() if c not in kept)
    assert not set(copies) & set(kept)


def with_jaccard(rnd, vocab, n, share):
    """Two texts of n or more words whose shingle similarity is close to share: some words at the end replaced, so that n - 4 - k of n - 4 + k are shared."""
    k = round((n - 4) * (1 - share) / (1 + share))
    base = rnd.choices(vocab, k=n)
    return " ".join(base), " ".join(base[: n - k] + rnd.choices(vocab, k=k))


def test_near_copies_are_those_of_the_exact_similarity(spark):
    """Pairs on both sides of 0.8, of short and long texts; prints alone took many for copies that weren't, and missed others."""
    rnd = random.Random(21)
    vocab = [f"v{i}" for i in range(50_000)]
    rows, want = [], set()
    for i in range(600):
        a, b = with_jaccard(rnd, vocab, rnd.choice((14, 31, 64, 300)), rnd.choice((0.7, 0.74, 0.77, 0.79, 0.8, 0.805, 0.82, 0.85, 0.9)))
        rows += [(2 * i, a), (2 * i + 1, b)]
        if jaccard(a, b) >= 0.8:
            want.add(2 * i + 1)
    chain = rnd.choices(vocab, k=200)  # each a copy of the one before it only
    for k in range(6):
        rows.append((5000 + k, " ".join(chain)))
        chain = chain[15:] + rnd.choices(vocab, k=15)
        want |= {5000 + k} if k else set()
    rows += [(7000, rows[0][1]), (7000, "quite another text under the same id as a copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = [(r.doc_id, r.text) for r in simhash.keep_one_of_each(docs).collect()]
    assert {i for i, _ in rows} - {i for i, _ in kept} == want and sorted(kept)[-1] == rows[-1] and [i for i, _ in kept].count(7000) == 1


@pytest.mark.parametrize(("block_rows", "block_shingles"), [(128, 1 << 20), (7, 1 << 20), (128, 900)])
def test_groups_cut_into_blocks_lose_no_link(spark, block_rows, block_shingles):
    rnd = random.Random(22)
    base = [f"u{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rnd.randrange(1, 4)):
            t[rnd.randrange(120)] = f"x{rnd.random()}"
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {simhash.set_key(simhash.shingle_set(t)): i for i, t in enumerate(texts)}
    groups = spark.createDataFrame([(i, k, 1) for k, i in keys.items()], "doc_id long, rep long, root long")
    links = simhash.verified(docs, groups, block_rows, block_shingles)
    assert all(jaccard(texts[keys[r.a]], texts[keys[r.b]]) >= 0.8 for r in links.collect())
    got = {keys[r.node]: r.root for r in components.components(links).collect()}
    classes = {}
    for i in range(60):
        classes.setdefault(got.get(i, -i), set()).add(i)
    want = {i: i for i in range(60)}
    for a, b in combinations(range(60), 2):
        if jaccard(texts[a], texts[b]) >= 0.8 and want[a] != want[b]:
            old = want[b]
            want = {i: want[a] if r == old else r for i, r in want.items()}
    assert sorted(map(sorted, classes.values())) == sorted(sorted(i for i in want if want[i] == r) for r in set(want.values()))


def test_simhash_index_proposes_near_copies(spark, monkeypatch):
    """Without the sketches' proposals, the byte-position index with its tally finds the copies within 4 bits (and those of equal SimHash); it wasn't asked before."""
    rnd = random.Random(31)
    texts = [rnd.choices([f"q{i}" for i in range(9000)], k=600) for _ in range(20)]
    rows = [(2 * i, " ".join(t)) for i, t in enumerate(texts)] + [(2 * i + 1, " ".join([*t[:-1], "changed"])) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: int.from_bytes(simhash.majority(simhash.shingle_set(t))) for i, t in rows}
    want = {i + 1 for i in range(0, 40, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 4}
    whole, asked = simhash.link, []

    def only_simhash(prints, n_bytes, radius, cover, least, *more):
        asked.append((n_bytes, radius, cover, least))
        return whole(prints, n_bytes, radius, cover, least, *more) if cover else spark.createDataFrame([], "a long, b long")

    monkeypatch.setattr(simhash, "link", only_simhash)
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert len(want) > 10 and set(range(40)) - kept == want
    assert (8, 4, simhash.cover_of_eight(), 4) in asked


def test_pipeline_stages_and_empty_table(spark, tmp_path):
    rnd = random.Random(3)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(90):
        t = rnd.choices(words, k=60)
        if i % 9 == 0:
            t[5] = t[30] = "vileword"
        rows.append((i, " ".join(t), "en" if i % 2 else "de", "s", 1))
    rows += [(200, rows[3][1], "en", "s", 1), (201, None, None, None, None), (202, "123 456", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    for name, data in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        kept = {}
        for stage, f in corpus_pipeline.STAGES:
            docs = f(spark, docs, d)
            kept[stage] = {r.doc_id for r in docs.select("doc_id").collect()}
            if stage != "packing":
                assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "empty":
            assert not any(kept.values())
            continue
        assert kept["language_id"] == set(range(90)) | {200}
        assert kept["toxicity"] == {i for i in kept["language_id"] if i % 9 or i == 200}
        assert kept["near_dedup"] == kept["toxicity"] - {200} == kept["packing"]
        assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == kept["packing"]


def test_clashing_columns_lose_nothing(spark):
    names = ["gone", "_gone", "words", "print", "rep", "list"]
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(k, t, *names) for k, t in ((1, text), (2, text), (3, "quite another text here"))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = simhash.keep_one_of_each(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_tally_comes_before_bits():
    """A pair that the bits alone would link but that shares too few bytes is dropped by the tally; with no minimum the bits decide."""
    base = np.zeros((2, 8), np.uint8)
    base[1, :4] = 1  # four bits apart, four bytes shared
    ids, lists = np.array([1, 2]), np.array([0, 0])
    pairs = lambda least: [(a.tolist(), b.tolist()) for a, b in simhash.close_pairs(base, ids, lists, 4, least)]
    assert pairs(4) == [([1], [2])] and pairs(5) == [] and pairs(0) == [([1], [2])]
