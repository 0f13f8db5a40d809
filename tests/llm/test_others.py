import base64
import hashlib
import json
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalogia.llm import ann, chat, langid, queries as llm_queries, telephony, toxicity, warc

# ---- telephony


def test_g711_tables():
    assert telephony.MU[[0, 0x7F, 0x80, 0xFF]].tolist() == [-32124, 0, 32124, 0]
    assert telephony.A[[0xD5, 0x55, 0xAA, 0x2A]].tolist() == [8, -8, 32256, -32256]
    assert len(set(telephony.MU.tolist())) == 255 and len(set(telephony.A.tolist())) == 256


def test_adpcm_across_blocks_equals_one_at_a_time():
    rng = np.random.default_rng(1)
    data = b"".join(int(rng.integers(-30000, 30000)).to_bytes(2, "little", signed=True) + bytes([int(rng.integers(0, 89)), 0]) + rng.integers(0, 256, 28, np.uint8).tobytes() for _ in range(5))
    want = []
    for k in range(0, len(data), 32):
        block = data[k : k + 32]
        value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
        want.append(value)
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(telephony.STEPS[index])
                change = step >> 3
                change += (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                want.append(value)
    assert telephony.decode_adpcm(data, 32).tolist() == want


def test_pcm_of_eight_bits():
    x = np.array([0, 127, 128, -128, -129, 32767, -32768, 5000], np.int16)
    _, rate, block, raw = telephony.read_wav(telephony.pcm_file(x, 4000, 8))
    assert (rate, block) == (4000, 1) and (np.frombuffer(raw, np.uint8).astype(int) - 128).tolist() == [0, 0, 1, 0, -1, 127, -128, 20]
    assert telephony.read_wav(telephony.pcm_file(x, 4000, 16))[2:] == (2, x.tobytes())


def test_resample():
    assert telephony.resample(np.array([0, 10, 20], np.int16), 8000, 16000).tolist() == [0, 5, 10, 15, 20, 20]
    assert telephony.resample(np.full(50, 1234, np.int16), 16000, 8000).tolist() == [1234] * 25
    assert telephony.low_pass(8000, 4000).sum() == 1 << 15
    level = lambda x: float(np.sqrt((x[100:-100].astype(float) ** 2).mean()))
    for hertz, least, most in ((300, 6900, 7200), (1500, 6800, 7200), (2600, 0, 80), (3700, 0, 80)):  # above 2 kHz nothing may come back as a lower tone
        tone = np.round(10_000 * np.sin(2 * np.pi * hertz * np.arange(4000) / 8000)).astype(np.int16)
        assert least <= level(telephony.resample(tone, 8000, 4000)) <= most
    loud = np.tile(np.array([32767, 32767, -32768, -32768], np.int16), 200)
    assert len(telephony.resample(loud, 8000, 4000)) == 400
    assert telephony.resample(np.array([5], np.int16), 8000, 4000).tolist() == [] and telephony.resample(np.array([5, 5], np.int16), 8000, 4000).tolist() == [5]
    assert telephony.resample(np.empty(0, np.int16), 8000, 16000).tolist() == []


@pytest.mark.parametrize("tag", [telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM])
def test_media(spark, tag):
    texts = [None, "", "é" * 96, "x", "same", "same", "long " * 30_000]
    docs = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)], "doc_id long, text string, media binary").repartition(2)
    media = telephony.store_media(docs, tag)
    rows = {r.doc_id: r for r in telephony.features(media).collect()}
    files = {r.doc_id: bytes(r.media) for r in media.collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        n = max(1, -(-len(raw) // 192)) * 192
        payload = raw.ljust(n, b" ")
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(files[i]), hashlib.sha256(files[i]).hexdigest())
    assert rows[4].feature == rows[5].feature != rows[3].feature and rows[0].feature == rows[1].feature
    if tag == telephony.MU_LAW:
        got = {r.doc_id: telephony.read_wav(bytes(r.pcm)) for r in telephony.pcm(media).collect()}
        payload = "x".encode().ljust(192, b" ")
        slow = [int(telephony.MU[b]) for b in payload]
        twice = [v for a, b in zip(slow, [*slow[1:], slow[-1]]) for v in (a, (a + b + 1) // 2)]
        assert got[3][:3] == (1, 16000, 2) and np.frombuffer(got[3][3], "<i2").tolist() == twice
        assert telephony.stored_and_read(docs).count() == len(texts) and telephony.stored_and_read(docs.limit(0)).count() == 0


def test_every_codec_is_stored_as_pcm(spark):
    texts = [f"text number {i} " * (i % 7) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i + 80, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tags = {telephony.codec_of(telephony.payload_of(t)[1]) for t in texts}
    rows = {r.doc_id: r for r in telephony.stored_and_read(docs).collect()}
    assert tags == {telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM} and len(rows) == 160
    for i, t in enumerate(texts):
        payload = telephony.payload_of(t)[1]
        tag = telephony.codec_of(payload)
        media = telephony.wav(payload, tag, 8000, *((4, 192) if tag == telephony.IMA_ADPCM else (8, 1)))
        samples = telephony.read_wav(telephony.pcm_file(telephony.to_pcm(media, telephony.STORED_RATE), telephony.STORED_RATE, 8))[3]
        a, b = rows[i], rows[i + 80]
        assert a.feature == b.feature and a.feature.endswith(hashlib.sha256(samples).hexdigest()[:16])
        assert (a.payload_sha256, a.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())


def test_the_query_resamples_to_the_full_rate(spark, tmp_path):
    """The features of op3_telephony are of 16-bit samples at 16 kHz; they were of 8-bit samples at 4 kHz, a quarter of them."""
    texts = [f"text number {i} " * (i % 7) for i in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in llm_queries.op3_telephony(spark, str(tmp_path)).collect()}
    assert len(rows) == 40
    for i, t in enumerate(texts):
        payload = telephony.payload_of(t)[1]
        tag = telephony.codec_of(payload)
        media = telephony.wav(payload, tag, 8000, *((4, 192) if tag == telephony.IMA_ADPCM else (8, 1)))
        samples = telephony.to_pcm(media, 16_000).astype("<i2")
        assert tag == telephony.IMA_ADPCM or len(samples) == 2 * len(payload)
        assert rows[i].feature.endswith(hashlib.sha256(samples.tobytes()).hexdigest()[:16]) and rows[i].feature.startswith(f"s={len(samples) / 16000:.3f} ")
        assert (rows[i].payload_sha256, rows[i].media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())


# ---- language ID


def brute_language(text, profiles):
    s = ""
    for c in text:
        s += c.lower() if c.isalpha() else ("" if s[-1:] == "\0" else "\0")
    s = "\0" + s.strip("\0") + "\0"
    if len(s) < 3:
        return "und", 0.0
    count = Counter(c for c in s if c != "\0") + Counter(s[i : i + 2] for i in range(len(s) - 1)) + Counter(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != "\0")
    code = lambda g: sum(ord(c) << 16 * k for k, c in enumerate(reversed(g))) | {1: 0, 2: 1 << 48, 3: 1 << 49}[len(g)]
    mine = [code(g) for g in sorted(count, key=lambda g: (-count[g], code(g)))[:300]]
    best = min(((sum(abs(p.index(g) - i) if g in p else 300 for i, g in enumerate(mine)), name) for name, p in profiles))
    return best[1], 1 - best[0] / (300 * len(mine))


def test_language_id(spark):
    rnd = random.Random(1)
    syl = {"aa": ["ba", "lo", "mi"], "bb": ["xé", "tru", "ñok", "qu"], "cc": ["der", "sch", "ung"]}
    make = lambda k: " ".join("".join(rnd.choices(syl[k], k=rnd.randrange(1, 4))) for _ in range(40))
    rows = [(i, make(k), k, "s") for i, k in enumerate(rnd.choices(sorted(syl), k=240))]
    rows += [(900, None, "aa", "s"), (901, "", "bb", "s"), (902, "123 !?", "aa", "s"), (903, make("aa") * 300, None, "s"), (904, "😀𝔘 ba", None, "s"), (905, "😀😀 🎉 𝟙𝟚", None, "s"), (None, make("bb"), "bb", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(3)
    got = {r.doc_id: r for r in langid.predict_languages(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == k for i, _, k, _ in rows[:240]) and got[903].lang_pred == "aa"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 905))
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got.values())
    profiles = langid.train_profiles(docs)
    judge = langid.Judge(profiles)
    for _, t, *_ in rows[:25]:
        assert judge.predict(t)[0] == brute_language(t, profiles)[0] and math.isclose(judge.predict(t)[1], brute_language(t, profiles)[1])
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {900, 901, 902, 905}
    assert langid.predict_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ---- toxicity


def test_toxicity(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    bad = ["vile", "nasty", "gross"]
    rows, marks = [], []
    for i in range(900):
        t = rnd.choices(vocab, k=rnd.randrange(5, 80))
        toxic = rnd.random() < 0.15
        if toxic:
            t.insert(rnd.randrange(len(t)), rnd.choice(bad).upper() + "!")
        rows.append((i, " ".join(t), 0.5))
        if i % 2:
            marks += [(i, 1, int(toxic))] * (1 + i % 3 // 2)
    truth = {i: any(b in t.lower() for b in bad) for i, t, _ in rows}
    rows += [(2000, None, 0.5), (2001, "", 0.5), (2002, "w1 " * 40_000 + "vile", 0.5), (None, "w5", 0.5)]
    marks += [(None, 1, 1), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    right = [got[i].predicted == t for i, t in truth.items() if got[i].held_out]
    assert sum(right) / len(right) > 0.97 and got[2002].predicted == 1 and got[2000].score == got[2001].score < 0.5
    kept = toxicity.keep_harmless(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0}


def brute_risks(f, confirmed, prior):
    """The two terms of the risk, one document at a time."""
    loss = lambda x, y: math.log1p(math.exp(-x * y))
    p, u = [x for x, c in zip(f, confirmed) if c], [x for x, c in zip(f, confirmed) if not c]
    on_p = lambda y: prior * sum(loss(x, y) for x in p) / len(p)
    return on_p(1), sum(loss(x, -1) for x in u) / len(u) - on_p(-1)


def test_risk_against_brute_force_and_finite_differences():
    rng = np.random.default_rng(4)
    for prior in (0.05, 0.3, 0.7):
        f, confirmed = rng.normal(size=30) * 2, np.arange(30) % 3 == 0
        positive, negative, d_positive, d_negative = toxicity.risks(f, confirmed, prior)
        assert np.allclose((positive, negative), brute_risks(f, confirmed, prior))
        for i in range(30):
            up, down = f.copy(), f.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            slope = (np.array(brute_risks(up, confirmed, prior)) - brute_risks(down, confirmed, prior)) / 2e-5
            assert np.allclose(slope, (d_positive[i], d_negative[i]), atol=1e-8)


def test_negative_risk_is_corrected():
    """The unlabelled rows hold fewer positives than the prior says: the estimate of the risk on negatives goes below zero, and steps go the other way."""
    confirmed = np.array([1] * 10 + [0] * 40)
    rows = [np.array([0])] * 10 + [np.array([0])] * 2 + [np.array([1])] * 38
    w, b, upward = toxicity.fit_nnpu(rows, confirmed, 0.4, 2)
    f = np.array([w[r].sum() + b for r in rows])
    free = 0.4 * np.logaddexp(0, f[:10]).mean()  # what an unclamped fit would drive far above the loss on the unlabelled rows
    assert upward > 0 and w[0] > w[1] and np.logaddexp(0, f[10:]).mean() > free - 0.1
    _, _, never = toxicity.fit_nnpu([np.array([0])] * 10 + [np.array([0])] * 20 + [np.array([1])] * 20, confirmed, 0.3, 2, steps=40)
    assert never == 0


def test_unlabelled_text_takes_part(spark):
    """Labels cover toxic documents only with one insult; the prior and the unlabelled rows decide the rest, and labelled others aren't negatives."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rnd.choices(vocab, k=30) + (["nastyword"] if i % 5 == 0 else []))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 600, 3)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    only = toxicity.train(docs.join(marks, "doc_id", "left_semi"), marks, prior=0.2)
    assert math.isclose(model["prior"], 0.2) and not np.array_equal(model["weights"], only["weights"])
    flipped = toxicity.train(docs, marks.filter("toxic = 1"), prior=0.2)  # without the others' labels: the same model
    assert np.array_equal(model["buckets"], flipped["buckets"]) and np.allclose(model["weights"], flipped["weights"])
    got = docs.select("doc_id", toxicity.toxicity_of(F.col("text"), model).alias("s")).collect()
    assert all((r.s >= 0.7) == (r.doc_id % 5 == 0) for r in got)


def test_grams_against_brute_force(monkeypatch):
    monkeypatch.setattr("catalogia.llm.toxicity.SLICE", 7)
    texts = ["Abc-defgh ÉÈ", None, "", "x" * 40, "a b c de"]
    got = Counter()
    for t, b in toxicity.gram_buckets(pa.array(texts)):
        got.update(zip(t.tolist(), b.tolist()))
    want = Counter()
    for k, t in enumerate(texts):
        raw = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in f" {t or ''} ".lower().encode())
        for n in toxicity.SIZES:
            for i in range(len(raw) - n + 1):
                if b" " not in raw[i + 1 : i + n - 1]:
                    h = 0
                    for c in raw[i : i + n]:
                        h = (h * 0x100000001B3 + c + 1) % 2**64
                    want[k, ((h ^ h >> 29) * 0x9E3779B97F4A7C15) % 2**64 >> 44] += 1
    assert got == want


def test_cut_is_at_the_prior_and_never_within_ties():
    f = np.array([0.0] * 90 + [3.0] * 10)
    b = toxicity.decision_bias(f, 0.1, 0.7, 100)
    assert (1 / (1 + np.exp(-(f + b))) >= 0.7).tolist() == [False] * 90 + [True] * 10
    assert ((np.zeros(50) + toxicity.decision_bias(np.zeros(50), 0.1, 0.7, 50)) < 0.8).all() and toxicity.decision_bias(np.zeros(1), 0.5, 0.7, 9) == 0.0


# ---- nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 9))
    x[700:760] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(2000, None, 1), (2100, [0.0] * 9, 1), (2200, [1.0] * 8 + [None], 1), (2300, [1.0] * 8 + [float("nan")], 1), (2400, [float("inf")] * 9, 1), (2500, [1.0, 2.0], 1), (None, [1.0] * 9, 1), (3, x[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q, found in got.items():
        d = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(x[q], x[i]))), i) for i in range(1500) if i != q]
        want = sorted(d)[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and all(math.isclose(s, dict((i, a) for a, i in d)[v], abs_tol=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {i for _, i in want})
    assert hits >= 0.95 * 150 and [v for _, v, _ in got[100]] == list(range(700, 710))
    few = ann.nearest(df.filter("vec_id in (100, 200, 201)")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(100, 200), (100, 201), (200, 100), (200, 201)]
    assert ann.nearest(df.limit(0)).collect() == [] and ann.nearest(df.filter("vec_id = 100")).collect() == []


def test_nearest_among_crowded_vectors(spark):
    """A third of the rows lies near one vector, closer than the codes can tell: the true ten must still come."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 16))
    crowd = rng.permutation(6000)[:2000]
    x[crowd] = x[crowd[0]] + rng.normal(size=(2000, 16)) * 0.02
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert set(got) == set(range(0, 6000, 100)) and len(set(got) & set(crowd.tolist())) > 10
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [found[k] for k in range(1, 11)] == np.argsort(d, kind="stable")[:10].tolist()


def test_nearest_with_uneven_norms_and_huge_components(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 8)) * np.exp(rng.normal(size=(3000, 1)) * 4)
    x[rng.permutation(3000)[:30]] *= 1e5
    x[[5, 700, 1999]] *= 1e160
    x[[6, 800]] = x[800] * 1e-200
    x[701] = x[700] * (1 + 1e-15)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 3000, 100))
    with np.errstate(all="ignore"):
        for q, found in got.items():
            d = np.zeros(3000)
            for k in range(8):
                d += (x[:, k] - x[q, k]) * (x[:, k] - x[q, k])
            d = np.sqrt(d)
            order = [i for i in np.lexsort((np.arange(3000), d)).tolist() if i != q][:10]
            assert [found[k][0] for k in range(1, 11)] == order and [found[k][1] for k in range(1, 11)] == d[order].tolist()


def test_nearest_with_repeated_ids_and_several_lengths(spark):
    """Rows of one id are vectors of their own, as queries and as candidates; vectors meet those of their length."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=7).tolist()) for i in range(40)]
    rows += [(7, (np.array(rows[0][1]) + 0.001).tolist()), (0, (np.array(rows[3][1]) + 0.001).tolist()), (0, rows[5][1]), (5, rows[5][1]), (300, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = []
    for k, (q, x) in enumerate(rows):
        if q % 100 == 0:
            d = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), i) for j, (i, y) in enumerate(rows) if j != k and len(y) == len(x)]
            want += [(q, r, i, s) for r, (s, i) in enumerate(sorted(d)[:10], 1)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(df).collect()]
    assert len(got) == 40 and [g[:3] for g in sorted(got, key=lambda g: (g[0], g[1], g[3]))] == [w[:3] for w in sorted(want, key=lambda w: (w[0], w[1], w[3]))]
    assert np.allclose(sorted(g[3] for g in got), sorted(w[3] for w in want))


def test_anisotropic_loss_favours_the_parallel_part():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16))
    q = ann.fit(x)

    def loss(codes):
        r = (x.reshape(2000, 8, 2) - np.stack([q.books[k][codes[:, k]] for k in range(8)], 1)).reshape(2000, 16)
        along = (r * x / np.linalg.norm(x, axis=1, keepdims=True)).sum(1) ** 2
        return along.mean(), ((r**2).sum(1) + (ann.ETA - 1) * along).mean()

    plain = ((x.reshape(2000, 8, 1, 2) - q.books[None]) ** 2).sum(3).argmin(2)
    assert loss(q.encode(x))[0] < 0.8 * loss(plain)[0] and loss(q.encode(x))[1] < loss(plain)[1]


# ---- WARC


def brute_warc(rows, least=0):
    by = {}
    for i, h in rows:
        by.setdefault(hashlib.sha1((h or "").encode()).digest(), []).append(i)
    out = []
    for i, h in rows:
        raw = (h or "").encode()
        d = hashlib.sha1(raw).digest()
        ids = [x for x in by[d] if x is not None]
        first = min(ids) if ids and len(raw) >= least else i
        out.append((i, len(raw), base64.b32encode(d).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def test_warc(spark):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabcd\r\n\r\n"
    htmls = [None, "", "<p>é</p>", trap, "x" + trap * 3 + "y", "dup", "dup", "dup", "WARC/1.1\r\n", "a\r\n\r\nb", "z" * 300_000, trap]
    rows = [(i * 2 - 3, h) for i, h in enumerate(htmls)] + [(None, "dup"), (None, "alone")]
    pages = spark.createDataFrame([(i, None if i == 1 else "http://a/\r\nX: y", h, "q") for i, h in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(pages).collect()), key=str)
    assert got == brute_warc(rows)
    assert warc.archived(pages.limit(0)).count() == 0


def test_long_urls_hide_no_page(spark, tmp_path):
    rows = [(k, "http://a/" + "u" * (100_000 if k == 5 else 3), f"page {k}") for k in range(11)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted(r.page_id for r in warc.archived(pages).collect()) == list(range(11))
    (tmp_path / "part-0").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nA: b\r\n\r\nc\r\n\r\nnot a record")
    with pytest.raises(Exception, match="no record at byte"):
        warc.read_archives(spark, str(tmp_path)).collect()


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("catalogia.llm.warc.FILE_BYTES", 50_000)
    pages = spark.createDataFrame([(k, "u", f"{k} " * 2_000) for k in range(60)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("part-*"))) >= 6
    assert sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path / "w")).collect()) == list(range(60))


def test_headers_are_searched_once():
    assert not list(warc.candidates(b"WARC/1.1\r\n" * 200_000))


def test_chain_needs_the_file_start():
    offs, nxt = np.array([0, 5, 9, 20, 30]), np.array([9, 20, 30, 30, 44])
    assert warc.reachable(offs, nxt).tolist() == [True, False, True, False, True]
    assert not warc.reachable(offs[1:], nxt[1:]).any() and warc.reachable(np.empty(0, int), np.empty(0, int)).tolist() == []
    n = 10_001
    assert warc.reachable(np.arange(n) * 3, np.arange(1, n + 1) * 3).all()


# ---- tool calls


def test_conversations(spark):
    rows = [(1, 0, "system", 'be "kind"\n'), (1, 1, "user", "hi"), (1, 2, "assistant", "hello\\ é"), (1, 3, "user", ""), (1, 4, "assistant", None), (2, 0, "assistant", "orphan"), (2, 1, "user", None), (3, 0, "system", "s" * 2001), (None, 0, "user", "x"), (4, 0, "user", "dup"), (4, 0, "user", "dup"), (5, None, "assistant", "y")]
    rows += [(9, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(150)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    out = chat.linked_conversations(df)
    got = {(r.kind, r.call_id): r for r in out.collect()}
    a = got["call", "1:1"]
    assert (a.depth, a.status, a.valid, a.result_id) == (1, "linked", True, "1:2")
    assert json.loads(a.message) == {"arguments": {"prompt": "hi", "turn": 1}, "id": "1:1", "name": "respond", "result": "hello\\ é"}
    assert a.message == json.dumps(json.loads(a.message), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got["call", "1:0"].status == "unanswered" and got["call", "1:0"].name == "configure" and got["call", "1:3"].errors == "range:prompt"
    assert got["call", "2:1"].errors == "missing:prompt" and got["call", "3:0"].errors == "range:prompt" and got["orphan_result", "2:-1"].status == "orphan"
    assert got["call", "4:0"].n_calls == 2 and got["orphan_result", None].result_id is not None
    assert all(got["call", f"9:{t}"].depth == t // 2 for t in range(0, 150, 2))
    assert chat.linked_conversations(df.limit(0)).count() == 0


def test_null_identifiers_keep_every_row(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "user", "b"), (6, None, "system", "c"), (None, 2, "assistant", "d"), (None, 2, "assistant", "d"), (6, None, "assistant", "e"), (7, 1, "user", "f"), (7, 2, "assistant", "g")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.linked_conversations(df).collect()
    calls = sorted((r.conv_id or 0, r.name, r.depth, r.n_calls, r.n_results, r.status, json.loads(r.message)["arguments"]["prompt"]) for r in got if r.kind == "call" and r.call_id is None)
    assert calls == [(0, "respond", 0, 1, 0, "unanswered", t) for t in "aab"] + [(6, "configure", 0, 1, 0, "unanswered", "c")]
    orphans = sorted((r.status, r.n_calls, r.n_results, json.loads(r.message)["result"]) for r in got if r.kind == "orphan_result")
    assert orphans == [("orphan", 0, 1, t) for t in "dde"]
    assert [(r.call_id, r.status, r.depth) for r in got if r.call_id] == [("7:1", "linked", 0)] and len(got) == 8
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    told = con.sql(llm_queries.ORACLE_SQL["op9_tool_calls"]).fetchall()
    # The SQL keeps these rows, too. It knows a call by its identifier, though, so it calls those without one orphans, and its NOT IN has no depth where
    # any identifier is null: these columns aren't compared.
    assert sorted((r[1] or 0, r[4] or "") for r in told) == sorted((r.conv_id or 0, r.name or "") for r in got)
    assert [(*r[:3], *r[4:]) for r in got if r.call_id] == [(*r[:3], *r[4:]) for r in told if r[2]]


def test_calls_in_general(spark):
    tools = {"add": {"a": ("int", True, 0, 9), "note": ("string", False, None, 3)}}
    cases = [('{"a": 3}', ""), ('{"a": 12}', "range:a"), ('{"a": "3"}', "type:a"), ('{"note": "xxxx"}', "missing:a,range:note"), ('{"a": 1, "z": 2, "b": 3}', "unexpected:b,unexpected:z"), ("[1]", "not_an_object"), ("{bad", "not_an_object"), (None, "not_an_object"), ('{"a": 1.5}', "type:a"), ('{"a": null}', "missing:a")]
    calls = [(f"c{i}", 1, "add", a, f"c{i - 1}" if i else None) for i, (a, _) in enumerate(cases)]
    calls += [("x", 1, "none", "{}", None), ("l1", 1, "add", '{"a":1}', "l3"), ("l2", 1, "add", '{"a":1}', "l1"), ("l3", 1, "add", '{"a":1}', "l2"), ("tail", 1, "add", '{"a":1}', "l1"), ("self", 1, "add", '{"a":1}', "self"), ("lost", 1, "add", '{"a":1}', "gone")]
    df = spark.createDataFrame(calls, "call_id string, conv_id long, name string, arguments string, parent_id string")
    res = spark.createDataFrame([("c0", "r2", "b"), ("c0", "r1", "a"), ("nobody", "r3", "c")], "call_id string, result_id string, content string")
    got = {r.call_id: r for r in chat.link_calls(df, res, tools).collect()}
    assert [got[f"c{i}"].errors for i in range(len(cases))] == [e for _, e in cases] and got["x"].errors == "unknown_tool"
    assert [got[f"c{i}"].depth for i in range(len(cases))] == list(range(len(cases)))
    assert all(got[k].status == "cycle" and got[k].depth is None for k in ("l1", "l2", "l3", "tail", "self")) and got["lost"].depth == 0
    assert (got["c0"].n_results, got["c0"].result_id, got["nobody"].kind) == (2, "r1", "orphan_result")
    assert got["c4"].message == '{"arguments":{"a":1,"b":3,"z":2},"id":"c4","name":"add","result":null}'


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.linked_conversations(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_adpcm_of_many_files_together(monkeypatch):
    monkeypatch.setattr("catalogia.llm.telephony.BLOCKS_AT_ONCE", 3)
    rng = np.random.default_rng(2)
    files = [telephony.wav(rng.integers(0, 256, 192 * n, np.uint8).tobytes(), tag, 8000, *((4, 192) if tag == telephony.IMA_ADPCM else (8, 1))) for n, tag in ((1, 17), (5, 17), (2, 7), (4, 6), (7, 17))]
    found = telephony.adpcm_together(files)
    assert [x is None for x in found] == [False, False, True, True, False]
    monkeypatch.setattr("catalogia.llm.telephony.BLOCKS_AT_ONCE", 8192)
    for f, x in zip(files, found):
        assert telephony.to_pcm(f, 4000, x).tolist() == telephony.to_pcm(f, 4000).tolist()
    assert telephony.adpcm_together([]) == []
