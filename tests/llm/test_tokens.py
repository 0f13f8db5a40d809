import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from catalogia.llm import bpe, packing, token_files
from catalogia.llm.wordpieces import Memory, library_encoder

BYTE = P.path("byte_bpe_50k.json")
MULTI = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  a  b ", "a\n b\t c", "x " * 50, "l'été d'un 's 's", "a\x1cb \x1c c", "y" * 5000, "aaaa" * 999 + " " + "é" * 700, "日本語 テキスト", "same text", "same text"]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def docs(spark, texts, extra=True):
    rows = [(7 * i - 20, t, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start long, line string").repartition(3)


PARTS = ["a", "b", "é", "ß", "Z", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\u00a0", "\u3000", "'", "'s", "'re", "'ll", "'m", "'x", ".", ",", "$$", "1", "²", "½", "ª", "日", "😀", "ɏ", "ɐ", "\x00", "<|endoftext|>"]


def compare(texts, lib, tik):
    got = [np.frombuffer(x, np.uint32).tolist() for x in library_encoder(BYTE).encode(texts)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(x, np.uint32).tolist() for x in bpe.codec(MULTI, P.PATTERN).encode(texts)]
    assert got == [tik.encode_ordinary(t) for t in texts]


def test_words_equal_the_whole(lib, tik):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), max_size=5))
    def each(texts):
        compare(texts, lib, tik)

    each()
    rnd = random.Random(9)
    compare(["".join(rnd.choices(PARTS[:20] + PARTS[20:25] * 3, k=rnd.randrange(40))) for _ in range(20_000)], lib, tik)


def test_many_groups_and_sliced_columns(monkeypatch, lib, tik):
    monkeypatch.setattr("catalogia.llm.wordpieces.GROUP_BYTES", 20)
    texts = [t for t in ODD if t is not None]
    compare(texts, lib, tik)
    column = pa.array(["before", *texts, "after"]).slice(1, len(texts))
    assert list(library_encoder(BYTE).encode(column)) == list(library_encoder(BYTE).encode(texts))


def test_memory_forgets_only_what_is_not_met():
    m, asked = Memory(3), []

    def encode(words):
        asked.extend(words)
        return [w.upper() for w in words]

    for words in ([b"a", b"b", b"c", b"d"], [b"a", b"e"], [b"f", b"g", b"a"], [b"h"], [b"a", b"b", b"z" * 99], [b"z" * 99]):
        assert m.ids(words, encode) == [w.upper() for w in words]
        assert len(m.young) <= 8 and len(m.old) <= 8
    assert asked.count(b"a") == 1 and asked.count(b"b") == 2 and asked.count(b"z" * 99) == 2


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300))
def test_bit_packing_round_trip(width, ids):
    a = np.array(ids, np.uint32) & np.uint32((1 << width) - 1)
    packed = token_files.pack(a, width)
    assert len(packed) == -(-len(a) * width // 8)
    assert (token_files.unpack(packed, len(a), width) == a).all()


def test_shard_random_access():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 50257, int(n)).astype(np.uint32) for n in (0, 1, 70_000, 5, 200_001, 3)]
    data = b"".join(x + b"\n" for x in token_files.shard_lines(((i or None, a.tobytes()) for i, a in enumerate(ids)), 4, 16))
    s = token_files.Shard(data)
    assert [(n, a.tolist()) for n, _, a in s.documents(at_once=1)] == [(i or None, a.tolist()) for i, a in enumerate(ids)]
    assert all((s.ids(int(s.starts[i]), int(s.starts[i + 1])) == a).all() for i, a in enumerate(ids))


def test_token_files(spark, lib):
    src = docs(spark, ODD * 3)
    got = sorted(map(tuple, token_files.token_index(src, BYTE, 50257).collect()))
    want, start = [], 0
    for r in sorted(src.collect()):
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_token_files_empty_and_null_ids(spark):
    empty = docs(spark, ODD).limit(0)
    assert token_files.token_index(empty, BYTE, 50257).collect() == []
    twice = spark.createDataFrame([(None, "b"), (3, "a"), (3, "a"), (None, None)], "doc_id long, text string")
    got = sorted(token_files.token_index(twice, BYTE, 50257).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 3, 3] and [r.start for r in got] == [0, 1, 3, 5]


def test_rows_of_one_id_are_dealt_over_shards(spark, lib, tmp_path):
    """Every row has one id, a third of them the same text: no shard takes them all, and starts have no gap."""
    rows = [(7, "same" if i % 3 == 0 else f"text {i}") for i in range(600)]
    path = str(tmp_path / "files")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), BYTE, 50257, path, shards=6)
    got = token_files.read_token_files(spark, path).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append((r.start, r.n_tokens))
    assert len(got) == 600 and len(by) == 6 and max(map(len, by.values())) < 200
    for found in by.values():
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
    index = token_files.token_index(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), BYTE, 50257).collect()
    assert sorted(r.n_tokens for r in index) == sorted(len(lib.encode(t).ids) + 1 for _, t in rows)
    at = 0
    for r in sorted(index, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_rank_queue_equals_tiktoken(tik):
    ranks = bpe.read_ranks(MULTI)
    rnd = random.Random(3)
    words = ["", "a", "aaaaaaaaaaaa", "é" * 40, "Straße", "the" * 200, "日本語" * 30]
    words += ["".join(rnd.choices("abcdeéth ,.", k=rnd.randrange(1, 60))) for _ in range(300)] + ["".join(rnd.choices("abcth", k=20_000))]
    for w in words:
        for m in bpe.codec(MULTI, P.PATTERN).pattern.findall(w):
            assert bpe.merge(m.encode(), ranks) == tik.encode_ordinary(m)


def test_bpe_documents(spark, tik):
    src = docs(spark, ODD)
    got = sorted(map(tuple, bpe.encode_documents(src, MULTI, P.PATTERN).collect()))
    want = []
    for r in src.collect():
        t = r.text or ""
        ids = np.array(tik.encode_ordinary(t), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_documents(src.limit(0), MULTI, P.PATTERN).count() == 0


def check_packing(rows, capacity):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in seqs.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_pack_items(spark):
    rnd = random.Random(5)
    for sizes in ([], [5], [100], [51] * 60, [51] * 30 + [49] * 30, [rnd.randrange(1, 101) for _ in range(900)]):
        items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k long, length long").repartition(5)
        rows = packing.pack_items(items, 100, 2).collect()
        assert sorted((r.k, r.length) for r in rows) == list(enumerate(sizes))
        bins = check_packing(rows, 100)
        if len(set(sizes)) == 2:
            assert bins == 30
        if len(sizes) == 900:
            assert bins <= 1.06 * sum(sizes) / 100


@pytest.mark.parametrize("task_items", [40, 100_000])
def test_a_task_packs_a_bounded_number_of_items(spark, task_items):
    """Partitions of many more items than a task may pack at once, and columns with the names that the result has."""
    rnd = random.Random(8)
    sizes = [rnd.randrange(1, 101) for _ in range(1500)]
    schema = "sequence_id long, offset string, fill int, merged int, item int, length long"
    items = spark.createDataFrame([(i, "x", 1, 2, 3, n) for i, n in enumerate(sizes)], schema).repartition(3)
    out = packing.pack_items(items, 100, 2, task_items)
    assert out.columns == ["_sequence_id", "_offset", "fill", "merged", "item", "length", "sequence_id", "offset"]
    rows = out.collect()
    assert sorted((r._sequence_id, r._offset, r.length) for r in rows) == [(i, "x", n) for i, n in enumerate(sizes)]
    assert check_packing(rows, 100) <= 1.06 * sum(sizes) / 100


def test_best_fit_against_brute_force():
    rnd = random.Random(6)
    for _ in range(50):
        sizes = np.array([rnd.randrange(1, 31) for _ in range(rnd.randrange(0, 60))], np.int64)
        where, offset, fills = packing.best_fit(sizes, 30)
        bins = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = [b for b in bins if b[0] + s <= 30]
            best = max(fit, key=lambda b: b[0]) if fit else None
            if best is None:
                bins.append([s])
            else:
                best[0] += s
        assert sorted(fills.tolist()) == sorted(b[0] for b in bins)


def test_pack_documents(spark, lib):
    long = " ".join(f"w{i}" for i in range(3000))
    src = docs(spark, [*ODD, long, long + " x"])
    rows = packing.pack_documents(src, BYTE).collect()
    check_packing(rows, 2048)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in src.collect():
        ids = np.array(lib.encode(d.text or "", add_special_tokens=False).ids + [0], "<u4")
        ps = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(-(-len(ids) // 2048))) and all(p.length == 2048 for p in ps[1:])
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in ps) and sum(p.length for p in ps) == len(ids)
    assert packing.pack_documents(src.limit(0), BYTE).collect() == []
