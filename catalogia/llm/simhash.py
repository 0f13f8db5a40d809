"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two fingerprints of B bytes that differ in at most d < B bits share at least B - d bytes at the same positions. The index has a posting
list for each choice of positions in `cover` and each value of the bytes there (an intersection of the lists of single positions, which would hold a 256th of
all fingerprints each); the choices are such that any B - d positions hold one of them, so no qualifying pair is missed. For each pair of a list
the shared positional bytes are tallied; pairs below the guaranteed minimum are dropped, and only the others are verified by their differing bits.

Equal fingerprints count once. A list never becomes pairs: a task keeps only links that join something new (a spanning forest). Lists of more than
HOT fingerprints are cut into blocks that share some pivots; only what is not joined with most of its list by these links is compared with all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from catalogia.llm import common
from catalogia.llm.components import components

SEED = 42
HOT = 2_048
#: Rows of a cut list that are in all its blocks.
PIVOTS = 32


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles, repeats included; A-Z in lower case, words cut at ASCII white space; fewer words than size: one shingle."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(w) - size + 1].tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())]), ">u8").astype(np.uint64)


def widened(h: np.ndarray, words: int) -> np.ndarray:
    """Each hash as `words` hashes: itself, then mixes of it with further constants."""
    if words == 1:
        return h[:, None]
    k = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = h[:, None] + k
    x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x[:, 1:] ^= x[:, 1:] >> np.uint64(31)
    x[:, 0] = h
    return x


def fingerprint(text: str | None, size: int, words: int = 1) -> bytes:
    """A bit is 1 if it is set in over half the shingles' hashes; no word: all zero. Big-endian, 8 bytes a word."""
    return majority(shingle_hashes(text, size), words)


def majority(h: np.ndarray, words: int = 1) -> bytes:
    """The fingerprint of hashes."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 255 * 64):
        bits = np.unpackbits(widened(h[at : at + 255 * 64], words).astype(">u8").view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h)).tobytes()


def cover_of_eight() -> list[tuple[int, ...]]:
    """20 triples of the 8 byte positions such that any 4 positions hold one (Turan's construction: triples within one of three groups, or two of a group and one of the next)."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    triples = [g for g in groups if len(g) == 3]
    for k, g in enumerate(groups):
        triples += [tuple(sorted((*two, x))) for two in combinations(g, 2) for x in groups[(k + 1) % 3]]
    return sorted(triples)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of the links (a, b) join something new."""
    root = list(range(n))
    new = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            new.append(k)
    return new


def close_pairs(prints: np.ndarray, ids: np.ndarray, lists: np.ndarray, radius: int, least: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within each run of equal `lists`; prints: (n, bytes) uint8. side: 0 and 1 for a block against another; only pairs of unlike sides count, 2 pairs with all."""
    words = np.ascontiguousarray(prints).view(np.uint64)
    cuts = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1], [True])))
    lengths = np.diff(cuts)

    def good(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Tallies first, then verifies what reaches the minimum."""
        keep = (prints[i] == prints[j]).sum(1, dtype=np.int64) >= least if least else np.ones(len(i), bool)
        k = np.flatnonzero(keep)
        keep[k] = np.bitwise_count(words[i[k]] ^ words[j[k]]).sum(1, dtype=np.int64) <= radius
        return keep

    # Short lists: all at once, one distance within the list at a time.
    place = np.arange(len(lists)) - np.repeat(cuts[:-1], lengths)
    length = np.repeat(lengths, lengths)
    short = length <= 64
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for lag in range(1, int(length[short].max()) if short.any() else 0):
        i = np.flatnonzero(short & (place + lag < length))
        if side is not None:
            i = i[(side[i] != side[i + lag]) | (side[i] == 2)]
        for c in range(0, len(i), 200_000):
            x = i[c : c + 200_000]
            x = x[good(x, x + lag)]
            if len(x):
                found.append((x, x + lag))
    if found:
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        keep = _forest(len(lists), a, b)
        yield ids[a[keep]], ids[b[keep]]
    # Long ones: row against the rows behind it, keeping the forest of the list.
    for s, e in zip(cuts[:-1][lengths > 64].tolist(), cuts[1:][lengths > 64].tolist()):
        a, b = [], []
        for x in range(s, e - 1):
            rest = np.arange(x + 1, e)
            if side is not None:
                rest = rest[(side[rest] != side[x]) | (side[x] == 2)]
            hit = rest[good(np.full(len(rest), x), rest)]
            a.append(np.full(len(hit), x - s))
            b.append(hit - s)
        a, b = np.concatenate(a), np.concatenate(b)
        keep = _forest(e - s, a, b)
        yield ids[a[keep] + s], ids[b[keep] + s]


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut only between lists (column list, in order): a batch may end within a list, so its last list waits for the next batch."""
    held: pa.Table | None = None
    for b in (*batches, None):
        t = held
        if b is not None:
            new = pa.Table.from_batches([b])
            t = new if held is None else pa.concat_tables([held, new])
        if t is None or not t.num_rows:
            continue
        key = t.column("list").to_numpy()
        end = len(key) if b is None else int(np.searchsorted(key, key[-1], "left"))
        held = t.slice(end)
        if end:
            yield t.slice(0, end)


def _links(dealt: DataFrame, compare, name: str) -> DataFrame:
    """Links a, b within each list of dealt (list, rep, side and what compare reads), a task's lists one after the other."""
    dealt = dealt.repartition("list").sortWithinPartitions("list", "rep")
    return common.saved(dealt.mapInArrow(compare, "a long, b long").filter("a <> b").distinct(), name)


def connected(rows: DataFrame, large: DataFrame, compare, pivots: int, name: str) -> DataFrame:
    """Links a, b that join all close pairs within the lists of rows (list, rep, and what compare reads; cheap to read again).

    large: list, n, blocks of the lists that no one task should get whole. Each is cut into blocks, and `pivots` of its rows are in all of them. Where the
    links so found leave rows of a list apart from most of it, these rows are compared with the whole list, blocks against blocks; rows that
    links already join need no comparison. So nothing is missed, and a large list of near copies costs in proportion to its length.
    """
    n_large = large.count()
    if not n_large:
        return _links(rows.withColumn("side", F.lit(2)), compare, name)
    names = [c for c in rows.columns if c != "list"]
    hot = rows.join(common.small_or_not(large, n_large), "list")  # a row of large stands for many of rows
    order = Window.partitionBy("list").orderBy(F.xxhash64("rep"), "rep")
    chosen = hot.select("list", "rep", F.row_number().over(order).alias("r")).filter(F.col("r") <= pivots).select(F.col("list").alias("l"), F.col("rep").alias("p"))
    chosen = common.saved(chosen, f"{name}-pivots")
    hot = common.saved(hot.join(common.small_or_not(chosen, n_large * pivots), (F.col("list") == F.col("l")) & (F.col("rep") == F.col("p")), "left").withColumn("pivot", F.col("p").isNotNull()).drop("l", "p"), f"{name}-large")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    at = F.explode(F.when(F.col("pivot"), every).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))))
    first = rows.join(common.small_or_not(large.select("list"), n_large), "list", "left_anti").unionByName(hot.withColumn("at", at).select(F.xxhash64("list", "at").alias("list"), *names))
    links = _links(first.withColumn("side", F.lit(2)), compare, name)
    roots = components(links).withColumnRenamed("node", "x")
    known = hot.select("list", "rep").join(roots, F.col("rep") == F.col("x"), "left").select("list", "rep", F.coalesce("root", "rep").alias("root"))
    known = common.saved(known, f"{name}-joined")
    most = known.groupBy("list", "root").agg(F.count("*").alias("k")).groupBy(F.col("list").alias("l")).agg(F.max(F.struct("k", "root"))["root"].alias("most"))
    apart = known.join(most, F.col("list") == F.col("l")).filter("root <> most").select("list", "rep")
    apart = common.saved(apart, f"{name}-apart")
    if apart.isEmpty():
        return links
    # Two sides of half a block each.
    left = apart.groupBy("list").agg(F.count("*").alias("m")).join(large, "list").select("list", F.ceil(2 * F.col("blocks") * F.col("m") / F.col("n")).cast("int").alias("parts"))
    hot = hot.drop("pivot").join(left, "list").withColumn("whole", 2 * F.col("blocks"))
    deal = lambda count, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(count)).cast("int")
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    mine = hot.join(apart, ["list", "rep"]).withColumn("i", deal("parts", 1)).withColumn("j", all_of("whole")).withColumn("side", F.lit(0))
    theirs = hot.withColumn("j", deal("whole", 2)).withColumn("i", all_of("parts")).withColumn("side", F.lit(1))
    again = mine.unionByName(theirs).select(F.xxhash64("list", "i", "j").alias("list"), *names, "side")
    return common.saved(links.union(_links(again, compare, f"{name}-again")).distinct(), f"{name}-all")


def link(prints: DataFrame, n_bytes: int, radius: int, cover: list[tuple[int, ...]] | None, least: int, hot: int = HOT) -> DataFrame:
    """prints: rep (long), fingerprint (binary), all different. Returns links a, b that join all pairs within the radius that share a list.

    Without a cover, prints has the lists itself (lists, array of longs).
    """
    lists = F.col("lists") if cover is None else F.array(*(F.xxhash64(F.lit(k), *(F.substring("fingerprint", p + 1, 1) for p in c)) for k, c in enumerate(cover)))
    posts = prints.select("rep", "fingerprint", F.explode(lists).alias("list"))
    pivots = min(PIVOTS, hot // 2)
    large = prints.select(F.explode(lists).alias("list")).groupBy("list").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    large = common.saved(large.withColumn("blocks", F.ceil(F.col("n") / (hot - pivots)).cast("int")), "hot-lists")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_lists(batches):
            raw = np.frombuffer(b"".join(t.column("fingerprint").to_pylist()), np.uint8).reshape(-1, n_bytes)
            for x, y in close_pairs(raw, t.column("rep").to_numpy(), t.column("list").to_numpy(), radius, least, t.column("side").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    common.small_batches(prints.sparkSession, 200_000, 32)
    return connected(posts, large, compare, pivots, "close")


def fingerprints(docs: DataFrame, size: int, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (binary) of each row; whole texts, null as empty. No exchange."""
    common.small_batches(docs.sparkSession, 2000)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t, size, words) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "fingerprint"])

    return src.mapInArrow(run, "doc_id long, fingerprint binary")


def near_duplicates(docs: DataFrame, size: int = 4, words: int = 1, radius: int = 4, cover: list[tuple[int, ...]] | None = None, least: int | None = None) -> DataFrame:
    """doc_id, fingerprint (binary), component_id (the smallest doc_id that links reach) of each row of docs.

    The 64-bit default (radius 4: at least 4 of 8 bytes shared) is exact. Rows with a null id share the class of their fingerprint but never name it
    (null if no other row is there). Null texts, and texts without a word, have fingerprint zero; texts of any length count whole, and take a task a hash a
    shingle. An empty table has no rows; other columns don't matter, also where they are called like those of the result.
    """
    n_bytes = 8 * words
    found = common.saved(fingerprints(docs, size, words), "fingerprints")
    reps = common.saved(found.filter("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    links = link(reps, n_bytes, radius, cover or cover_of_eight(), n_bytes - radius if least is None else least)
    roots = components(links)
    classes = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", F.coalesce("root", "rep").alias("component_id"))
    return found.join(classes, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def linked_fingerprints(docs: DataFrame) -> DataFrame:
    """Four-word shingles, 64 bits, links at 4 or fewer differing bits; the fingerprint as 16 hexadecimal digits."""
    return near_duplicates(docs).select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


#: Proposals for the near copies of the corpus: HASHES minima of a document's different shingles, BANDS lists by ROWS minima each, and two bits of
#: every minimum as a print. At a similarity of exactly 0.8 two documents share no list with probability (1 - 0.8 ** 6) ** 32 = 6e-5, and their
#: prints differ in 51 of 512 bits on average, with a standard deviation of 8: WIDE is 4.5 of these above. Only shingles count, so texts of any length are alike.
HASHES, BANDS, ROWS, WIDE = 256, 32, 6, 88
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, HASHES, np.uint64, endpoint=False) | np.uint64(1)
#: A link of near copies: at least ALIKE[0] / ALIKE[1] of the shingles of both are in each of them.
ALIKE = (4, 5)
COPY_SIZE = 5
#: Verification: members, and shingles of all members, of a block; larger groups are dealt out as blocks against blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 128, 1 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """The different shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, COPY_SIZE))


def set_key(h: np.ndarray) -> int:
    """A long for a shingle set."""
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - (1 << 63)


def sketch(h: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The print (512 bits) and the lists of a shingle set."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 256):
        np.minimum(least, (h[at : at + 256, None] * MULTIPLIERS).min(0), out=least)
    two = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(62)
    raw, width = least.tobytes(), 8 * ROWS
    lists = [xxhash.xxh64_intdigest(raw[width * k : width * (k + 1)], k) for k in range(BANDS)]
    return np.packbits(np.stack((two & np.uint64(1), two >> np.uint64(1))).astype(np.uint8)).tobytes(), np.array(lists, np.uint64).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, words (a hash of the text), rep (a long for the shingle set), simhash (of the different shingles, 64 bits), fingerprint, lists of each row. No exchange."""
    common.small_batches(docs.sparkSession, 2000)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("words"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "words", "rep", "simhash", "fingerprint", "lists"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, bits, prints, lists = [], [], [], []
            for t in b.column("text").to_pylist():
                h = shingle_set(t)
                p, k = sketch(h)
                sets.append(set_key(h))
                bits.append(majority(h))
                prints.append(p)
                lists.append(k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("words"), pa.array(sets, pa.int64()), pa.array(bits, pa.binary()), pa.array(prints, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names)

    return src.mapInArrow(run, "doc_id long, words long, rep long, simhash binary, fingerprint binary, lists array<long>")


def alike(sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of shingle sets are near copies, by exact counts; side as in close_pairs."""
    n = len(sets)
    sizes = np.array(list(map(len, sets)))
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set alone is in no intersection
    here = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[here]], np.repeat(np.arange(n), sizes)[here]
    order = np.argsort(column, kind="stable")
    column, owner, total = column[order], owner[order], int(shared.sum())
    both = np.zeros((n, n), np.float64)
    for at in range(0, total, 4096):
        low, high = np.searchsorted(column, (at, at + 4096))
        held = np.zeros((n, min(4096, total - at)), np.float32)
        held[owner[low:high], column[low:high] - at] = 1
        both += held @ held.T
    good = ALIKE[1] * both >= ALIKE[0] * (sizes[:, None] + sizes[None] - both)
    return np.nonzero(np.triu(good & ((side[:, None] != side[None]) | (side[:, None] == 2)), 1))


def verified(docs: DataFrame, groups: DataFrame, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """groups: doc_id (that has the text), rep, root. Links a, b that join all pairs of reps of one root that are near copies."""
    spark = docs.sparkSession
    common.small_batches(spark, 2000)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column("text").to_pylist()]
            mine = pa.array([set_key(h) == k for h, k in zip(sets, b.column("rep").to_pylist())], pa.bool_())  # an id may have other texts, too
            cols = [b.column("rep"), b.column("root"), pa.array(map(len, sets), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "root", "n", "shingles"]).filter(mine)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(common.small_or_not(groups, groups.count()), "doc_id").select("rep", "root", "text")
    sets = common.saved(texts.mapInArrow(cut, "rep long, root long, n long, shingles binary").dropDuplicates(["rep"]), "shingle-sets")
    blocks = F.ceil(F.greatest(F.count("*") / block_rows, F.sum("n") / block_shingles)).cast("int").alias("blocks")
    sets = sets.select(F.col("root").alias("list"), "rep", "n", "shingles")
    large = common.saved(sets.groupBy("list").agg(F.sum("n").alias("weight"), F.count("*").alias("n"), blocks).filter("blocks > 1").select("list", "n", "blocks"), "large-groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_lists(batches):
            key, side, reps = (t.column(c).to_numpy() for c in ("list", "side", "rep"))
            shingles = t.column("shingles").to_pylist()
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist()
            x, y = [], []
            for s, e in zip(cuts, cuts[1:]):
                if e - s > 1:
                    a, b = alike([np.frombuffer(h, np.uint64) for h in shingles[s:e]], side[s:e])
                    keep = _forest(e - s, a, b)
                    x.append(reps[a[keep] + s])
                    y.append(reps[b[keep] + s])
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()), pa.array(np.concatenate(y), pa.int64())], ["a", "b"])

    return connected(sets.drop("n"), large, run, max(1, min(8, block_rows // 4)), "verified")


def simhash_links(reps: DataFrame) -> DataFrame:
    """reps: rep, simhash. Links a, b that join all whose SimHashes differ in at most 4 bits, by the byte-position index with count filtering."""
    classes = common.saved(reps.groupBy("simhash").agg(F.min("rep").alias("rep")), "simhash-classes")
    equal = reps.join(classes.withColumnRenamed("rep", "b"), "simhash").select(F.col("rep").alias("a"), "b").filter("a <> b")
    return equal.union(link(classes.select("rep", F.col("simhash").alias("fingerprint")), 8, 4, cover_of_eight(), 4))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, words (a hash of the text), rep, first (the smallest doc_id that links of near copies reach) of each row; every row has an id and a word.

    SimHashes within 4 bits propose, and so do sketches, which reach down to a similarity of 0.8, where SimHashes are further apart. Proposals make groups, and
    within each group all pairs are compared by their exact shingle sets. Only such links count.
    """
    found = common.saved(sketches(docs), "sketches")
    reps = common.saved(found.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.first("simhash").alias("simhash"), F.first("fingerprint").alias("fingerprint"), F.first("lists").alias("lists")), "sketch-classes")
    groups = components(simhash_links(reps.select("rep", "simhash")).union(link(reps.select("rep", "fingerprint", "lists"), HASHES // 4, WIDE, None, 0)))
    groups = common.saved(reps.select("rep", "doc_id").join(groups, F.col("rep") == F.col("node")).select("doc_id", "rep", "root"), "proposed")
    roots = components(verified(docs, groups)).withColumnRenamed("node", "rep")
    linked = reps.select("rep", "doc_id").join(roots, "rep")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("first"))
    classes = reps.select("rep", "doc_id").join(linked.select("rep", "root").join(least, "root"), "rep", "left").select("rep", F.coalesce("first", "doc_id").alias("first"))
    return found.join(classes, "rep").select("doc_id", "words", "rep", "first")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without those that are near copies (at least four fifths of both's different five-word shingles shared) of one with a smaller id, or of such a one.

    Every link is verified by the exact shingle sets; one at the very edge is missed with a probability of under 1e-4 (see HASHES).
    Rows of one id and shingle set are one document's repeats: rows of equal id and text become one. Rows without a word aren't compared, and stay.
    """
    names = docs.columns
    wordless = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$") | F.col("doc_id").isNull()
    rows = docs.filter(~wordless)
    near = common.saved(near_copies(rows), "near")
    gone_id, gone_words = common.new_name(docs, "gone"), common.new_name(docs, "words")
    gone = near.filter(F.col("first") < F.col("doc_id")).select(F.col("doc_id").alias(gone_id), F.col("words").alias(gone_words)).distinct()
    gone = common.saved(gone, "gone")
    kept = rows.join(common.small_or_not(gone, gone.count()), (F.col("doc_id").cast("long") == F.col(gone_id)) & (F.xxhash64("text") == F.col(gone_words)), "left_anti")
    if not near.groupBy("doc_id", "rep").count().filter("count > 1").isEmpty():
        print_of = common.new_name(docs, "print")
        kept = kept.withColumn(print_of, F.xxhash64("text")).dropDuplicates(["doc_id", print_of]).drop(print_of)
    return kept.select(*names).union(docs.filter(wordless).select(*names))
