"""Token-id files by fixed-width bit packing.

Each id takes the fewest bits that hold every id of the vocabulary. A shard file is a row of lines, each closed by one byte 10:
a header, blocks of BLOCK_IDS ids (the last may be shorter), a footer (documents, their starts, the blocks' byte offsets) and a
trailer of fixed length. The offsets let a reader take any document alone, or unpack all blocks at once with numpy.
Spark's text writer puts the lines down as they are, so the files can lie in any file system that Spark writes to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from catalogia.llm import common
from catalogia.llm.wordpieces import library_encoder

MAGIC = b"IDPACK01"
HEADER = struct.Struct("<8sBIQ")
TRAILER = struct.Struct("<QQQQ8s")
#: A multiple of 64, so that full blocks end on a whole byte for any width.
BLOCK_IDS = 65_536
END_ID = 0
TIE_CHARS = 32
#: Characters of text that a shard holds on average, at most.
SHARD_CHARS = 128 << 20


def bits_for(vocabulary: int) -> int:
    """Bits for ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """64 ids fill `width` 64-bit words; each of the 64 places is handled for all groups at once."""
    n = len(ids)
    groups = -(-n // 64)
    a = np.zeros(groups * 64, np.uint64)
    a[:n] = ids
    a = a.reshape(groups, 64)
    words = np.zeros((groups, width), np.uint64)
    for k in range(64):
        w, s = divmod(k * width, 64)
        words[:, w] |= a[:, k] << np.uint64(s)
        if s + width > 64:
            words[:, w + 1] |= a[:, k] >> np.uint64(64 - s)
    return words.astype("<u8").tobytes()[: -(-n * width // 8)]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    groups = -(-n // 64)
    words = np.frombuffer(data + bytes(groups * width * 8 - len(data)), "<u8").reshape(groups, width)
    out = np.empty((groups, 64), np.uint64)
    for k in range(64):
        w, s = divmod(k * width, 64)
        v = words[:, w] >> np.uint64(s)
        if s + width > 64:
            v = v | words[:, w + 1] << np.uint64(64 - s)
        out[:, k] = v
    return (out & np.uint64((1 << width) - 1)).astype(np.uint32).reshape(-1)[:n]


def shard_lines(docs: Iterator[tuple[int | None, bytes]], shard: int, width: int) -> Iterator[bytes]:
    """docs: (doc_id, ids as unsigned 32-bit bytes) in file order."""
    line = HEADER.pack(MAGIC, width, BLOCK_IDS, shard)
    at = len(line) + 1
    yield line
    names, null, starts, offsets, total = [], [], [0], [], 0
    held: list[np.ndarray] = []
    waiting = 0

    def blocks(least: int) -> Iterator[bytes]:
        nonlocal held, waiting, at
        ids = np.concatenate(held) if held else np.empty(0, np.uint32)
        k = 0
        while len(ids) - k >= least:
            part = ids[k : k + BLOCK_IDS]
            packed = pack(part, width)
            offsets.append(at)
            at += len(packed) + 1
            k += len(part)
            yield packed
        held, waiting = [ids[k:]], len(ids) - k

    for name, raw in docs:
        ids = np.frombuffer(raw, np.uint32)
        names.append(name or 0)
        null.append(name is None)
        total += len(ids)
        starts.append(total)
        held.append(ids)
        waiting += len(ids)
        if waiting >= BLOCK_IDS * 16:
            yield from blocks(BLOCK_IDS)
    if waiting:
        yield from blocks(1)
    yield b"".join((np.array(names, "<i8").tobytes(), np.array(null, np.uint8).tobytes(), np.array(starts, "<u8").tobytes(), np.array(offsets, "<u8").tobytes()))
    yield TRAILER.pack(len(names), len(offsets), total, at, MAGIC)


class Shard:
    """A shard file's bytes, for reading."""

    def __init__(self, content: bytes):
        magic, self.width, self.block_ids, self.number = HEADER.unpack_from(content)
        n, blocks, self.total, at, end = TRAILER.unpack_from(content, len(content) - TRAILER.size - 1)
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a shard of packed ids")
        self.content = content
        names = np.frombuffer(content, "<i8", n, at)
        null = np.frombuffer(content, np.uint8, n, at + 8 * n)
        self.names = [None if z else x for x, z in zip(names.tolist(), null.tolist())]
        self.starts = np.frombuffer(content, "<u8", n + 1, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(content, "<u8", blocks, at + 9 * n + 8 * (n + 1)).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.total - k * self.block_ids)
        at = int(self.offsets[k])
        return unpack(self.content[at : at + -(-n * self.width // 8)], n, self.width)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from start to end: only the blocks that hold them are unpacked."""
        if end <= start:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids : end - first * self.block_ids]

    def documents(self, at_once: int = 64) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) of each document, a bounded number of blocks at a time."""
        have, base, nxt = np.empty(0, np.uint32), 0, 0
        for name, a, b in zip(self.names, self.starts[:-1].tolist(), self.starts[1:].tolist()):
            if b > base + len(have):
                parts = [have[a - base :]]
                base, size = a, len(parts[0])
                while nxt < len(self.offsets) and (base + size < b or len(parts) <= at_once):
                    parts.append(self.block(nxt))
                    size += len(parts[-1])
                    nxt += 1
                have = np.concatenate(parts)
            yield name, a, have[a - base : b - base]


def write_token_files(docs: DataFrame, tokenizer: str, vocabulary: int, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encodes every text (null: empty), appends END_ID, and writes the ids in ascending id order.

    Null ids come first; rows with equal ids follow one another by the first TIE_CHARS characters of their texts, then by a hash of these. Shards are ranges of
    all that, and repeated rows are numbered, so an id that many rows have is dealt over many shards. Their number grows with the text, so that a file
    stays small enough to be read whole by one task. An empty table writes no shard. Other columns of docs don't matter.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), (src.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS + 1)
    order = ["doc_id", "start", "hash", "number"]
    src = src.select("doc_id", "text", F.substring("text", 1, TIE_CHARS).alias("start"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("number"))
    src = src.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("shard"))
    width = bits_for(vocabulary)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        end = np.uint32(END_ID).tobytes()
        number = 0

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            nonlocal number
            for b in batches:
                if b.num_rows:
                    number = b.column("shard")[0].as_py()
                    for name, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text"))):
                        yield name, ids + end

        it = encoded()
        first = next(it, None)
        if first is None:
            return
        for line in shard_lines(_chained(first, it), number, width):
            yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], ["line"])

    src.mapInArrow(lines, "line binary").select(F.col("line").cast("string").alias("value")).write.text(path)


def _chained(first, rest):
    yield first
    yield from rest


def read_token_files(spark, path: str) -> DataFrame:
    """A row for each document of the files: shard, doc_id, start (in the shard), n_tokens, ids_crc32."""
    schema = "shard long, doc_id long, start long, n_tokens long, ids_crc32 long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                raw = content.as_buffer().to_pybytes()
                if not raw:
                    continue
                shard = Shard(raw)
                got = [(shard.number, name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for name, start, ids in shard.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(rows, schema)


def token_index(docs: DataFrame, tokenizer: str, vocabulary: int) -> DataFrame:
    """Writes docs as token files and returns, from the files: doc_id, start, n_tokens, ids_crc32.

    start counts all ids before the document. The shards' sums are one row a shard, so their running sum is small.
    """
    spark = docs.sparkSession
    path = common.scratch(spark, "token-files")
    write_token_files(docs, tokenizer, vocabulary, path)
    with common.one_row_batches(spark):
        rows = common.saved(read_token_files(spark, path), "token-index")

    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n")
    return rows.join(F.broadcast(sums), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
