"""Best-fit packing of documents into sequences, by hierarchical residual packing.

Each partition packs its own items best-fit, largest first. Bins whose room is at most `slack` are final. Underfull bins become
items themselves: they are dealt into an eighth as many partitions, packed best-fit again, and so on up to one partition.
A task packs about TASK_ITEMS items at once: with more underfull bins than that, a round keeps more partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from catalogia.llm import common
from catalogia.llm.wordpieces import library_encoder

CAPACITY = 2048
END_ID = 0
SLACK = 8
TASK_ITEMS = 250_000
FAN_IN = 8
#: Bytes of items that a task holds at once.
GATHER_BYTES = 32 << 20


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and offset of each item, and each bin's fill. Equal sizes keep their order.

    Open bins lie on a stack for each residual; a bitmap of the residuals in use gives the smallest that suffices.
    """
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, fills = 0, []
    order = np.argsort(-sizes, kind="stable")
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fit = room >> s
        if fit:
            left = s + (fit & -fit).bit_length() - 1
            stack = stacks[left]
            b = stack.pop()
            if not stack:
                room ^= 1 << left
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += s
        left -= s
        if left:
            if not stacks[left]:
                room |= 1 << left
            stacks[left].append(b)
    return where, offset, np.array(fills, np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = TASK_ITEMS, size: int = GATHER_BYTES) -> Iterator[pa.Table]:
    """The rows in tables of about `rows` rows or `size` bytes, whatever a partition holds."""
    got: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            got.append(b)
            if sum(x.num_rows for x in got) >= rows or sum(x.nbytes for x in got) >= size:
                yield pa.Table.from_batches(got)
                got = []
    if got:
        yield pa.Table.from_batches(got)


Batches = Iterator[pa.RecordBatch]


def pack_items(items: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, task_items: int = TASK_ITEMS, make: tuple[Callable[[Batches], Batches], str] | None = None) -> DataFrame:
    """items: any columns and `length`, 1 to capacity. Returns them with sequence_id and offset, gapless from 0.

    make: a function that makes the items of a partition's batches in the same worker, and their schema; the items are written once, with their places.
    An empty table gives an empty one; repeated rows are packed as often as they come; items of one
    length keep their order. A column of items that is called sequence_id or offset is given back under that name with an underscore before it.
    A task packs at most about task_items at once, however large its partition is; rounds go on until one task has met all underfull bins or, where these
    are too many for one task, until a round of fewest tasks merges less than one in a hundred.
    """
    from pyspark import TaskContext

    if make is None:
        for c in ("sequence_id", "offset"):
            if c in (x.lower() for x in items.columns):
                items = items.withColumnRenamed(c, common.new_name(items, f"_{c}"))
    before, fields = (iter, items.schema) if make is None else (make[0], T.StructType.fromDDL(make[1]))
    names = fields.names
    fill = "fill"
    while fill in (x.lower() for x in names):
        fill = "_" + fill
    out_schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", fill))])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for t in _gathered(before(batches), task_items):
            where, offset, fills = best_fit(t.column("length").to_numpy().astype(np.int64), capacity)
            for k, v in (("sequence_id", where + base), ("offset", offset), (fill, fills[where])):
                t = t.append_column(k, pa.array(v, pa.int64()))
            base += len(fills)
            yield from t.to_batches(10_000)

    placed = common.saved(items.mapInArrow(local, out_schema), "packed-local")
    bins = placed.filter(F.col(fill) < capacity - slack).groupBy(F.col("sequence_id").alias("item")).agg(F.first(fill).alias("length"))
    left = common.saved(bins, "packed-underfull")
    steps: list[DataFrame] = []
    count = underfull = left.count()
    parts = max(1, placed.rdd.getNumPartitions())
    while count > 1:
        fewest = -(-count // task_items)
        parts = max(fewest, -(-parts // FAN_IN))
        k = len(steps)
        tag = (k + 1) << 56

        def again(batches: Iterator[pa.RecordBatch], tag: int = tag) -> Iterator[pa.RecordBatch]:
            base = tag + (TaskContext.get().partitionId() << 32)
            for t in _gathered(batches, 4 * task_items):
                t = t.sort_by([("length", "descending"), ("item", "ascending")])
                where, offset, fills = best_fit(t.column("length").to_numpy().astype(np.int64), capacity)
                cols = [t.column("item"), pa.array(where + base), pa.array(offset), pa.array(fills[where])]
                base += len(fills)
                yield from pa.Table.from_arrays(cols, ["item", "merged", "shift", "filled"]).combine_chunks().to_batches(50_000)

        deal = F.pmod(F.xxhash64("item", F.lit(k)), F.lit(parts)).cast("int")
        step = common.saved(left.withColumn("deal", deal).repartitionById(parts, F.col("deal")).select("item", "length").mapInArrow(again, "item long, merged long, shift long, filled long"), f"packed-round-{k}")
        steps.append(step)
        if parts == 1:
            break
        left = common.saved(step.filter(F.col("filled") < capacity - slack).groupBy(F.col("merged").alias("item")).agg(F.first("filled").alias("length")), f"packed-left-{k}")
        last, count = count, left.count()
        if parts == fewest and count > 0.99 * last or len(steps) == 126:
            break
    whole = None
    for step in reversed(steps):  # from an item of the first round to its last bin
        step = step.select("item", "merged", "shift")
        if whole is None:
            whole = step
        else:
            up = whole.select(F.col("item").alias("merged"), F.col("merged").alias("top"), F.col("shift").alias("more"))
            whole = step.join(up, "merged", "left").select("item", F.coalesce("top", "merged").alias("merged"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    if whole is None:
        return placed.select(*names, "sequence_id", "offset")
    whole = whole.select(F.struct("merged", "shift").alias(fill), F.col("item").alias("sequence_id"))
    return placed.drop(fill).join(common.small_or_not(whole, underfull), "sequence_id", "left").select(*names, F.coalesce(F.col(fill)["merged"], "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce(F.col(fill)["shift"], F.lit(0))).alias("offset"))


def piece_maker(tokenizer: str, capacity: int, keep_ids: bool) -> tuple[Callable[[Batches], Batches], str]:
    """What makes pieces of batches of doc_id and text (not null), and their schema."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Batches) -> Batches:
        encoder = library_encoder(tokenizer)
        end = np.uint32(END_ID).tobytes()
        for b in batches:
            rows = []
            for name, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text"))):
                ids += end
                n = len(ids) // 4
                cut = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (x, y) in enumerate(zip(cut, cut[1:])):
                    part = ids[4 * x : 4 * y]
                    rows.append((name, k, x, y - x, zlib.crc32(part), part))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[: len(names)], types)], names)

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of each encoded document (null text: empty; END_ID closes each): doc_id, piece, start, length, ids_crc32, and ids if asked for.

    Only documents of more than capacity tokens are cut; then every piece but the first has capacity tokens. A row of docs gives its pieces by itself, so
    repeated ids and null ids give theirs as often as they come; other columns of docs don't matter. Very long texts are a batch of their own.
    """
    return _texts(docs, id_col, text_col).mapInArrow(*piece_maker(tokenizer, capacity, keep_ids))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (see token_pieces), and its ids if asked for."""
    return pack_items(_texts(docs, "doc_id", "text"), capacity, slack, make=piece_maker(tokenizer, capacity, keep_ids))
