"""Price lists of any size: every file is read by as many tasks as it has splits.

A line's record can only be told when it is known whether the line begins within quotes, and its number only when the records before it are counted. So
there are three looks at the lines: one takes each file's head and whether it is UTF-8, which tells its dialect and headers; one says for each split what it
does to both possible beginnings (outside or within quotes) and how many records end in it for each; prefix sums over the splits of a file then tell how
each split really begins; and the last gives the records their numbers and cells. Records that go over a split's edge are put together from their pieces.

Only lines that hold a quote are looked at one by one; all others are cut by Arrow. Lines end with LF or CR LF. UTF-16 lists are read whole (pricelists).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from catalogia.functions.text import trimmed
from catalogia.sources import pricelists
from catalogia.sources.scratch import saved

#: What is looked at of a file's head: lines, and bytes of them.
HEAD_LINES, HEAD_BYTES = 500, 1 << 18
HEAD = "path string, block long, valid boolean, head binary"
DIALECT = "path string, kind string, encoding string, delimiter string, decimal_separator string, headers array<string>, error string"
BLOCK = "path string, block long, lines long, end_out boolean, end_in boolean, records_out long, records_in long"
RECORD = "path string, row_number long, cells array<string>, block long, line long, piece string"


def fields_of(text: str, delimiter: str, inside: bool = False) -> tuple[list[str], bool]:
    """The fields of a record, and whether its quotes are still open. A quote opens a field only at its start; a doubled one within quotes is one."""
    out, field, at, quoted, start = [], "", 0, inside, not inside
    while True:
        if quoted:
            j = text.find('"', at)
            if j < 0:
                return [*out, field + text[at:]], True
            field += text[at:j]
            doubled = text[j + 1 : j + 2] == '"'
            field += '"' * doubled
            quoted, at = doubled, j + 1 + doubled
        elif start and text[at : at + 1] == '"':
            quoted, start, at = True, False, at + 1
        else:
            j = text.find(delimiter, at)
            if j < 0:
                return [*out, field + text[at:]], False
            out.append(field + text[at:j])
            field, at, start = "", j + 1, True


def records_of(text: str, delimiter: str) -> list[list[str]]:
    """All records of a text."""
    out, held = [], []
    for line in text.split("\n"):
        held.append(line)
        whole = "\n".join(held)
        fields, inside = fields_of(whole.removesuffix("\r"), delimiter)
        if not inside:
            out.append(fields)
            held = []
    if held:  # quotes that are never closed
        out.append(fields_of("\n".join(held), delimiter)[0])
    elif text.endswith("\n") or not text:
        out.pop()
    return out


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, block (where the split begins in its file) and line; a split's lines come in order, one after the other."""
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Rows of one split each, and whether a new split begins with them."""
    last = None
    for b in batches:
        path, block, n = b.column("path"), b.column("block"), b.num_rows
        if not n:
            continue
        turns = pc.or_(pc.not_equal(path.slice(1), path.slice(0, n - 1)), pc.not_equal(block.slice(1), block.slice(0, n - 1)))
        cuts = [0, *(k + 1 for k in pc.indices_nonzero(turns).to_pylist()), n]
        for s, e in zip(cuts, cuts[1:]):
            key = path[s].as_py(), block[s].as_py()
            yield b.slice(s, e - s), key != last
            last = key


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: list | None = None

    def row() -> pa.RecordBatch:
        path, block, valid, head, _ = now
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([valid]), pa.array([head if block == 0 else None], pa.binary())], ["path", "block", "valid", "head"])

    for rows, new in _stretches(batches):
        if new:
            if now:
                yield row()
            now = [rows.column("path")[0].as_py(), rows.column("block")[0].as_py(), True, b"", 0]
        lines = rows.column("line")
        if now[1] == 0 and now[4] < HEAD_LINES and len(now[3]) < HEAD_BYTES:
            some = lines.slice(0, HEAD_LINES - now[4]).to_pylist()
            now[4] += len(some)
            now[3] += b"".join(x + b"\n" for x in some)
        if now[2]:
            try:
                lines.cast(pa.string()).validate(full=True)
            except pa.ArrowInvalid:
                now[2] = False
    if now:
        yield row()


def _dialect(path: str, valid: bool, head: bytes, encoding: str | None, delimiter: str | None, header_row: int | None) -> tuple:
    kind, error = pricelists.file_kind(head)
    if error:
        return path, kind, None, None, None, None, error
    marked = pricelists.decode(head)[1] if head[:3] == b"\xef\xbb\xbf" or head[:2] in (b"\xff\xfe", b"\xfe\xff") else None
    encoding = encoding if encoding and encoding != "auto" else marked or ("utf-8" if valid else "windows-1252")
    text = head.decode(encoding, "replace").removeprefix("﻿")
    delimiter = pricelists.guess_delimiter(text) if not delimiter or delimiter == "auto" else {"\\t": "\t"}.get(delimiter, delimiter)
    records = records_of(text, delimiter)
    at = header_row or 1
    headers = pricelists.dedupe_headers(records[at - 1]) if len(records) >= at else None
    cells = (c for r in records[at : at + 200] for c in r[: len(headers or [])] if c)
    return path, kind, encoding, delimiter, pricelists.guess_decimal_separator(cells), headers, None if headers else "no_header"


def dialects(spark: SparkSession, paths: str | list[str], config: DataFrame | None = None) -> DataFrame:
    """path, kind, encoding, delimiter, decimal_separator, headers and error of each file, by its head (and whether all of it is UTF-8). config: see read_lists."""
    return _dialects(_lines(spark, paths), config)


def _dialects(lines: DataFrame, config: DataFrame | None) -> DataFrame:
    heads = lines.mapInArrow(_heads, HEAD).groupBy("path").agg(F.min("valid").alias("valid"), F.coalesce(F.max("head"), F.lit(b"")).alias("head"))
    if config is None:
        heads = heads.withColumns({"encoding": F.lit(None).cast("string"), "delimiter": F.lit(None).cast("string"), "header_row": F.lit(None).cast("int")})
    else:
        heads = heads.join(config.select("path", "encoding", "delimiter", "header_row"), "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "kind", "encoding", "delimiter", "decimal_separator", "headers", "error"]
        kinds = [pa.string()] * 5 + [pa.list_(pa.string()), pa.string()]
        for b in batches:
            rows = [_dialect(*r) for r in zip(*(b.column(c).to_pylist() for c in ("path", "valid", "head", "encoding", "delimiter", "header_row")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return heads.select("path", "valid", "head", "encoding", "delimiter", "header_row").mapInArrow(run, DIALECT)


def _decoded(lines: pa.Array, encoding: str) -> pa.Array:
    """Lines as texts; those of other encodings than UTF-8 in Python."""
    if encoding == "utf-8":
        return lines.cast(pa.string())
    return pa.array([x.decode(encoding, "replace") for x in lines.to_pylist()], pa.string())


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: its lines, and for a beginning outside and within quotes, how it ends and how many records end in it."""
    now: list | None = None

    def row() -> pa.RecordBatch:
        path, block, n, (a, b), (x, y) = now
        cols = [pa.array([path]), *(pa.array([v], pa.int64()) for v in (block, n)), pa.array([a]), pa.array([b]), *(pa.array([v], pa.int64()) for v in (x, y))]
        return pa.RecordBatch.from_arrays(cols, ["path", "block", "lines", "end_out", "end_in", "records_out", "records_in"])

    for rows, new in _stretches(batches):
        if new:
            if now:
                yield row()
            now = [rows.column("path")[0].as_py(), rows.column("block")[0].as_py(), 0, [False, True], [0, 0]]
        encoding, delimiter = rows.column("encoding")[0].as_py(), rows.column("delimiter")[0].as_py()
        lines = rows.column("line")
        special = pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist()
        done = 0
        for k in special:
            text = lines[k].as_py().decode(encoding, "replace")
            for side in (0, 1):
                now[4][side] += 0 if now[3][side] else k - done
                now[3][side] = fields_of(text.removeprefix("﻿"), delimiter, now[3][side])[1]
                now[4][side] += not now[3][side]
            done = k + 1
        for side in (0, 1):
            now[4][side] += 0 if now[3][side] else len(lines) - done
        now[2] += len(lines)
    if now:
        yield row()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with their numbers and cells (null for empty ones); of records that go over the split's edge, pieces.

    The lines of a batch that are whole records make one batch, and so do its quoted records, however they take turns.
    """
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    names = ["path", "row_number", "cells", "block", "line", "piece"]
    state: dict = {}

    def emit(numbers: list[int] | np.ndarray, cells: pa.Array) -> pa.RecordBatch:
        n, none = len(numbers), pa.nulls(len(numbers), pa.int64())
        flat = cells.flatten()
        cells = pa.ListArray.from_arrays(cells.offsets, pc.if_else(pc.equal(flat, ""), pa.scalar(None, pa.string()), flat))
        return pa.RecordBatch.from_arrays([pa.array([state["path"]] * n, pa.string()), pa.array(numbers, pa.int64()), cells.cast(kinds[2]), none, none, pa.nulls(n, pa.string())], names)

    def pieces() -> Iterator[pa.RecordBatch]:
        held = state.pop("held", [])
        if held:
            n = len(held)
            cols = [[state["path"]] * n, [state["next"]] * n, [None] * n, [state["block"]] * n, [k for k, _ in held], [t for _, t in held]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    for rows, new in _stretches(batches):
        if new:
            yield from pieces()
            first = {c: rows.column(c)[0].as_py() for c in ("path", "block", "inside", "before", "encoding", "delimiter")}
            state = {**first, "next": first["before"] + 1, "at": 0, "held": [], "open": first["inside"], "came": first["inside"]}
        lines, d = _decoded(rows.column("line"), state["encoding"]), state["delimiter"]
        if state["at"] == 0 and state["block"] == 0 and lines[0].as_py().startswith("﻿"):
            lines = pa.concat_arrays([pa.array([lines[0].as_py()[1:]], pa.string()), lines.slice(1)])
        special = pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist()
        numbers, cells, done, first = [], [], 0, state["next"]
        plain, ends = np.zeros(len(lines), bool), np.zeros(len(lines), np.int64)  # lines that are records, and those that end one
        for k in [*special, len(lines)]:
            if k > done:  # lines without quotes
                if state["open"]:
                    state["held"] += [(state["at"] + done + i, t) for i, t in enumerate(lines.slice(done, k - done).to_pylist())]
                else:
                    plain[done:k], ends[done:k] = True, 1
                    state["next"] += k - done
            if k < len(lines):
                text = lines[k].as_py()
                state["held"].append((state["at"] + k, text))
                state["open"] = fields_of(text, d, state["open"])[1]
                if not state["open"]:
                    if state["came"]:
                        yield from pieces()
                        state["held"], state["came"] = [], False
                    else:
                        whole = "\n".join(t for _, t in state["held"])
                        state["held"] = []
                        numbers.append(state["next"])
                        cells.append(fields_of(whole.removesuffix("\r"), d)[0])
                    state["next"] += 1
                    ends[k] = 1
            done = k + 1
        if plain.any():
            texts = pc.replace_substring_regex(lines.filter(pa.array(plain)), r"\r$", "")
            yield emit((first - 1 + np.cumsum(ends))[plain], pc.split_pattern(texts, d))
        if numbers:
            yield emit(numbers, pa.array(cells, kinds[2]))
        state["at"] += len(lines)
    yield from pieces()


def _glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cells = [[c or None for c in fields_of(t.removesuffix("\r"), d)[0]] for t, d in zip(b.column("text").to_pylist(), b.column("delimiter").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("path"), b.column("row_number"), pa.array(cells, pa.list_(pa.string()))], ["path", "row_number", "cells"])


def read_lists(spark: SparkSession, paths: str | list[str], config: DataFrame | None = None) -> DataFrame:
    """path, row_number, headers, values of all lists under paths; empty cells are null, and numbers count all records, but blank ones are left out.

    config: path, encoding, delimiter, header_row (any may be null: found by looking). Files that are no text lists are left out; `dialects` names them.
    A row for each split, a few numbers, goes to every task: 100 TB have under a million. A quote that is never closed makes one record of the rest of its file.
    """
    every = _lines(spark, paths)  # the files are listed once for all looks
    told = saved(_dialects(every, config), "dialects")
    split = told.filter("error is null and encoding not like 'utf-16%'")
    of_file = F.broadcast(split.select("path", "encoding", "delimiter")) if split.count() <= 1_000_000 else split.select("path", "encoding", "delimiter")
    effects = saved(every.join(F.broadcast(of_file), "path").select("path", "block", "line", "encoding", "delimiter").mapInArrow(_effects, BLOCK), "splits")
    # Splits of a file in order: each either keeps the beginning's state, or ends the same way for both; the last of these before a split decides.
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("end_out") == F.col("end_in"), F.struct(F.col("end_out").alias("end"), F.col("turns").alias("turns")))
    turned = effects.withColumn("swaps", (F.col("end_out") & ~F.col("end_in")).cast("int")).withColumn("turns", F.sum("swaps").over(order))
    known = turned.withColumn("f", F.last(fixed, ignorenulls=True).over(before)).withColumn("so_far", F.coalesce(F.sum("swaps").over(before), F.lit(0)))
    odd = (F.col("so_far") - F.coalesce(F.col("f.turns"), F.lit(0))) % 2 == 1
    begins = known.withColumn("inside", F.coalesce(F.col("f.end"), F.lit(False)) != odd)
    counted = begins.withColumn("before", F.coalesce(F.sum(F.when(F.col("inside"), F.col("records_in")).otherwise(F.col("records_out"))).over(before), F.lit(0)))
    where = saved(counted.select("path", "block", "inside", "before").join(of_file, "path"), "split-beginnings")
    lines = every.join(F.broadcast(split.select(F.col("path").alias("p"))), F.col("path") == F.col("p"), "left_semi")
    lines = lines.join(F.broadcast(where), ["path", "block"], "left")
    lost = F.when(F.col("inside").isNull(), F.raise_error(F.lit("the splits of a list changed while it was read"))).otherwise(F.col("inside"))
    rows = lines.select("path", "block", "line", lost.alias("inside"), "before", "encoding", "delimiter").mapInArrow(_numbered, RECORD)
    rows = saved(rows, "records")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "piece"))), lambda x: x["piece"]), "\n").alias("text")
    glued = rows.filter("piece is not null").groupBy("path", "row_number").agg(text).join(of_file, "path").select("path", "row_number", "text", "delimiter")
    whole = rows.filter("piece is null").select("path", "row_number", "cells").unionByName(glued.mapInArrow(_glued, "path string, row_number long, cells array<string>"))
    heads = split.select("path", "headers") if config is None else split.join(config.select("path", F.coalesce("header_row", F.lit(1)).alias("header_row")), "path", "left").select("path", "headers", "header_row")
    both = whole.join(heads, "path").filter(F.col("row_number") > (F.lit(1) if config is None else F.coalesce("header_row", F.lit(1))))
    both = both.filter(trimmed(F.array_join("cells", "")) != "")
    n = F.size("headers")
    padded = F.when(F.size("cells") == n, F.col("cells")).otherwise(F.slice(F.concat("cells", F.array_repeat(F.lit(None).cast("string"), n)), F.lit(1), n))
    out = both.select("path", F.col("row_number").cast("int").alias("row_number"), "headers", F.map_from_arrays("headers", padded).alias("values"))
    wide = [r["path"] for r in told.filter("encoding like 'utf-16%'").select("path").collect()]
    return out.unionByName(pricelists.read_pricelists(pricelists.files(spark, wide), config)) if wide else out
