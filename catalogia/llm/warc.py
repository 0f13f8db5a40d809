"""WARC archives: written by Spark's text writer, read with boundary-chain verification.

Reading: each task looks for record magic and emits every candidate with the offset its header says the next record has. Magic inside a payload makes
false candidates; pointer jumping from offset 0 (pointers to the next candidate, doubled until nothing new is reached) keeps those that
the chain of true records meets.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalogia.llm import common

CRLF = "\r\n"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: An archive has at most so many records, and about so many bytes of payloads, as far as the mean page tells.
RECORDS_A_FILE, FILE_BYTES = 20_000, 128 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
#: Type of the row for a file's end.
END = "end"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 10 hexadecimal digits are 8 of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def records(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for a response). Of equal payloads of at least `least` bytes, the smallest page_id is the response.

    Null html is an empty payload. Null ids never name a response that has other ids; rows repeated with one id and payload are responses each.
    Only ids and digests are grouped; the payloads move once, to meet their decision.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("digest", base32_sha1(F.col("payload")))
    keys = src.select("page_id", "digest", (F.length("payload") >= least).alias("long"))
    first = keys.filter("long").groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    same = keys.filter("long").join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct()
    return src.join(same, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").drop("p", "d")


def write_archives(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """One record a page, at most RECORDS_A_FILE and about FILE_BYTES a file, each file one gzip stream. Each file is whole records; a revisit has the HTTP header without the payload."""
    r = records(pages, least)
    mean = pages.agg(F.avg(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    most = max(1, min(RECORDS_A_FILE, int(FILE_BYTES / (mean + 500))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.length("payload").cast("string"), F.lit(CRLF * 2))
    again = F.col("refers_to").isNotNull()
    size = F.length(http) + F.when(again, 0).otherwise(F.length("payload"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    url = F.regexp_replace("url", r"[\r\n]+", " ")
    text = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit(CRLF),
        http,
        F.when(again, F.lit("")).otherwise(F.col("payload").cast("string")),
        F.lit(CRLF),
    )
    r.select(text.alias("value")).write.option("lineSep", CRLF).option("maxRecordsPerFile", most).option("compression", "gzip").text(path)


def candidates(content: bytes) -> Iterator[tuple]:
    """(offset, next, type, page, refers_to, payload_bytes, digest) for each place that reads as a record; whether it is one isn't known yet.

    A record starts the file or follows an empty line, so no two headers overlap: however long they are, each byte is looked at once for them.
    """
    for m in MAGIC.finditer(content):
        if m.start() and content[max(0, m.start() - 4) : m.start()] != b"\r\n\r\n":
            continue
        end = content.find(b"\r\n\r\n", m.end() - 2)
        if end < 0:
            continue
        head = {}
        for row in content[m.end() : end].split(b"\r\n"):
            name, _, value = row.partition(b":")
            head[name.strip().lower()] = value.strip()
        try:
            size = int(head[b"content-length"])
        except (KeyError, ValueError):
            continue
        block = end + 4
        after = block + size + 4
        if size < 0 or after > len(content) or content[block + size : after] != b"\r\n\r\n":
            continue
        split = content.find(b"\r\n\r\n", block, block + size)
        if split < 0:
            continue
        kind = head.get(b"warc-type", b"").decode("ascii", "replace")
        page, refers = (re.fullmatch(rb"<urn:page:(-?\d+)>", head.get(k, b"")) for k in (b"warc-record-id", b"warc-refers-to"))
        if kind == "revisit":
            told = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", content[block : split + 2])
            n, digest = int(told[1]) if told else 0, head.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("ascii", "replace")
        else:
            body = content[split + 4 : block + size]
            n, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
        yield m.start(), after, kind, int(page[1]) if page else None, int(refers[1]) if refers else None, n, digest


def reachable(offsets: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Which candidates (offsets ascending) the chain from offset 0 meets: pointers are doubled, so the steps are as the logarithm of the records."""
    n = len(offsets)
    met = np.zeros(n + 1, bool)
    if not n or offsets[0] != 0:
        return met[:n]
    at = np.searchsorted(offsets, nexts)
    jump = np.append(np.where((at < n) & (offsets[np.minimum(at, n - 1)] == nexts), at, n), n)
    met[0] = True
    while True:
        more = met.copy()
        more[jump[met]] = True
        more[n] = False
        jump = jump[jump]
        if (more == met).all() and (jump[:n][met[:n]] == n).all():
            return met[:n]
        met = more


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each true record of the archives: page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to.

    Offsets are those of the unpacked stream. A file is read by one task at a time; what is grouped by file is a short row a candidate.
    A file whose records don't lead to its last byte is an error: nothing behind a bad record is lost without notice.
    """
    names = ["path", "offset", "next", "record_type", "page_id", "refers_to", "payload_bytes", "payload_digest"]
    schema = "path string, offset long, next long, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string"
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                raw = content.as_buffer().to_pybytes()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows = [*((name, *c) for c in candidates(raw)), (name, len(raw), len(raw) + 1, END, None, None, 0, "")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    with common.one_row_batches(spark):
        found = common.saved(spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(find, schema), "warc-candidates")

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        kept = rows[reachable(rows["offset"].to_numpy(), rows["next"].to_numpy())]
        if not len(kept) or kept["record_type"].iloc[-1] != END:
            raise ValueError(f"{rows['path'].iloc[0]}: no record at byte {kept['next'].iloc[-1] if len(kept) else 0}")
        return kept[:-1]

    kept = found.groupBy("path").applyInPandas(chain, schema)
    return kept.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder and returns what is read back."""
    path = common.scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
