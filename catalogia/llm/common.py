"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or that which setCheckpointDir was told; a temporary one of our own only with a local master, where nothing else sees it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="spark-own-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = f"file://{path}"
    return _OWN[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: this cuts the lineage, and a lost executor costs no earlier step."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 4000, mb: int = 16) -> None:
    """Bounds what a Python worker gets at once, so that very long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


@contextmanager
def one_row_batches(spark: SparkSession):
    """While it holds, a Python worker gets one row at a time: for rows that are whole files."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold_of(col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def sampled(df: DataFrame, key: str, bound: int, rows: int) -> DataFrame:
    """About bound of df's rows (all, if fewer), chosen by a hash of the key: the same rows however df is partitioned."""
    if rows <= bound:
        return df
    cut = int(bound / rows * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < F.lit(cut))


#: Rows of a few numbers each that may be sent to all tasks.
SMALL_ROWS = 1_000_000


def small_or_not(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has at most SMALL_ROWS rows, else left to a merge join; df has a few numbers a row, and `rows` is its counted length."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df.hint("merge")


def new_name(df: DataFrame, base: str) -> str:
    """base, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base
