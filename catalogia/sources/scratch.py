"""Written intermediate tables: they cut long lineages, and a lost executor costs no earlier step."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
_KEPT: dict[tuple, tuple[tuple, list[DataFrame]]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir or setCheckpointDir (in a temporary one only where both are unset and the master is local)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="spark-own-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        base = f"file://{_OWN[app]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written within it frees its shuffle files as soon as it is there; else they stay until the driver's memory is collected, and a job of many tables holds those of all."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written in a folder of its own and read again."""
    path = folder(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version(spark: SparkSession, paths: list[str]) -> tuple:
    """Changes when a file of the paths does: their number, bytes and newest time. Only lists the files."""
    files = spark.read.format("binaryFile").load(paths).select("path", "modificationTime", "length")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.max("modificationTime"), F.sum(F.xxhash64("path").cast("decimal(38,0)"))).first())


def kept(spark: SparkSession, name: str, paths: list[str], build: Callable[[], list[DataFrame]], anew: bool = False) -> list[DataFrame]:
    """build()'s tables, which it has written; they serve every later call of the application until a source file changes, or until one asks for them anew."""
    key, now = (spark.sparkContext.applicationId, name, *paths), version(spark, paths)
    if anew or key not in _KEPT or _KEPT[key][0] != now:
        _KEPT[key] = (now, build())
    return _KEPT[key][1]
