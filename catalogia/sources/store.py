"""Tables that are committed together.

Every run writes its files in folders of its own; then a manifest names, for each table, the folders that make it up from now on. Readers go by the newest
manifest, so they see all tables of a run or none. A run that failed between two tables is repeated from the start and overwrites its own folders; a run that
is in a manifest is not applied again. One run commits at a time.

A table is replaced whole, or in the parts that the run touches (by a hash of a column, in PARTS parts), or appended to.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from catalogia.sources.scratch import shuffles_freed

#: Parts of a table that is replaced in parts.
PARTS = 64
_MANIFEST = "version long, run_id string, tables map<string,struct<schema:string,parts:map<string,string>>>"
_PART = "store_part"


@dataclass
class Version:
    """What the newest manifest says: schema and folders by part of each table."""

    number: int = 0
    tables: dict[str, tuple[str, dict[str, str]]] = field(default_factory=dict)


@dataclass
class Written:
    """A table that a run has written ahead of its commit: the folders by part that will make it up, and those that the run added."""

    schema: str
    parts: dict[str, str]
    own: list[str]


def part_of(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("string")


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{root}/manifests/*")


def create(spark: SparkSession, root: str, tables: dict[str, DataFrame], by: dict[str, str] | None = None) -> None:
    """A new store with these tables. by: the column whose hash makes the parts of tables that later runs replace in parts."""
    _write(spark, root, Version(), "created", tables, {}, by or {}, {})


def latest(spark: SparkSession, root: str) -> Version:
    row = _manifests(spark, root).orderBy(F.desc("version")).first()
    return Version(row.version, {k: (v.schema, dict(v.parts)) for k, v in row.tables.items()})


def is_committed(spark: SparkSession, root: str, run_id: str) -> bool:
    return bool(_manifests(spark, root).filter(F.col("run_id") == run_id).limit(1).count())


def load(spark: SparkSession, root: str, name: str, version: Version | None = None, parts: list[str] | None = None) -> DataFrame:
    """The table as of the newest manifest (or of the version given); only these parts of it, if they are named."""
    schema, there = (version or latest(spark, root)).tables[name]
    return _read(spark, schema, [path for k, path in there.items() if parts is None or k in parts])


def _read(spark: SparkSession, schema: str, paths: list[str]) -> DataFrame:
    kind = StructType.fromJson(json.loads(schema))
    return spark.read.schema(kind).parquet(*sorted(paths)) if paths else spark.createDataFrame([], kind)


def load_all(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    version = latest(spark, root)
    return {name: load(spark, root, name, version) for name in version.tables}


def replace(spark: SparkSession, root: str, before: Version, run_id: str, name: str, df: DataFrame, by: str | None = None, touched: DataFrame | None = None) -> tuple[Written, DataFrame]:
    """Writes df, the whole table as it is after the run, ahead of the commit that makes it seen; and the table as it then is, so that what follows reads what the store keeps."""
    w = _replace(spark, root, before, run_id, name, df, by, touched)
    return w, _read(spark, w.schema, list(w.parts.values()))


def append(spark: SparkSession, root: str, before: Version, run_id: str, name: str, df: DataFrame) -> tuple[Written, DataFrame]:
    """Writes rows that the run adds to a table ahead of its commit; and these rows, read again."""
    w = _append(root, before, run_id, name, df)
    return w, _read(spark, w.schema, w.own)


def commit(
    spark: SparkSession,
    root: str,
    run_id: str,
    replaced: dict[str, DataFrame | Written],
    appended: dict[str, DataFrame | Written] | None = None,
    by: dict[str, str] | None = None,
    touched: dict[str, DataFrame] | None = None,
) -> bool:
    """Writes the run's tables, then the manifest. False if the run is committed already; then nothing is written.

    replaced: whole tables as they are after the run. Of a table in `by` only parts with a key of `touched` (a frame with the column) are written.
    appended: rows that are added to their tables. Tables that replace or append wrote are taken as they are.
    """
    if is_committed(spark, root, run_id):
        return False
    _write(spark, root, latest(spark, root), run_id, replaced, appended or {}, by or {}, touched or {})
    return True


def _put(df: DataFrame, path: str, *by: str) -> None:
    with shuffles_freed(df.sparkSession):
        df.write.mode("overwrite").partitionBy(*by).parquet(path)


def _own(before: Version, run_id: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "-", run_id) + f"-{before.number + 1}"


def _replace(spark: SparkSession, root: str, before: Version, run_id: str, name: str, df: DataFrame, by: str | None, touched: DataFrame | None) -> Written:
    path, schema = f"{root}/{name}/{_own(before, run_id)}", df.schema.json()
    if by is None:
        _put(df, path)
        return Written(schema, {"": path}, [path])
    old = before.tables[name][1] if name in before.tables else {}
    part = part_of(by)
    if touched is not None:  # PARTS rows at most
        wanted = [r[0] for r in touched.select(part.alias("p")).distinct().collect()]
        df = df.filter(part.isin(wanted))
    else:
        wanted = list(old)
    _put(df.withColumn(_PART, part).repartition(_PART), path, _PART)
    made = {r[0]: f"{path}/{_PART}={r[0]}" for r in spark.read.schema(f"{_PART} string").parquet(path).distinct().collect()}
    return Written(schema, {k: v for k, v in old.items() if k not in wanted} | made, list(made.values()))


def _append(root: str, before: Version, run_id: str, name: str, df: DataFrame) -> Written:
    own = _own(before, run_id)
    path = f"{root}/{name}/{own}"
    _put(df, path)
    return Written(df.schema.json(), (before.tables[name][1] if name in before.tables else {}) | {own: path}, [path])


def _write(spark: SparkSession, root: str, before: Version, run_id: str, replaced: dict, appended: dict, by: dict, touched: dict) -> None:
    tables = dict(before.tables)
    for name, df in replaced.items():
        w = df if isinstance(df, Written) else _replace(spark, root, before, run_id, name, df, by.get(name), touched.get(name))
        tables[name] = (w.schema, w.parts)
    for name, df in appended.items():
        w = df if isinstance(df, Written) else _append(root, before, run_id, name, df)
        tables[name] = (w.schema, w.parts)
    number = before.number + 1
    row = [(number, run_id, {k: (s, p) for k, (s, p) in tables.items()})]
    spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/manifests/{number:09d}-{_own(before, run_id)}")
