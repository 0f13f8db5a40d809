"""Sinks: CSV for spreadsheets, and upserts into Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from catalogia.functions.cells import csv_cell


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(";", *(csv_cell(F.col(c)) for c in df.columns)).alias("value"))


def export_csv(df: DataFrame, path: str) -> None:
    """One file a partition, each with the byte-order mark and the head, lines ended by CR LF. Sort and coalesce df as the reader needs it."""
    names = df.columns
    head = "﻿" + ";".join(f'"{n}"' if any(x in n for x in ';"\n\r') else n for n in names)
    first = F.row_number().over(Window.partitionBy("_p").orderBy("_m")) == 1
    lines = df.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    text = F.concat_ws(";", *(csv_cell(F.col(c)) for c in names))
    out = lines.select("_p", "_m", text.alias("t")).withColumn("value", F.when(first, F.concat(F.lit(head + "\r\n"), F.col("t"))).otherwise(F.col("t")))
    out.sortWithinPartitions("_m").select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def upsert(current: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """current with updates' rows in place of those with their keys; the last of repeated updates isn't defined, so give each key once."""
    return current.join(updates.select(*keys), keys, "left_anti").unionByName(updates.select(*current.columns))


def upsert_table(current: DataFrame, updates: DataFrame, keys: list[str], path: str, by: str) -> DataFrame:
    """Writes only partitions (of column `by`) that have a row whose content differs; others stay as they are. Returns the changed rows."""
    changed = updates.select(*current.columns).exceptAll(current)
    parts = changed.select(by).distinct()
    new = upsert(current.join(parts, by, "left_semi"), updates.join(parts, by, "left_semi"), keys)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return changed
