"""The continuous forms: price lists as they arrive, offers as stored state, and windowed change counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from catalogia.sources import store
from catalogia.sources.scratch import saved


def stream_pricelists(spark: SparkSession, folder: str, apply: Callable[[DataFrame, int], None], checkpoint: str, files_a_batch: int = 100):
    """Each arriving file goes once to apply(files, batch_id), which must be idempotent by its run ids. Returns the query (available-now: it ends when all is read)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(folder)
    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feed_into(root: str, describe: Callable[[DataFrame], DataFrame], apply: Callable[[DataFrame, str], None], hold: str | None = None) -> Callable[[DataFrame, int], None]:
    """What stream_pricelists calls with each batch of files: they wait in the store at root, and go to apply in the order of their data's time.

    describe(files): path, content, supplier_id, as_of and run_id of each file. apply(files, turn) gets at most one run of each supplier, the oldest
    that waits, and must be idempotent by the turn's name (as run_import is). A list is applied when another is newer by `hold` (an interval; None:
    at once), so lists that arrive out of order are applied in order; apply_waiting applies the rest. A repeated batch puts no file twice.
    """

    def take(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        store.commit(spark, root, f"arrived-{batch_id}", {}, {"waiting": describe(files).select("path", "supplier_id", "as_of", "run_id", "content")})
        newest = store.load(spark, root, "waiting").agg(F.max("as_of").alias("t"))
        until = newest.select((F.col("t") - F.expr(f"INTERVAL {hold}")) if hold else F.col("t")).first()[0]
        apply_waiting(spark, root, apply, until)

    return take


def apply_waiting(spark: SparkSession, root: str, apply: Callable[[DataFrame, str], None], until=None) -> None:
    """Applies the waiting runs whose data is of `until` at the latest (all, if it is None): each supplier's oldest run first, those of all suppliers at once."""
    version = store.latest(spark, root)
    if "waiting" not in version.tables:
        return
    waiting = store.load(spark, root, "waiting", version)
    if until is not None:
        waiting = waiting.filter(F.col("as_of") <= F.lit(until))
    runs = waiting.groupBy("supplier_id", "run_id").agg(F.min("as_of").alias("as_of"))
    if "applied" in version.tables:
        runs = runs.join(store.load(spark, root, "applied", version), ["supplier_id", "run_id"], "left_anti")
    turns = saved(runs.withColumn("turn", F.row_number().over(Window.partitionBy("supplier_id").orderBy("as_of", "run_id"))), "turns")
    for turn in range(1, (turns.agg(F.max("turn")).first()[0] or 0) + 1):
        now = turns.filter(F.col("turn") == turn).select("supplier_id", "run_id")
        told = now.agg(F.sum(F.xxhash64("supplier_id", "run_id").cast("decimal(38,0)")), F.count("*")).first()
        name = f"turn-{told[0]}-{told[1]}"
        apply(waiting.join(now, ["supplier_id", "run_id"]), name)
        store.commit(spark, root, f"{name}-applied", {}, {"applied": now})


#: What is kept of an offer between batches.
LATEST = "supplier_id string, supplier_sku string, as_of timestamp, price string, currency string, stock_status string, stock_quantity long"
CHANGES = "supplier_id string, supplier_sku string, change_type string, old_value string, new_value string, as_of timestamp"


def offer_changes(latest: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The changes that rows make to the latest state of their offers, and that state after them.

    Rows of an offer count in the order of seq. One whose data is older than that of any before it is dropped. An offer's first row is a new_offer; later
    ones give a row for a price or currency, an availability, or else a quantity that differs from the row before. One exchange by offer, no Python.
    """
    names = [f.name for f in latest.schema]
    both = latest.withColumn("seq", F.lit(None).cast("long")).unionByName(rows.select("seq", *(F.col(c).cast(latest.schema[c].dataType).alias(c) for c in names)))
    order = Window.partitionBy("supplier_id", "supplier_sku").orderBy(F.col("seq").asc_nulls_first())
    newest = F.max("as_of").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = both.withColumn("newest", newest).filter("newest is null or as_of >= newest")
    old = F.lag(F.struct("price", "currency", "stock_status", "stock_quantity")).over(order)
    after = kept.withColumn("old", old).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    o = F.col("old")
    one = lambda kind, was, now: F.struct(F.lit(kind).alias("change_type"), was.cast("string").alias("old_value"), now.cast("string").alias("new_value"))
    same = lambda c: o[c].eqNullSafe(F.col(c))
    nothing = F.lit(None).cast("string")
    told = F.when(o.isNull(), F.array(one("new_offer", nothing, F.col("price")))).otherwise(
        F.array_compact(
            F.array(
                F.when(~(same("price") & same("currency")), one("price", o["price"], F.col("price"))),
                F.when(~same("stock_status"), one("availability", o["stock_status"], F.col("stock_status"))).when(~same("stock_quantity"), one("stock", o["stock_quantity"], F.col("stock_quantity"))),
            )
        )
    )
    changes = after.filter("seq is not null").select("supplier_id", "supplier_sku", F.explode(told).alias("c"), "as_of")
    return changes.select("supplier_id", "supplier_sku", "c.*", "as_of"), after.filter("last").select(*names)


def stream_offer_changes(rows: DataFrame, root: str, checkpoint: str):
    """rows (streaming): supplier_id, supplier_sku, seq, as_of, price, currency, stock_status, stock_quantity; repeated seq of an offer aren't defined.

    Each batch adds its changes to the table offer_changes of the store at root and replaces the parts of latest_offers that it touches; both are committed
    together under the batch's number, so a repeated batch changes nothing. Returns the query (available-now).
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, f"offers-{batch_id}"
        if store.is_committed(spark, root, run):
            return
        batch = saved(batch, "arrived")
        parts = [r[0] for r in batch.select(store.part_of("supplier_sku")).distinct().collect()]  # store.PARTS at most
        changes, after = offer_changes(store.load(spark, root, "latest_offers", parts=parts), batch)
        store.commit(spark, root, run, {"latest_offers": after}, {"offer_changes": changes}, {"latest_offers": "supplier_sku"}, {"latest_offers": batch})

    return rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_offer_store(spark: SparkSession, root: str) -> None:
    """An empty store for stream_offer_changes."""
    store.create(spark, root, {"latest_offers": spark.createDataFrame([], LATEST), "offer_changes": spark.createDataFrame([], CHANGES)}, {"latest_offers": "supplier_sku"})


def stream_change_counts(changes: DataFrame, window: str = "24 hours", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Changes by type in each window of created_at; batch or streaming."""
    w = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    return changes.withWatermark("created_at", late).groupBy(w.alias("w"), "change_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "change_type", "n")
