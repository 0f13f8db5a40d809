"""The change report: what a new price list changed for each known offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from catalogia.functions.cells import csv_cell
from catalogia.operators.pricing import price_change_pct

CHANGE = "struct<change_type: string, old_value: string, new_value: string, pct: decimal(9,2)>"
#: Most rows of an export.
EXPORT_ROWS = 50_000


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def diff_offers(before: Column, after: Column, compare_images: Column) -> Column:
    """array of changes between two structs of price, currency, vat_treatment, vat_rate, units_per_pack, stock_quantity, stock_status, image_urls, gtin."""
    same = lambda f: before[f].eqNullSafe(after[f])
    rate = (before["vat_treatment"] != "gross") | same("vat_rate")
    terms = same("currency") & same("vat_treatment") & rate & same("units_per_pack")

    def price(s: Column) -> Column:
        plain = dict(price=s["price"].cast("string"), currency=s["currency"], vat=s["vat_treatment"], units_per_pack=s["units_per_pack"])
        return F.when(s["vat_treatment"] == "gross", _json(**plain, vat_rate=s["vat_rate"].cast("string"))).otherwise(_json(**plain))

    one = lambda kind, old, new, pct=None: F.struct(F.lit(kind).alias("change_type"), old.alias("old_value"), new.alias("new_value"), (F.lit(None) if pct is None else pct).cast("decimal(9,2)").alias("pct"))
    old_urls, new_urls = (F.coalesce(s["image_urls"], F.array().cast("array<string>")) for s in (before, after))
    added, removed = F.array_except(new_urls, old_urls), F.array_except(old_urls, new_urls)
    status_same = same("stock_status")
    return F.array_compact(
        F.array(
            F.when(~(same("price") & terms), one("price", price(before), price(after), F.when(terms, price_change_pct(before["price"], after["price"])))),
            F.when(
                ~status_same,
                one("availability", _json(status=before["stock_status"], quantity=before["stock_quantity"]), _json(status=after["stock_status"], quantity=after["stock_quantity"])),
            ).when(~same("stock_quantity"), one("stock", _json(quantity=before["stock_quantity"]), _json(quantity=after["stock_quantity"]))),
            F.when(compare_images & ((F.size(added) > 0) | (F.size(removed) > 0)), one("images", _json(count=F.size(old_urls), removed=removed), _json(count=F.size(new_urls), added=added))),
            F.when(~same("gtin"), one("barcode", _json(gtin=before["gtin"]), _json(gtin=after["gtin"]))),
        )
    )


def filter_changes(changes: DataFrame, run_id: str | None = None, as_of=None, hours: int | None = None, supplier_id: str | None = None, types: list[str] | None = None, min_pct: float | None = None, product_id: str | None = None) -> DataFrame:
    """By run, or since so many hours before as_of; the least percentage binds price rows only."""
    out = changes
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    elif hours is not None:
        out = out.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours)))
    if supplier_id is not None:
        out = out.filter(F.col("supplier_id") == supplier_id)
    if product_id is not None:
        out = out.filter(F.col("product_id") == product_id)
    if types:
        out = out.filter(F.col("change_type").isin(types))
    if min_pct is not None:
        out = out.filter((F.col("change_type") != "price") | (F.abs("pct") >= min_pct))
    return out


def describe_change(kind: Column, old: Column, new: Column) -> tuple[Column, Column]:
    """Before and after as plain text."""
    get = F.get_json_object

    def text(v: Column) -> Column:
        price = F.concat_ws(" ", get(v, "$.price"), get(v, "$.currency"), F.concat(F.lit("x"), get(v, "$.units_per_pack")))
        status = F.concat_ws(" ", get(v, "$.status"), F.concat(F.lit("("), get(v, "$.quantity"), F.lit(")")))
        return (
            F.when(v.isNull(), F.lit(""))
            .when(kind == "price", price)
            .when(kind == "availability", status)
            .when(kind == "stock", F.coalesce(get(v, "$.quantity"), F.lit("?")))
            .when(kind.isin("images", "image_replaced"), F.concat(get(v, "$.count"), F.lit(" images")))
            .when(kind == "barcode", F.coalesce(get(v, "$.gtin"), F.lit("-")))
            .otherwise(F.concat_ws(" ", get(v, "$.price"), get(v, "$.currency"), get(v, "$.stock_status")))
        )

    return text(old), text(new)


def list_changes(changes: DataFrame, suppliers: DataFrame, offers: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, newest first (ties by offer and type), with the supplier's name and the offer's present product and title. Changes without an offer are on no page."""
    o = offers.select("offer_id", F.col("product_id").alias("current_product_id"), "title", "supplier_sku")
    page = changes.join(o, "offer_id").orderBy(F.desc("created_at"), "offer_id", "change_type").offset(offset).limit(limit)
    return page.join(suppliers.select("supplier_id", F.col("name").alias("supplier_name")), "supplier_id", "left")


def count_changes_by_type(changes: DataFrame, offers: DataFrame) -> DataFrame:
    return changes.join(offers.select("offer_id"), "offer_id", "left_semi").groupBy("change_type").agg(F.count("*").alias("n"))


CSV_COLUMNS = ["created_at", "supplier_name", "supplier_sku", "title", "change_type", "before", "after", "pct", "current_product_id", "run_id"]


def changes_as_csv(changes: DataFrame, suppliers: DataFrame, offers: DataFrame) -> DataFrame:
    """The export's lines without its head: 10 columns, at most EXPORT_ROWS rows, the newest first."""
    page = list_changes(changes, suppliers, offers, EXPORT_ROWS)
    before, after = describe_change(F.col("change_type"), F.col("old_value"), F.col("new_value"))
    page = page.withColumn("before", before).withColumn("after", after)
    return page.orderBy(F.desc("created_at"), "offer_id", "change_type").select(F.concat_ws(";", *(csv_cell(F.col(c)) for c in CSV_COLUMNS)).alias("value"))


def purge_changes(changes: DataFrame, as_of, days: int = 365) -> DataFrame:
    return changes.filter(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days)))


#: The partition of stored changes.
DAY = "day"


def append_changes(changes: DataFrame, path: str) -> None:
    """Adds changes to the history at path, which is kept by day."""
    changes.withColumn(DAY, F.to_date("created_at")).repartition(DAY).write.mode("append").partitionBy(DAY).parquet(path)


def stored_changes(spark: SparkSession, path: str, as_of=None, hours: int | None = None) -> DataFrame:
    """The history, or that of so many hours before as_of: only the folders of these days are read."""
    out = spark.read.parquet(path)
    if hours is not None:
        since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
        out = out.filter((F.col(DAY) >= F.to_date(since)) & (F.col("created_at") >= since))
    return out.drop(DAY)


def purge_stored_changes(spark: SparkSession, path: str, as_of, days: int = 365) -> list[str]:
    """Deletes the folders of days before as_of less so many days; no file is read or written. Returns these days."""
    first = spark.range(1).select(F.to_date(F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))).cast("string")).first()[0]
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(name for f in files.listStatus(at) if (name := f.getPath().getName()).startswith(f"{DAY}=") and name.removeprefix(f"{DAY}=") < first)
    for name in old:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(at, name), True)
    return [name.removeprefix(f"{DAY}=") for name in old]
