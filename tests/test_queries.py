"""The queries of files, decisions and upkeep against their SQL on the smallest tables, and what has no query: staging, written upserts."""

import glob
import os

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catalogia.operators import apply, associations, ops, vectors
from catalogia.plans import adapter as A, decisions, details, imports, queries as plans, upkeep
from catalogia.sources import pricelists, scratch, tables

D = "/root/testdata/sf0.001"
NAMES = [n for n, f in plans.QUERIES.items() if f.__module__ in {m.__name__ for m in (decisions, details, imports, upkeep)}]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, sql, name):
    df = plans.QUERIES[name](spark, D)
    r = sql.sql(plans.ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(r.columns) == names
    at = [r.columns.index(c) for c in names]
    got = sorted((tuple(x[c] for c in names) for x in df.collect()), key=repr)
    assert got == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
    assert got


def test_kept_tables_follow_their_sources(spark, tmp_path):
    path, built = str(tmp_path / "t"), []
    build = lambda: built.append(1) or [spark.read.parquet(path)]
    get = lambda **how: scratch.kept(spark, "t", [path], build, **how)[0].count()
    spark.range(3).write.parquet(path)
    assert (get(), get(), len(built)) == (3, 3, 1)
    assert (get(anew=True), len(built)) == (3, 2)
    spark.range(4).write.mode("append").parquet(path)
    assert (get(), get(), len(built)) == (7, 7, 3)


def test_files_of_a_run_number_its_rows_once(spark):
    rows = spark.createDataFrame([("a", n, ["x"], {"x": str(n)}) for n in (2, 3)] + [("b", 2, ["x"], {"x": "4"})], pricelists.ROW)
    runs = spark.createDataFrame([("a", "r", "1", None), ("b", "r", "1", 1000)], "path string, run_id string, supplier_id string, first_row int")
    assert sorted((r.row_number, r["values"]["x"]) for r in pricelists.as_staged(rows, runs).collect()) == [(2, "2"), (3, "3"), (1002, "4")]
    assert sorted(r.row_number for r in pricelists.as_staged(rows, runs.drop("first_row")).collect()) == [2, 2, 3]


def staged(spark, rows):
    return spark.createDataFrame(rows, "run_id string, row_number int, values map<string,string>")


def test_stage_rows_replaces_a_run_and_keeps_others(spark, tmp_path):
    path = str(tmp_path / "staged")
    pricelists.stage_rows(staged(spark, [("a", 2, {"x": "1"}), ("a", 3, {"x": None}), ("b", 2, {})]), path)
    pricelists.stage_rows(staged(spark, [("a", 2, {"x": "9"})]), path)
    got = {(r.run_id, r.row_number, tuple(r["values"].items())) for r in spark.read.parquet(path).collect()}
    assert got == {("a", 2, (("x", "9"),)), ("b", 2, ())}
    with pytest.raises(ValueError, match="run c has 2 rows"):
        pricelists.stage_rows(staged(spark, [("c", 1, {}), ("c", 2, {})]), path, max_rows=1)
    assert spark.read.parquet(path).count() == 2


def test_upsert_table_writes_changed_partitions_only(spark, tmp_path):
    path = str(tmp_path / "table")
    cols = "k long, v string, part string"
    spark.createDataFrame([(1, "a", "x"), (2, None, "x"), (3, "c", "y")], cols).write.partitionBy("part").parquet(path)
    before = set(glob.glob(f"{path}/part=y/*"))
    now = spark.read.schema(cols).parquet(path)
    kept = spark.createDataFrame(now.collect(), cols)
    changed = tables.upsert_table(kept, spark.createDataFrame([(1, "A", "x"), (2, None, "x"), (4, "d", "z")], cols), ["k"], path, "part")
    assert {tuple(r) for r in changed.collect()} == {(1, "A", "x"), (4, "d", "z")}
    assert {tuple(r) for r in spark.read.schema(cols).parquet(path).select("k", "v", "part").collect()} == {(1, "A", "x"), (2, None, "x"), (3, "c", "y"), (4, "d", "z")}
    assert set(glob.glob(f"{path}/part=y/*")) == before


def test_upsert_into_an_empty_table(spark):
    cols = "k long, v string"
    assert tables.upsert(spark.createDataFrame([], cols), spark.createDataFrame([(1, None)], cols), ["k"]).collect() == [(1, None)]


def test_reviews_no_self_pairs_nulls_or_repeats(spark):
    cols = "kind string, product_id string, candidate_product_id string, status string"
    new = spark.createDataFrame([("t", "a", "a", "open"), ("t", "a", "b", "open"), ("t", "b", "a", "open"), ("t", "c", None, "open"), ("u", "a", "b", "open"), ("t", "d", "e", "open")], cols)
    old = spark.createDataFrame([("t", "e", "d", "open"), ("u", "b", "a", "dismissed")], cols)
    got = {(r.kind, *sorted((r.product_id, r.candidate_product_id))) for r in apply.open_reviews(new, old).collect()}
    assert got == {("t", "a", "b"), ("u", "a", "b")}


def test_audit_events_come_once(spark):
    e = spark.createDataFrame([("1", "x", "p", ["p"], None, None, None, None, None)], associations.EVENT)
    undo = spark.createDataFrame([("2", "y", "p", ["p"], None, None, None, "1", None)] * 2 + [("1", "x", "p", ["p"], None, None, None, None, None)], associations.EVENT)
    assert {(r.event_id, r.reverted_by) for r in associations.append_audit(e, undo).collect()} == {("1", "2"), ("2", None)}
    assert associations.append_audit(e.limit(0), e).count() == 1


def test_recheck_takes_the_oldest_of_each_supplier(spark):
    cols = "supplier_id string, url string, status string, checked_at timestamp, fetched_at timestamp"
    s = spark.createDataFrame([("1", f"u{k}", "fetched", None, None) for k in range(4)] + [("2", "u0", "failed", None, None)], cols).withColumn("fetched_at", F.timestamp_seconds(F.substring("url", 2, 1).cast("long") * 3600))
    links = spark.createDataFrame([("o", f"u{k}") for k in range(4)] + [("gone", "u0")], "offer_id string, url string")
    o = spark.createDataFrame([("o", "1", True), ("gone", "1", False)], "offer_id string, supplier_id string, active boolean")
    assert [r.url for r in vectors.images_due_recheck(s, links, o, "1970-01-02", most=2).orderBy("url").collect()] == ["u0", "u1"]


def test_gauges_of_empty_tables_are_zero(spark):
    none = lambda cols: spark.createDataFrame([], cols)
    r = ops.health_gauges(none("stale boolean"), none("status string, created_at timestamp"), none("feed_failures int, feed_enabled boolean, next_run_at timestamp"), none("created_at timestamp"), none("status string"), "2024-01-01").first()
    assert set(r) == {0}


def test_missing_columns_fail_early(spark):
    with pytest.raises(AnalysisException):
        ops.stalled_images(spark.createDataFrame([], "status string"), "2024-01-01")


def test_repeated_and_empty_headers_are_told_apart(spark):
    assert pricelists.dedupe_headers(["Prezzo", " ", "Prezzo", "Prezzo  (2)", "Prezzo"]) == ["Prezzo", "Colonna 2", "Prezzo (2)", "Prezzo (2) (2)", "Prezzo (3)"]
    f = spark.createDataFrame([("a.csv", bytearray(b"Codice;Prezzo;Prezzo\r\nA1;1,50;2,50\r\n"))], "path string, content binary")
    assert [r["values"] for r in pricelists.read_pricelists(f).collect()] == [{"Codice": "A1", "Prezzo": "1,50", "Prezzo (2)": "2,50"}]


def test_parts_are_dealt_over_the_tasks(spark):
    """A file of one split would be one task, whatever is made of its rows."""
    for name in ("c5_c8_mapped_details", "g1_refused_merges"):
        plan = plans.QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [p_partkey" in plan
    assert A.parts(spark, D).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_pictures_and_decisions_make_offers_once(spark):
    """Sources, links, decisions and offers come from one written table; links that carry their offer aren't joined with it."""
    for name, joins in (("k10_images_due_recheck", 1), ("k11_image_replaced_changes", 1), ("g3_detach_offers", 3), ("g3_revert_detach", 7)):
        plan = plans.QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_shipdate" not in plan and plan.count("Join ") <= joins, name
    o = spark.createDataFrame([("1|a", "1", "p", True), ("1|b", "1", "p", False)], "offer_id string, supplier_id string, product_id string, active boolean")
    links = spark.createDataFrame([("1|a", "u"), ("1|b", "v")], "offer_id string, url string")
    carried = links.join(o, "offer_id")
    assert [tuple(r) for r in vectors._of_active_offers(links, o, "supplier_id").collect()] == [tuple(r) for r in vectors._of_active_offers(carried, o, "supplier_id").collect()] == [("1|a", "u", "1")]
