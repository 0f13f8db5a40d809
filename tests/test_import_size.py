"""What an import of many suppliers writes, sends and computes."""

from pyspark.sql import functions as F

from catalogia.operators import apply, identity
from catalogia.plans import adapter as A, daily
from catalogia.sources import pricelists, store
from catalogia.sources.scratch import saved
from tests.test_import import EAN, daily_state, normalised


def test_a_run_writes_each_table_once(spark, tmp_path):
    """Offers were written as a scratch table and again by the store; changes and removed offers were derived again for each result."""
    root, held = str(tmp_path / "store"), []
    store.create(spark, root, daily_state(spark), apply.IN_PARTS)
    norm, runs = normalised(spark, [f"A;{EAN['A']};Gel;Acme;10;5;Gel;http://i/1"], "r1", 1, "snapshot")

    def keep(df, name):
        held.append((name, df.columns))
        return saved(df, name)

    assert apply.run_import(spark, root, "r1", norm, runs, keep)
    names = [n for n, _ in held]
    assert {"classified", "linked", "removed"} <= {*names} and not {*names} & {*apply.STATE, *apply.ADDED}
    assert "issues" not in dict(held)["linked"]
    assert [(r.offer_id, r.product_id) for r in store.load(spark, root, "offers").collect()] == [("s|A", "g:0" + EAN["A"])]


def test_written_tables_free_their_shuffles(spark):
    """Shuffle files stayed until the driver's memory was collected."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in (blocks.getAllFiles().apply(k).getName() for k in range(blocks.getAllFiles().size())) if f.startswith("shuffle_")}
    before = shuffled()
    dealt = saved(spark.range(1000).repartition(4, "id"), "dealt")
    assert not shuffled() - before
    assert dealt.count() == 1000


def test_arriving_files_hold_many_lists(spark, tmp_path):
    """Each list of each supplier was a file in a folder of its own."""
    d = "/root/testdata/sf0.001"
    daily._arriving(spark, d, str(tmp_path / "in"))
    files = pricelists.files(spark, str(tmp_path / "in" / "*" / "*.txt"))
    lists = [A.price_lists(spark, d, since=s, before=b, rows_a_file=None).select("supplier_id", F.lit(day).cast("timestamp").alias("as_of"), "content") for s, b, day in daily.SPANS]
    want = {(r.supplier_id, r.as_of): bytes(r.content) + b"\n" for part in lists for r in part.collect()}
    got = daily._described(files).collect()
    assert {(r.supplier_id, r.as_of): bytes(r.content) for r in got} == want and len(got) == len({r.path for r in got}) == len(want)
    assert files.count() < len(want) / 2


def test_equal_brands_and_missing_attributes_need_no_folding(spark):
    kind = "b string, a map<string,string>, pb string, pa map<string,string>"
    rows = [("Acme", {}, "Acme", {"size": "5"}), ("ACME srl", {"size": "5"}, "Acme", {"size": "5 "}), ("Acme", {"color": "red"}, "Other", {"color": "blue"}), (None, None, "Acme", None)]
    df = spark.createDataFrame(rows, kind).coalesce(1).select(identity.detect_identity_conflicts(F.col("b"), F.col("a"), F.col("pb"), F.col("pa")).alias("x"))
    assert [[c.field for c in r.x] for r in df.collect()] == [[], [], ["brand", "color"], []]
