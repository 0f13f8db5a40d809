"""Price lists day after day, canonical products, decisions, search, streams."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalogia.operators import apply, associations, canonical, catalog, changes, mapping, normalize, suggest, vectors
from catalogia.sources import pricelists, store, tables
from catalogia.sources.scratch import saved
from catalogia.streaming import streams

OFFERS = "offer_id string, supplier_id string, supplier_sku string, product_id string, link_source string, barcode_raw string, barcode_status string, gtin string, title string, brand string, category_raw string, category_id string, attributes map<string,string>, price decimal(14,4), currency string, vat_treatment string, vat_rate decimal(5,2), units_per_pack int, moq int, stock_quantity int, stock_status string, image_urls array<string>, active boolean, source_as_of timestamp, created_at timestamp, row_hash string, last_import_id string, last_row_number int"
EAN = {"A": "4006381333931", "B": "8710103917250", "C": "5901234123457"}


def day(n):
    return dt.datetime(2024, 1, n)


def empty_state(spark):
    return {
        "offers": spark.createDataFrame([], OFFERS),
        "identifiers": spark.createDataFrame([], "product_id string, value string"),
        "products": spark.createDataFrame([], "product_id string, status string, brand string, attributes map<string,string>"),
        "suppliers": spark.createDataFrame([("s", None, None)], "supplier_id string, last_success_as_of timestamp, last_snapshot_as_of timestamp"),
        "reviews": spark.createDataFrame([], "kind string, product_id string, candidate_product_id string, offer_id string, gtin string, status string"),
    }


def import_list(spark, state, lines, run, n, mode="snapshot", supplier="s"):
    head = "SKU;EAN;Titolo;Marca;Prezzo;Giacenza;Colore;Immagine"
    files = spark.createDataFrame([(run, "\n".join([head, *lines]).encode())], "path string, content binary")
    rows = pricelists.read_pricelists(files)
    heads = rows.limit(1).select(F.col("path").alias("file"), F.posexplode("headers").alias("pos", "header"))
    m = mapping.mapping_of(mapping.guess_mapping(heads))
    dft = F.struct(F.lit("EUR").alias("currency"), F.lit("net").alias("vat_treatment"), F.lit(None).cast("decimal(5,2)").alias("vat_rate"), F.lit(1).alias("units_per_pack"), F.lit(None).cast("string").alias("sales_unit"))
    runs = saved(m.select(F.col("file").alias("path"), F.col("file").alias("run_id"), F.lit(supplier).alias("supplier_id"), F.lit(mode).alias("mode"), F.lit(day(n)).alias("as_of"), F.lit(".").alias("decimal_separator"), "mapping", dft.alias("defaults")), "runs")
    norm = saved(normalize.normalize_rows(pricelists.as_staged(rows, runs), runs), "norm")
    out = apply.apply_import(norm, runs, state, saved)
    return {k: saved(v, k) for k, v in out.items()}


def told(out):
    return sorted(f"{r.offer_id.split('|')[1]}:{r.change_type}" + (f":{r.pct}" if r.pct is not None else "") for r in out["changes"].collect())


def test_three_days(spark):
    one = import_list(spark, empty_state(spark), [f"{s};;T{s};;{p};5;;" for s, p in zip("ABCD", (10, 20, 30, 40))], "r1", 1)
    assert told(one) == [] and one["offers"].count() == 4
    second = ["A;;TA;;12;5;;http://i/1", "B;;TB;;20;0;;", "C;;TC;;30;7;;", "E;;TE;;5;5;;"]
    two = import_list(spark, one, second, "r2", 2)
    assert told(two) == ["A:images", "A:price:20.00", "B:availability", "C:stock", "D:removed", "E:new_offer"]
    assert [r.offer_id for r in two["offers"].filter("not active").collect()] == ["s|D"]
    three = import_list(spark, two, second, "r3", 3)
    c = three["counters"].first()
    assert told(three) == [] and c.offers_unchanged == 4 and c.rows_processed == 4
    old = import_list(spark, three, ["A;;TA;;99;5;;"], "r0", 1, "delta")
    assert old["counters"].first().offers_skipped_outdated == 1 and [r.code for r in old["issues"].filter("code = 'outdated_row'").collect()] == ["outdated_row"]
    few = import_list(spark, three, ["A;;TA;;12;5;;http://i/1"], "r4", 4)
    assert few["guard"].first().snapshot_result == "low_coverage" and few["offers"].filter("active").count() == 4


OWN = "product_id string, status string, merged_into_id string, override_title string, override_brand string, override_category_id string, override_image_id string"


def daily_state(spark):
    """Empty tables of the whole job; two raw categories are known, one of them mapped, and one picture."""
    state = empty_state(spark)
    state["products"] = spark.createDataFrame([], OWN)
    state["suppliers"] = spark.createDataFrame([("s", 10, None, None), ("t", 20, None, None)], "supplier_id string, priority int, last_success_as_of timestamp, last_snapshot_as_of timestamp")
    state["category_mappings"] = spark.createDataFrame([("s", "Gel", "c1"), ("s", "Old", None)], "supplier_id string, category_raw string, category_id string")
    state["image_sources"] = spark.createDataFrame([("s", "http://i/1", "a1", "fetched")], "supplier_id string, url string, asset_id string, status string")
    state["offer_images"] = spark.createDataFrame([], "offer_id string, position int, url string")
    state["canonical"] = canonical.refresh_products(state["products"], state["offers"], state["suppliers"], spark.createDataFrame([], "offer_id string, position int, asset_id string, status string"), state["identifiers"])
    return state


def normalised(spark, lines, run, n, mode="delta", supplier="s"):
    head = "SKU;EAN;Titolo;Marca;Prezzo;Giacenza;Categoria;Immagine"
    files = spark.createDataFrame([(run, "\n".join([head, *lines]).encode())], "path string, content binary")
    rows = pricelists.read_pricelists(files)
    heads = rows.limit(1).select(F.col("path").alias("file"), F.posexplode("headers").alias("pos", "header"))
    dft = F.struct(F.lit("EUR").alias("currency"), F.lit("net").alias("vat_treatment"), F.lit(None).cast("decimal(5,2)").alias("vat_rate"), F.lit(1).alias("units_per_pack"), F.lit(None).cast("string").alias("sales_unit"))
    m = mapping.mapping_of(mapping.guess_mapping(heads))
    runs = saved(m.select(F.col("file").alias("path"), F.col("file").alias("run_id"), F.lit(supplier).alias("supplier_id"), F.lit(mode).alias("mode"), F.lit(day(n)).alias("as_of"), F.lit(".").alias("decimal_separator"), "mapping", dft.alias("defaults")), "runs")
    return saved(normalize.normalize_rows(pricelists.as_staged(rows, runs), runs), "norm"), runs


def tables_of(spark, root):
    """All state tables as comparable rows."""
    return {name: sorted(map(repr, df.select(*sorted(df.columns)).collect())) for name, df in store.load_all(spark, root).items()}


def check_canonical(spark, root):
    """What was refreshed run by run is what a refresh of everything gives."""
    t = store.load_all(spark, root)
    pictures = apply.known_pictures(t["offers"], t["offer_images"], t["image_sources"])
    full = canonical.refresh_products(t["products"], t["offers"], t["suppliers"], pictures, t["identifiers"])
    rows = lambda df: sorted(map(repr, df.select(*sorted(full.columns)).collect()))
    assert rows(t["canonical"]) == rows(full)


def test_daily_job_and_failed_commits(spark, tmp_path, monkeypatch):
    lists = [  # the second and third are applied in one call
        ("r1", 1, "snapshot", "s", [f"A;{EAN['A']};Gel rosa;Acme;10;5;Gel;http://i/1 http://i/2", f"B;{EAN['B']};Crema;Acme;20;5;New;", "C;;Olio;;30;5;Old;http://i/1"]),
        ("r2", 2, "delta", "t", [f"X;{EAN['A']};Gel;Acme;8;1;Gel;http://i/1"]),
        ("r3", 3, "snapshot", "s", [f"A;{EAN['A']};Gel rosa;Acme;10;5;Gel;http://i/1 http://i/2", f"B;{EAN['B']};Crema bio;Acme;21;5;Gel;http://i/2"]),
    ]
    roots = [str(tmp_path / "whole"), str(tmp_path / "broken")]
    for root in roots:
        store.create(spark, root, daily_state(spark), apply.IN_PARTS)
    made = {run: normalised(spark, lines, run, n, mode, supplier) for run, n, mode, supplier, lines in lists}
    for run, (norm, runs) in (("r1", made["r1"]), ("r3", tuple(a.unionByName(b) for a, b in zip(made["r2"], made["r3"])))):
        assert apply.run_import(spark, roots[0], run, norm, runs, saved)
        if run == "r1":
            before, put, written = tables_of(spark, roots[1]), store._put, []

            def failing(df, path, *by):
                written.append(path)
                if len(written) == 6:  # some tables of the commit have their files, others don't
                    raise RuntimeError("lost")
                put(df, path, *by)

            with monkeypatch.context() as m:
                m.setattr(store, "_put", failing)
                with pytest.raises(RuntimeError):
                    apply.run_import(spark, roots[1], run, norm, runs, saved)
            assert tables_of(spark, roots[1]) == before  # nothing of the broken run can be seen
            assert apply.run_import(spark, roots[1], run, norm, runs, saved)
            assert not apply.run_import(spark, roots[1], run, norm, runs, saved)  # once is enough
            assert tables_of(spark, roots[1]) == tables_of(spark, roots[0])
        check_canonical(spark, roots[0])
    t = store.load_all(spark, roots[0])
    offers = {r.offer_id: r for r in t["offers"].collect()}
    assert {k: (r.category_id, r.active) for k, r in offers.items()} == {"s|A": ("c1", True), "s|B": ("c1", True), "s|C": (None, False), "t|X": (None, True)}
    assert {(r.supplier_id, r.category_raw): r.category_id for r in t["category_mappings"].collect()} == {("s", "Gel"): "c1", ("s", "Old"): None, ("s", "New"): None, ("t", "Gel"): None}
    assert {(r.supplier_id, r.url): r.status for r in t["image_sources"].collect()} == {("s", "http://i/1"): "fetched", ("s", "http://i/2"): "pending", ("t", "http://i/1"): "pending"}
    assert sorted((r.offer_id, r.position, r.url[-1]) for r in t["offer_images"].collect()) == [("s|A", 0, "1"), ("s|A", 1, "2"), ("s|B", 0, "2"), ("s|C", 0, "1"), ("t|X", 0, "1")]
    p = {r.title: r for r in t["canonical"].collect()}
    assert p["Gel rosa"].primary_image_id == "a1" and p["Gel rosa"].best_price.offer_id == "t|X" and p["Crema bio"].category_id == "c1" and p["Olio"].offer_count == 0
    assert {r.run_id: r.images_new for r in t["counters"].collect()} == {"r1": 1, "r2": 1, "r3": 0}
    assert sorted((r.run_id, r.change_type) for r in t["changes"].collect()) == [("r3", "images"), ("r3", "price"), ("r3", "removed")]


def test_refresh_of_touched_products_only(spark, shop):
    supp, offers, ids, products, images = shop
    full = saved(canonical.refresh_products(products, offers, supp, images, ids), "full")
    now = offers.withColumn("title", F.when(F.col("offer_id") == "1|a", "Gel nuovo").otherwise(F.col("title"))).filter("offer_id <> '1|d'")
    touched = spark.createDataFrame([("p1",), ("p4",)], "product_id string")
    after, changed = canonical.refresh_touched(full, touched, products, now, supp, images, ids)
    new = {r.product_id: r for r in canonical.refresh_products(products, now, supp, images, ids).collect()}
    old = {r.product_id: r for r in full.collect()}
    assert {r.product_id: r for r in after.collect()} == old | {"p1": new["p1"]} and [r.product_id for r in changed.collect()] == ["p1"]


def test_lists_out_of_order(spark, tmp_path):
    """Lists wait for older ones; each is applied once, by its day. (The query l8 compares the tables that this gives.)"""
    root, order = str(tmp_path / "store"), []
    store.create(spark, root, {"seen": spark.createDataFrame([], "run_id string")})
    (tmp_path / "in").mkdir()

    def describe(files):
        s, n = F.regexp_extract("path", r"list-([a-z])", 1), F.regexp_extract("path", r"-([0-9]+)[.]csv", 1)
        at = F.make_timestamp(F.lit(2024), F.lit(1), n.cast("int"), F.lit(0), F.lit(0), F.lit(0))
        return files.select("path", "content", s.alias("supplier_id"), at.alias("as_of"), F.concat(F.lit("run-"), s, n).alias("run_id"))

    def go(files, turn):
        rows = files.select("supplier_id", "run_id", "content").collect()
        assert len({r.supplier_id for r in rows}) == len(rows) and all(bytes(r.content).decode() == r.run_id for r in rows)
        order.append(sorted(r.run_id for r in rows))

    take = streams.feed_into(root, describe, go, hold="5 days")
    for s, n in (("a", 3), ("a", 1), ("b", 2), ("a", 2)):
        (tmp_path / "in" / f"list-{s}-{n}.csv").write_text(f"run-{s}{n}")
    streams.stream_pricelists(spark, str(tmp_path / "in"), take, str(tmp_path / "marks"), 2).awaitTermination(120)
    assert order == []  # all within five days of the newest: they wait
    (tmp_path / "in" / "list-b-7.csv").write_text("run-b7")
    streams.stream_pricelists(spark, str(tmp_path / "in"), take, str(tmp_path / "marks"), 2).awaitTermination(120)
    assert order == [["run-a1", "run-b2"], ["run-a2"]]
    streams.apply_waiting(spark, root, go)
    assert order[2:] == [["run-a3", "run-b7"]]
    streams.stream_pricelists(spark, str(tmp_path / "in"), take, str(tmp_path / "lost-marks"), 2).awaitTermination(120)
    streams.apply_waiting(spark, root, go)
    assert len(order) == 3  # nothing twice, though all files came again


def test_links_duplicates_and_conflicts(spark):
    out = import_list(spark, empty_state(spark), [f"A;{EAN['A']};T;Acme;1;1;rosso;", "A;;again;;2;;;", f"B;{EAN['A']};T2;ACME Srl;1;1;;", f"C;{EAN['A']};T3;Other;1;1;;", "D;123;T4;;1;1;;", "E;;T5;;x;1;;", "E;;T6;;3;1;;", ";;no sku;;1;;;"], "r1", 1)
    o = {r.supplier_sku: r for r in out["offers"].collect()}
    assert o["A"].product_id == o["B"].product_id == "g:0" + EAN["A"] and o["C"].link_source == "conflict_hold" and o["C"].product_id != o["A"].product_id
    assert o["D"].link_source == "standalone" and o["D"].barcode_status == "invalid" and o["E"].price == 3
    assert [(r.kind, r.candidate_product_id) for r in out["reviews"].collect()] == [("gtin_conflict", o["A"].product_id)]
    c = out["counters"].first()
    assert (c.rows_processed, c.rows_with_sku, c.rows_error, c.offers_created, c.conflicts_opened, c.products_created) == (8, 7, 3, 5, 1, 4)
    codes = sorted(r.code for r in out["issues"].filter("severity = 'error'").collect())
    assert codes == ["duplicate_sku", "invalid_number", "missing_sku"] and out["guard"].first().snapshot_result == "unreadable_keys"


@pytest.fixture(scope="module")
def shop(spark):
    supp = spark.createDataFrame([("1", "One", 10), ("2", "Two", 20)], "supplier_id string, name string, priority int")
    row = lambda s, k, p, title, brand, price, status, active=True, attrs=None, link="gtin": (f"{s}|{k}", s, k, p, link, None, "valid", None, title, brand, "cat", None, attrs or {}, Decimal(price), "EUR", "net", None, 1, None, 1, status, [], active, day(2), day(1), None, None, None)
    offers = spark.createDataFrame([
        row("1", "a", "p1", "Gel rosa", None, "10", "out_of_stock", attrs={"size": "M"}), row("2", "b", "p1", "Rose gel", "Lelo", "12", "in_stock", attrs={"size": "L", "color": "red"}), row("2", "c", "p2", "Crema blu", "Acme", "3", "in_stock", link="standalone"), row("1", "d", "p2", "Crema", "Acme", "4", "low_stock"),
    ], OFFERS)
    ids = spark.createDataFrame([("p1", "04006381333931")], "product_id string, value string")
    none = "string"
    products = spark.createDataFrame([("p1", "active", None, None, None, None, None), ("p2", "active", None, None, "Mine", None, None), ("p3", "active", None, None, None, None, None), ("p4", "merged", "p1", None, None, None, None)], f"product_id string, status string, merged_into_id string, override_title {none}, override_brand string, override_category_id string, override_image_id string")
    images = spark.createDataFrame([("1|a", 1, "x2", "fetched"), ("1|a", 0, "x1", "pending"), ("2|b", 0, "x3", "fetched"), ("2|b", 1, "x2", "fetched")], "offer_id string, position int, asset_id string, status string")
    return supp, offers, ids, products, images


def test_canonical_products(spark, shop):
    supp, offers, ids, products, images = shop
    p = {r.product_id: r for r in canonical.refresh_products(products, offers, supp, images, ids).collect()}
    a = p["p1"]
    assert set(p) == {"p1", "p2", "p3"} and p["p3"].status == "archived" and a.title == "Gel rosa" and a.brand == "Lelo" and a.attributes == {"size": "M", "color": "red"}
    assert a.best_price.offer_id == "2|b" and a.cheaper_sold_out.offer_id == "1|a" and a.primary_image_id == "x2" and a.image_count == 2 and a.has_gtin
    assert (a.offer_count, a.supplier_count, a.available_supplier_count) == (2, 2, 1) and p["p2"].brand == "Mine" and p["p2"].available_supplier_count == 2
    assert a.search_text == "Gel rosa Lelo a cat Rose gel b 04006381333931 4006381333931"
    new = canonical.refresh_products(products, offers, supp, images, ids)
    assert canonical.changed_only(new, new).count() == 0


def test_search(spark, shop):
    supp, offers, ids, products, images = shop
    p = canonical.refresh_products(products, offers, supp, images, ids).cache()
    find = lambda q: [r.product_id for r in catalog.text_search(p, offers, q).orderBy(F.desc("score")).collect()]
    assert find("gel ros") == ["p1"] and find("CREMA") == ["p2"] and find("crena") == [] and find("cremma") == ["p2"] and find("c") == ["p2", "p1"][:len(find("c"))]
    assert [tuple(r) for r in catalog.code_search(p, offers, ids, "4006381333931").collect()] == [("p1", 3, "gtin")] and [r.product_id for r in catalog.code_search(p, offers, ids, "C").collect()] == ["p2"]
    any_way = lambda q: [(r.product_id, r.matched_by) for r in catalog.search(p, offers, ids, q).collect()]
    assert any_way("400-6381 333931") == [("p1", "gtin")] and any_way("400638") == [("p1", "text")] and any_way("999999") == [] and any_way("d") == [("p2", "sku")]
    assert [r.product_id for r in catalog.sort_page(catalog.filter_catalog(p, offers, supplier_id="1", max_price=5), "price").collect()] == ["p2"]


def test_merge_and_split(spark, shop):
    supp, offers, ids, products, images = shop
    d = spark.createDataFrame([("p2", "p1", "same thing indeed", day(3)), ("p3", "p3", "x", day(3)), ("p4", "p1", "x", day(3))], "source_id string, target_id string, reason string, at timestamp")
    out = associations.merge_products(d, products, offers, ids)
    assert {r.product_id for r in out["offers"].collect()} == {"p1"} and {(r.source_id, r.why) for r in out["refused"].collect()} == {("p3", "same_product"), ("p4", "already_merged")}
    assert {r.link_source for r in out["offers"].collect()} == {"gtin", "manual"}
    back = associations.split_merge(out["audit"], out["products"], out["offers"], out["identifiers"], day(4))
    key = lambda df: sorted((r.offer_id, r.product_id, r.link_source) for r in df.collect())
    assert key(back["offers"]) == key(offers) and {r.product_id: r.status for r in back["products"].collect()}["p2"] == "active"
    log = associations.append_audit(spark.createDataFrame([], associations.EVENT), out["audit"])
    log = associations.append_audit(log, back["audit"])
    assert {r.action: r.reverted_by is not None for r in log.collect()} == {"product.merged": True, "product.split": False} and associations.product_history(log, "p2").count() == 2
    det = associations.detach_offers(spark.createDataFrame([("2|b", "r", day(3))], "offer_id string, reason string, at timestamp"), offers)
    assert {r.offer_id: r.product_id for r in det["offers"].collect()}["2|b"] == "d:2|b" and key(associations.revert_detach(det["audit"], det["offers"], day(4))["offers"]) == key(offers)
    ov = associations.set_overrides(spark.createDataFrame([("p1", {"title": "New"}, day(3))], "product_id string, overrides map<string,string>, at timestamp"), products)
    assert {r.product_id: r.override_title for r in ov["products"].collect()}["p1"] == "New"
    assert {r.override_title for r in associations.revert_overrides(ov["audit"], ov["products"], day(4))["products"].collect()} == {None}


def test_suggestions(spark):
    p = spark.createDataFrame([("a", "active", "Gel intimo rosa", "Acme", False), ("b", "active", "Gel intimo rosa 2", "ACME", False), ("c", "active", "Gel intimo rosa", "Other", False), ("d", "active", "Crema", None, False)], "product_id string, status string, title string, brand string, has_gtin boolean").withColumn("search_text", F.col("title"))
    none = spark.createDataFrame([], "a string, b string")
    links = spark.createDataFrame([("a", "x"), ("d", "x")], "product_id string, asset_id string")
    src = suggest.suggestion_sources(p, p)
    got = {(r.product_id, r.candidate_id): r.reasons for r in suggest.suggest_duplicates(src, p, none, links).collect()}
    assert got[("a", "b")] == ["title_similarity", "same_brand"] and ("a", "c") not in got and ("d", "a") not in got  # a picture alone suggests nothing
    also = suggest.suggest_duplicates(src, p, none, links.union(spark.createDataFrame([("b", "x")], links.schema))).filter("product_id = 'a'").collect()
    assert [r.reasons for r in also] == [["title_similarity", "same_brand", "same_image"]]
    assert not suggest.suggest_duplicates(src, p, spark.createDataFrame([("a", "b")], "a string, b string"), links.limit(0)).filter("product_id = 'a'").collect()


def test_long_search_texts_are_no_candidates(spark):
    """The title is compared with the other's search text first; what is long or unlike isn't suggested, however alike the titles are."""
    long = " ".join(f"word{i} code{i}" for i in range(60))
    p = spark.createDataFrame([("a", "Gel rosa", "Gel rosa"), ("b", "Gel rosa", f"Gel rosa {long}"), ("c", "Other", "Gel rosa x"), ("d", "Gel rosa", "Gel rosa 1234"), ("e", None, "Gel rosa")], "product_id string, title string, search_text string").withColumn("status", F.lit("active"))
    got = {(r.product_id, r.candidate_id): r.similarity for r in suggest.title_candidates(p, p).collect()}
    assert set(got) == {("a", "c"), ("a", "d"), ("b", "a"), ("b", "c"), ("b", "d"), ("d", "a"), ("d", "c")} and got["b", "a"] == 1 and got["a", "c"] == 0
    texts = ["a", "gel", "gel rosa", "gel rosa blu", "gel verde rosa", "crema viso", "crema viso 50ml", "olio", "olio olio", "", "ab abc abcd"]
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}
    for least in (0.3, 0.5, 1.0):
        want = {(x, y) for x in texts for y in texts if grams(x) and grams(y) and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= least}
        side = lambda name: spark.createDataFrame([(t,) for t in texts], f"{name} string")
        assert {(r.a, r.b) for r in suggest.similar_texts(side("a"), side("b"), least).collect()} == want


def test_decided_pairs_make_room_for_others(spark):
    p = spark.createDataFrame([(f"p{i:02}", "active", "Gel intimo rosa", None, False) for i in range(12)], "product_id string, status string, title string, brand string, has_gtin boolean").withColumn("search_text", F.col("title"))
    decided = spark.createDataFrame([("p00", f"p{i:02}") for i in range(1, 7)], "a string, b string")
    got = suggest.title_candidates(p, p, decided=decided).groupBy("product_id").agg(F.sort_array(F.collect_list("candidate_id")).alias("c"))
    got = {r.product_id: r.c for r in got.collect()}
    assert got["p00"] == ["p07", "p08", "p09", "p10", "p11"] and got["p01"] == ["p02", "p03", "p04", "p05", "p06"] and got["p11"] == ["p00", "p01", "p02", "p03", "p04"]


def test_copies_of_titles_are_compared_once(spark):
    """Candidates as by comparing all with all; of products that no title tells apart one is compared, and each product takes its own places of its title's list alone."""
    from pyspark.sql import Row

    from catalogia.functions.text import trigrams

    titles = ["Gel rosa", "Gel rosa blu", "Gel verde", "Crema viso", "Crema viso 50", "Olio"]
    rows = [(f"p{i:03}", "active" if i % 11 else "archived", titles[i * i % 6 if i % 3 else i % 6], f"{titles[i * i % 6 if i % 3 else i % 6]} Acme {'x' * (i % 4)} {70000 + i}") for i in range(150)]
    p = spark.createDataFrame(rows, "product_id string, status string, title string, search_text string")
    pairs = {tuple(sorted((f"p{i:03}", f"p{j:03}"))) for i in (1, 2, 6, 7) for j in range(0, 150, 9) if i != j}
    decided = spark.createDataFrame(sorted(pairs), "a string, b string")
    grams = lambda t: {f"  {w} "[i : i + 3] for w in t.lower().split() for i in range(len(w) + 1)}
    like = lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    for kept, d in ((None, set()), (decided, pairs)):
        want = set()
        for a, _, t, _ in rows:
            found = sorted((-like(t, u), b) for b, s, u, x in rows if s == "active" and b != a and like(t, x) >= 0.3 and tuple(sorted((a, b))) not in d)
            want |= {(a, b, -n) for n, b in found[:5]}
        assert {tuple(r) for r in suggest.title_candidates(p, p, decided=kept).collect()} == want
    many = spark.range(2000).select(F.format_string("p%05d", "id").alias("candidate_id"), F.lit("gel rosa").alias("title_key"), F.concat(F.lit("gel rosa "), F.lpad(F.col("id").cast("string"), 5, "0")).alias("b"))
    x = spark.createDataFrame([Row(a="gel rosa")]).withColumn("grams", trigrams(F.col("a"))).withColumn("n", F.size("grams"))
    classes = suggest._classes(x, many, 0.3)
    assert classes.count() == 2000 and classes.select("title_key", "n", "held").distinct().count() <= 5  # the codes' trigrams repeat at times, so n differs


def test_files(spark, tmp_path):
    data = {"a.csv": "Código;Prezzo;Prezzo\r\nx;1,5;\r\n;;\r\ny;2.000,00;3".encode("cp1252"), "b.csv": '﻿sku,name\n1,"a, b"\n'.encode(), "c.csv": "sku\tp\n1\t2.50\n".encode("utf-16"), "d.xlsx": b"PK\x03\x04zz"}
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in data.items()], "path string, content binary")
    d = {r.path: r for r in pricelists.detect_dialect(files).collect()}
    assert [(d[k].encoding, d[k].delimiter, d[k].decimal_separator) for k in ("a.csv", "b.csv", "c.csv")] == [("windows-1252", ";", ","), ("utf-8", ",", "."), ("utf-16-le", "\t", ".")] and d["d.xlsx"].error
    rows = sorted((r.path, r.row_number, tuple(sorted(r["values"].items()))) for r in pricelists.read_pricelists(files).collect())
    assert rows[0] == ("a.csv", 2, (("Código", "x"), ("Prezzo", "1,5"), ("Prezzo (2)", None))) and rows[1][1] == 4 and rows[2][2] == (("name", "a, b"), ("sku", "1"))
    out = str(tmp_path / "x")
    tables.export_csv(spark.createDataFrame([("=a", 1), ("b;c", None)], "t string, n int").coalesce(1), out)
    import glob

    assert open(glob.glob(out + "/part-*")[0], "rb").read().decode() == "﻿t;n\r\n'=a;1\r\n\"b;c\";\r\n"
    cur = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "s string, k string, v int")
    upd = spark.createDataFrame([("1", "a", 5), ("2", "b", 2), ("1", "c", 7)], "s string, k string, v int")
    t = str(tmp_path / "t")
    cur.write.partitionBy("s").parquet(t)
    assert tables.upsert_table(saved(cur, "cur"), upd, ["s", "k"], t, "s").count() == 2
    assert sorted((r.k, r.v) for r in spark.read.parquet(t).collect()) == [("a", 5), ("b", 2), ("c", 7)]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "supplier_id string, supplier_sku string, seq long, as_of timestamp, price string, currency string, stock_status string, stock_quantity long"
    rows = [("s", "A", 1, day(1), "10", "EUR", "in_stock", 5), ("s", "A", 2, day(2), "12", "EUR", "in_stock", 4), ("s", "A", 3, day(1), "99", "EUR", "in_stock", 4), ("s", "B", 4, day(1), "1", "EUR", "in_stock", 1), ("s", "B", 5, day(2), "1", "EUR", "out_of_stock", 0)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(src)
    root = str(tmp_path / "store")
    streams.new_offer_store(spark, root)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(src)
    streams.stream_offer_changes(feed, root, str(tmp_path / "cp")).awaitTermination(120)
    got = lambda: sorted((r.supplier_sku, r.change_type, r.new_value) for r in store.load(spark, root, "offer_changes").collect())
    want = [("A", "new_offer", "10"), ("A", "price", "12"), ("A", "stock", "4"), ("B", "availability", "out_of_stock"), ("B", "new_offer", "1")]
    assert got() == want
    assert sorted((r.supplier_sku, r.as_of, r.price) for r in store.load(spark, root, "latest_offers").collect()) == [("A", day(2), "12"), ("B", day(2), "1")]
    streams.stream_offer_changes(feed, root, str(tmp_path / "cp-lost")).awaitTermination(120)  # the marks are lost and all batches come again
    assert got() == want
    seen = []
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "one.csv").write_text("sku;p\n1;2\n")
    q = streams.stream_pricelists(spark, str(tmp_path / "lists"), lambda df, i: seen.extend(pricelists.read_pricelists(df.select("path", "content")).collect()), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert [r["values"] for r in seen] == [{"sku": "1", "p": "2"}]


def test_history_of_changes_by_day(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [(f"o{i}", "price", day(1 + i % 9) + dt.timedelta(hours=i % 24)) for i in range(90)]
    changes.append_changes(spark.createDataFrame(rows, "offer_id string, change_type string, created_at timestamp"), path)
    few = changes.stored_changes(spark, path, day(9), 36)
    assert "PartitionFilters: [isnotnull(day" in few._jdf.queryExecution().toString() and {r.offer_id for r in few.collect()} == {o for o, _, t in rows if t >= day(9) - dt.timedelta(hours=36)}
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "history").rglob("part-*.parquet")}
    before = files()
    assert changes.purge_stored_changes(spark, path, day(9) + dt.timedelta(hours=12), 5) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert files() == {k: t for k, t in before.items() if k[4:14] >= "2024-01-04"}
    assert {r.offer_id for r in changes.stored_changes(spark, path).collect()} == {o for o, _, t in rows if t >= day(4)}
    assert changes.purge_stored_changes(spark, path, day(9), 5) == []


def test_vectors(spark):
    e = spark.createDataFrame([(f"a{i}", "m", "done" if i < 8 else "failed", [float(i), 1.0, 0.0]) for i in range(9)] + [("z", "m", "done", None)], "asset_id string, model_key string, status string, embedding array<double>")
    q = spark.createDataFrame([("q", [1.0, 1.0, 0.0])], "query_id string, embedding array<double>")
    hits = vectors.nearest_images(q, e, "m", 3)
    assert [r.asset_id for r in hits.orderBy("rank").collect()] == ["a1", "a2", "a3"]
    links = spark.createDataFrame([("a1", "p"), ("a2", "p"), ("a1", "o"), ("a3", "r")], "asset_id string, product_id string")
    got = {r.product_id: (r.asset_id, r.hits, r.shared) for r in vectors.aggregate_by_product(hits, links).collect()}
    assert got == {"p": ("a1", 2, True), "o": ("a1", 1, True), "r": ("a3", 1, False)}
    ev = vectors.barcode_evidence(spark.createDataFrame([("q", ["x", "y"])], "query_id string, codes array<string>"), spark.createDataFrame([("r", "y")], "product_id string, value string"))
    ranked = vectors.classify_candidates(vectors.aggregate_by_product(hits, links), ev, 0.99, 0.5).orderBy("rank").collect()
    assert [(r.product_id, r.level) for r in ranked] == [("r", "confirmed"), ("o", "possible"), ("p", "possible")]
