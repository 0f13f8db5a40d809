"""Cell parsing, barcodes, text, stock, prices and schedules by example."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from catalogia.functions import cells, gtin, schedule, stock, text
from catalogia.operators import identity, pricing


def over(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}").coalesce(1)
    return [r.x for r in df.orderBy("i").select(make(F.col("c")).alias("x")).collect()]


@pytest.mark.parametrize(
    "sep,cases",
    [
        (",", {"1.234,56": "1234.5600", "€ 12,5": "12.5000", "12 eur": "12.0000", "1 234,5": "1234.5000", "-3,00": "-3.0000", "12.5": "decimal_separator_mismatch", "0.125": "decimal_separator_mismatch", "1.23,4": "invalid_number", "n.a.": None, None: None, "1,23456": "too_many_decimals", "0,5": "0.5000", "1.234": "1234.0000"}),
        (".", {"1,234.56": "1234.5600", "12,5": "decimal_separator_mismatch", "abc": "invalid_number", "--": None, "$ 5": "5.0000", "9" * 40: "invalid_number", "012": "12.0000", "0,123": "decimal_separator_mismatch"}),
    ],
)
def test_decimal(spark, sep, cases):
    got = over(spark, list(cases), lambda c: cells.parse_decimal(c, sep))
    assert [(str(r.value) if r.value is not None else r.code) for r in got] == [v for v in cases.values()]


def test_numeric_cells_and_small_values(spark):
    got = over(spark, ["1.00005", "0.22", "22"], lambda c: F.struct(cells.parse_decimal(c, ",", F.lit(True)).alias("d"), cells.parse_vat_rate(c, ",", F.lit(True)).alias("v")))
    assert [str(r.d.value) for r in got] == ["1.0001", "0.2200", "22.0000"] and [str(r.v.value) for r in got] == ["100.0100"[:0] + "1.0001", "22.0000", "22.0000"]
    assert [(r.value, r.code) for r in over(spark, ["3", "3,5", "-1", "3000000000", ""], lambda c: cells.parse_non_negative_int(c, ","))] == [(3, None), (None, "not_integer"), (None, "negative"), (None, "out_of_range"), (None, None)]
    assert [(r.value, r.code) for r in over(spark, ["€", "Euro", "usd", "xx", " "], cells.parse_currency)] == [("EUR", None), ("EUR", None), ("USD", None), (None, "invalid_currency"), (None, None)]
    assert [r.code for r in over(spark, ["22%", "0,22", "100", "-1"], lambda c: cells.parse_vat_rate(c, ","))] == [None, "vat_rate_fraction", "invalid_vat_rate", "invalid_vat_rate"]


def test_urls_text_csv(spark):
    urls = over(spark, ["HTTP://A.it", "https://a.it/x y?q", "ftp://a", "https://u:p@a.it/", "a.it", "http://" + "x" * 2050, "-"], cells.parse_http_url)
    assert [(r.value, r.code) for r in urls] == [("http://a.it/", None), ("https://a.it/x%20y?q", None), (None, "invalid_url"), (None, "invalid_url"), (None, "invalid_url"), (None, "url_too_long"), (None, None)]
    assert over(spark, ["http://a|http://b;http://c", "http://a?x=1,2,http://b", None], cells.split_urls) == [["http://a", "http://b", "http://c"], ["http://a?x=1,2", "http://b"], []]
    assert over(spark, ["<p>A &amp; B</p><script>x</script><br>C", "<b> </b>", "x" * 5001], cells.to_plain_text) == ["A & B\nC", None, "x" * 5000 + "…"]
    assert over(spark, ["=1+1", "-12.50", "+a", 'a"b;c', None, "@x"], cells.csv_cell) == ["'=1+1", "-12.50", "'+a", '"a""b;c"', "", "'@x"]


def test_barcodes(spark):
    cases = {
        "4006381333931": ("valid", "04006381333931", None), "0036000291452": ("valid", "00036000291452", None), "036000291452": ("valid", "00036000291452", None), "4006381333932": ("invalid", None, "bad_check_digit"),
        "36000291452": ("invalid", None, "unsupported_length"), "4,00638E+12": ("invalid", None, "scientific_notation"), "abc": ("invalid", None, "not_digits"), "0000000000000": ("invalid", None, "all_zeros"), "400 6381-333931": ("valid", "04006381333931", None),
        "": ("missing", None, None), None: ("missing", None, None), "2000000000008": ("restricted", "02000000000008", None),
    }
    got = over(spark, list(cases), gtin.parse_barcode)
    assert [(r.status, r.gtin14, r.issue) for r in got] == list(cases.values()) and got[8].formatting_removed and got[1].format == "EAN-13"
    assert over(spark, ["04006381333931", "14006381333938"], gtin.display_gtin) == ["4006381333931", "14006381333938"]
    assert over(spark, ["01234505", "01234504", "2123450x"], gtin.expand_upc_e) == ["012000003455", None, None]


def test_text(spark):
    assert over(spark, ["Crème & Brûlée  N°5", "ÀÉÎ ß", None], text.fold_text) == ["creme and brulee n 5", "aei", None]
    assert over(spark, ["LELO Inc.", "We-Vibe", "S.r.l.", "srl"], text.normalize_brand) == ["lelo", "wevibe", "srl"[:0] or "srl", None]
    got = over(spark, ["gel rosa", "gel", "", "xyz"], lambda c: text.trigram_similarity(c, F.lit("Gel  ROSA")))
    assert got[0] == 1.0 and 0.4 < got[1] < 0.5 and got[2] == got[3] == 0.0


def test_stock(spark):
    assert over(spark, [">10", "10+", "<0", "Esaurita", "in arrivo", "ultimi  pezzi", "SÌ", "boh", None], stock.availability_from_text) == ["in_stock", "in_stock", "out_of_stock", "out_of_stock", "on_order", "low_stock", "in_stock", "unknown", "unknown"]
    got = over(spark, ["12", "5,000", "-3", "3000000000", "tanti", None], stock.split_quantity_cell)
    assert [(r.quantity, r.text, r.negative, r.out_of_range) for r in got] == [(12, None, False, False), (5, None, False, False), (None, None, True, False), (None, None, False, True), (None, "tanti", False, False), (None, None, False, False)]
    assert over(spark, ["2-3 gg", "1 settimana", "10", "4000", "x", "2–4 weeks"], stock.parse_lead_time_days) == [3, 7, 10, None, None, 28]


def test_price_evaluation(spark):
    rows = [
        ("a", True, "10", "EUR", "net", None, 3), ("b", True, "12.20", "EUR", "gross", "22", 1), ("c", False, None, None, "gross", None, None), ("d", True, "0", "EUR", "unknown", None, 0), ("e", True, "5", "EUR", "gross", None, 1),
    ]
    df = spark.createDataFrame([(a, b, c and Decimal(c), d, e, f and Decimal(f), g) for a, b, c, d, e, f, g in rows], "offer_id string, active boolean, price decimal(14,4), currency string, vat_treatment string, vat_rate decimal(5,2), units_per_pack int")
    got = {r.offer_id: r for r in pricing.evaluate_price(df).collect()}
    assert str(got["a"].unit_exact) == "3.333333" and str(got["a"].net_unit_price) == "3.3333" and str(got["b"].net_unit_price) == "10.0000" and got["b"].net_derived_from_gross
    assert got["c"].reasons == ["inactive", "missing_price", "missing_currency", "unknown_pack"] and got["d"].reasons == ["zero_price", "unknown_vat", "unknown_pack"] and got["e"].reasons == ["gross_without_rate"]
    pct = over(spark, ["10", "0", "0.01", "3"], lambda c: pricing.price_change_pct(c.cast("decimal(14,4)"), F.lit("12").cast("decimal(14,4)")))
    assert [None if x is None else str(x) for x in pct] == ["20.00", None, "119900.00", "300.00"]


def test_identity(spark):
    df = spark.createDataFrame([("LELO", {"color": "Rosa"}, "Lelo Sweden", {"color": "rosa "}), ("A1", {"size": "M"}, "B2", {"size": "L"}), (None, {"color": ""}, "x", {"color": "blu"})], "b string, a map<string,string>, pb string, pa map<string,string>")
    got = [[(c.code, c.field) for c in r.x] for r in df.select(identity.detect_identity_conflicts(F.col("b"), F.col("a"), F.col("pb"), F.col("pa")).alias("x")).collect()]
    assert got == [[], [("brand_mismatch", "brand"), ("attribute_mismatch", "size")], []]


def test_schedule(spark):
    rows = [("2024-03-31 00:00:00", "02:30"), ("2024-10-26 23:00:00", "02:30"), ("2024-06-01 12:00:00", "10:00")]
    df = spark.createDataFrame(rows, "now string, time string")
    got = [r.x for r in df.select(schedule.next_run(F.lit("daily"), F.col("time"), F.lit("Europe/Rome"), F.lit(1), F.col("now").cast("timestamp")).alias("x")).collect()]
    assert got == [dt.datetime(2024, 3, 31, 1, 30), dt.datetime(2024, 10, 27, 0, 30), dt.datetime(2024, 6, 2, 8, 0)]
