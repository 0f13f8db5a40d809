import __spark_entry__ as entry


def test_registry(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 50
    assert entry.entry(spark).columns == ["product_id", "currency", "best_offer", "best_unit", "sold_offer", "comparable_count", "not_comparable_count", "others"]


def test_no_python_in_core_plans(spark):
    d = "/root/testdata/sf0.001"
    for name in ("f5_best_unit_price", "e1_refresh_products", "d8_diff_offers", "h2_title_candidates"):
        plan = entry.queries()[name](spark, d)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
