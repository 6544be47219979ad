import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_entry_runs_with_stable_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["sku_id", "subcategory", "on_hand_units", "on_order_units", "deficit_units", "sales_at_risk"]
    assert df.count() >= 0


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_selected_queries_run_on_smallest_tables(spark):
    q = E.queries()
    for k in ("clean_sales", "cleaning_audit", "risk_scores", "weekly_demand", "profile_describe", "cv_folds"):
        assert q[k](spark, SF).count() >= 0, k
