import datetime as dt

from pyspark.sql import functions as F

from stockflow.functions.columns import null_if_na_token, title_case
from stockflow.operators import cleaning


def test_na_tokens_become_null(spark):
    df = spark.createDataFrame([("None",), ("",), ("NA",), ("x",)], "v string")
    got = [r[0] for r in df.select(null_if_na_token("v")).collect()]
    assert got == [None, None, None, "x"]


def test_title_case_matches_python(spark):
    vals = ["women's home-decor", " décor ", "sub 3", "KITCHENWARE"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(title_case("v")).collect()]
    assert got == [v.strip().title() for v in vals]


def test_sku_master_keep_first_abs_and_nan_category(spark):
    raw = spark.createDataFrame(
        [("SKU_1", "home decor ", "a", "2024-01-01", "-5", "10"),
         ("SKU_1", "zzz", "b", "2024-01-01", "7", "9"),
         ("SKU_2", None, "c", "2024-02-01", "abc", "3"),
         (None, "x", "y", "2024-01-01", "1", "1")],
        "sku_id string, category string, subcategory string, launch_date string, unit_cost string, list_price string")
    out = {r.sku_id: r for r in cleaning.clean_sku_master(raw).collect()}
    assert set(out) == {"SKU_1", "SKU_2"}
    assert out["SKU_1"].category == "Home Decor" and out["SKU_1"].unit_cost == 5.0
    assert out["SKU_2"].category == "Nan" and out["SKU_2"].unit_cost is None
    assert out["SKU_1"].launch_date == dt.date(2024, 1, 1)


def _sales_frame(spark, rows):
    return spark.createDataFrame(rows, "date string, sku_id string, units_sold string, revenue string, "
                                       "unit_price string, promo_flag string")


def test_sales_pipeline_counters_and_rules(spark):
    sku = spark.createDataFrame([("A", "Kitchenware", "x", dt.date(2024, 1, 1), 1.0, 2.0)],
                                "sku_id string, category string, subcategory string, launch_date date, "
                                "unit_cost double, list_price double")
    d = "2025-01-0{}"
    rows = [
        (d.format(1), "A", "1", "10", "10", "0"),
        (d.format(1), "A", "1", "10", "10", "0"),      # exact duplicate
        (d.format(2), "A", None, "10", "10", "0"),     # missing units
        (d.format(3), "A", "abc", "10", "10", "0"),    # coercion → dropped, own counter
        (d.format(4), "A", "-1", "10", "10", "0"),     # negative
        (d.format(5), "B", "1", "10", "10", "0"),      # unknown SKU
        (d.format(6), "A", "2", "21.2", "10", "1"),    # |21.2-20| = 1.2 <= 0.2+1 → kept
        (d.format(7), "A", "2", "21.3", "10", "0"),    # 1.3 > 1.2 → corrected to 20
        (d.format(8), "A", "1", "10", "10", "0"),
        (d.format(9), "A", "100", "1000", "10", "0"),  # spike: capped (5 rows > 4)
    ]
    ann = cleaning.annotate_sales(_sales_frame(spark, rows), sku)
    clean = cleaning.finish_sales(ann)
    a = cleaning.cleaning_audit(ann, clean).first()
    assert a.raw_sales_rows == 10 and a.duplicate_sales_removed == 1 and a.missing_sales_removed == 1
    assert a.coercion_removed == 1 and a.negative_values_removed == 1 and a.invalid_skus_removed == 1
    assert a.revenue_consistency_corrected == 1 and a.clean_sales_rows == 5 and a.outliers_capped == 1
    by_date = {r.date.day: r for r in clean.collect()}
    assert by_date[6].revenue == 21.2 and by_date[7].revenue == 20.0
    # units of the 5 rows: 1,2,2,1,100 → q1=1, q3=2, fence=5
    assert by_date[9].units_sold == 5.0 and by_date[9].revenue == 50.0 and by_date[9].outlier_flag


def test_fence_needs_more_than_four_rows_and_is_strict(spark):
    rows = [(f"2025-01-0{i}", "A", str(u), str(10 * u), "10", "0") for i, u in enumerate([1, 1, 1, 50], start=1)]
    sku = spark.createDataFrame([("A",)], "sku_id string")
    out = cleaning.clean_sales(_sales_frame(spark, rows), sku)
    assert out.filter("outlier_flag").count() == 0
    # value equal to the fence is untouched: 1,1,1,1,1 → fence 1
    rows5 = [(f"2025-01-0{i}", "A", "1", "10", "10", "0") for i in range(1, 6)]
    out5 = cleaning.clean_sales(_sales_frame(spark, rows5), sku)
    assert out5.filter("outlier_flag").count() == 0


def test_inventory_fill_and_clip(spark):
    sku = spark.createDataFrame([("A",)], "sku_id string")
    raw = spark.createDataFrame([("2025-01-05", "A", None, "-3", None, "-2"), ("2025-01-05", "Z", "1", "1", "1", "1")],
                                "date string, sku_id string, on_hand_units string, on_order_units string, "
                                "lead_time_days string, reorder_point string")
    r = cleaning.clean_inventory(raw, sku).collect()
    assert len(r) == 1
    assert (r[0].on_hand_units, r[0].on_order_units, r[0].lead_time_days, r[0].reorder_point) == (0.0, 0.0, 14, 0)


def test_sales_text_is_compared_by_value_without_writing_it_again(spark):
    sku = spark.createDataFrame([("A",)], "sku_id string")
    rows = [("2025-01-01", "A", u, "6", "2", p) for u, p in (("3", "1"), ("3.0", "1.0"), (" 03 ", "1"), ("-0", "0"), ("0", "0"), ("0", None),
                                                             ("x", "1"), ("x", "1"), ("y", "1"), ("NaN", "1"), (None, "1"), ("Infinity", "1"))]
    raw = spark.createDataFrame(rows, "date string, sku_id string, units_sold string, revenue string, unit_price string, promo_flag string")
    a = cleaning.annotate_sales(raw, sku)
    assert "as string)" not in a._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.units_sold is None, r.units_sold or 0.0, r.promo_flag, r.n_copies, r.drop_reason or "") for r in a.collect())
    assert got == sorted([(False, 3.0, 1, 3, ""), (False, 0.0, 0, 2, ""), (False, 0.0, 0, 1, ""), (True, 0.0, 1, 2, "coercion"),
                          (True, 0.0, 1, 1, "coercion"), (True, 0.0, 1, 1, "coercion"), (True, 0.0, 1, 1, "missing"),
                          (False, float("inf"), 1, 1, "")])


def test_sales_rows_are_dealt_before_they_are_counted(spark):
    nan = float("nan")
    d = dt.date(2024, 1, 1)
    rows = [(d, "A", 0.0, 1.0, nan, 0), (d, "A", -0.0, 1.0, nan, 0), (d, None, None, 1.0, 2.0, 0), (d, None, None, 1.0, 2.0, 0),
            (d, "A", 3.0, 6.0, 2.0, 1)]
    sales = spark.createDataFrame(rows, "date date, sku_id string, units_sold double, revenue double, unit_price double, promo_flag int")
    a = cleaning.annotate_sales(sales, spark.createDataFrame([("A",)], "sku_id string"))
    assert sorted((r.sku_id or "", r.n_copies, r.drop_reason) for r in a.collect()) == [
        ("", 2, "missing"), ("A", 1, None), ("A", 2, "coercion")]
    # No hash map of a whole file split: the rows cross the exchange as they are.
    plan = a._jdf.queryExecution().sparkPlan().toString().splitlines()
    dealt = next(i for i, x in enumerate(plan) if "REPARTITION_BY_NUM" in x)
    depth = len(plan[dealt]) - len(plan[dealt].lstrip(" :+-"))
    below = []
    for x in plan[dealt + 1:]:
        if len(x) - len(x.lstrip(" :+-")) <= depth:
            break
        below.append(x)
    assert below and not any("Aggregate" in x for x in below) and any("Aggregate" in x for x in plan[:dealt])
