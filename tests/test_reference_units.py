"""The reference's own unit tests, re-expressed on Spark."""

import datetime as dt
import math

from pyspark.sql import functions as F

from stockflow.operators import features, risk


def _mock_sales(spark, units_fn):
    d0 = dt.date(2025, 1, 1)
    rows = [(d0 + dt.timedelta(days=i), "SKU_001", float(units_fn(i)), 100.0 * units_fn(i), 100.0,
             i % 5 == 0, i % 15 == 0) for i in range(40)]
    return spark.createDataFrame(rows, "date date, sku_id string, units_sold double, revenue double, "
                                       "unit_price double, promo_flag boolean, is_holiday boolean")


def _mock_inventory(spark):
    return spark.createDataFrame([(dt.date(2025, 2, 9), "SKU_001", 20.0, 10.0, 14, 15)],
                                 "date date, sku_id string, on_hand_units double, on_order_units double, "
                                 "lead_time_days int, reorder_point int")


def _mock_sku(spark):
    return spark.createDataFrame([("SKU_001", "Kitchenware", "Cookware", 50.0, 100.0, dt.date(2024, 1, 1))],
                                 "sku_id string, category string, subcategory string, unit_cost double, "
                                 "list_price double, launch_date date")


def test_feature_engineering_columns_and_weekend_flag(spark):
    df = features.daily_features(_mock_sales(spark, lambda i: i % 10))
    required = ["lag_1", "lag_7", "lag_14", "lag_28", "rolling_mean_7", "rolling_std_7", "rolling_max_7",
                "rolling_min_7", "day_of_week", "week_number", "month", "quarter", "weekend_flag",
                "holiday_flag", "promo_flag", "promotion_flag", "rolling_mean", "rolling_std", "rolling_max"]
    for c in required:
        assert c in df.columns, c
    rows = df.select("day_of_week", "weekend_flag").distinct().collect()
    for r in rows:
        assert r.weekend_flag == (1 if r.day_of_week in (5, 6) else 0)
    assert {r.day_of_week for r in rows} >= {0, 5, 6}


def test_zero_sales_scores_are_finite(spark):
    sales = _mock_sales(spark, lambda i: 0)
    out = risk.risk_scores(_mock_inventory(spark), _mock_sku(spark), sales,
                           risk.RiskParams(safety_stock_weeks=1.5)).collect()
    assert len(out) == 1
    for c in ("stockout_risk", "overstock_risk"):
        v = out[0][c]
        assert v is not None and math.isfinite(v)
    # zero sales in the window keep a 0.0 rate (the 0.1 default is for absent SKUs only)
    assert out[0].weekly_avg_sales == 0.0
    assert risk.risk_scores(_mock_inventory(spark), _mock_sku(spark), sales).filter(
        F.col("quadrant").isNull()).count() == 0
