import datetime as dt

from pyspark.sql import functions as F

from stockflow.functions.columns import week_end
from stockflow.operators import features, metrics, weekly


def test_rolling_and_lags_first_rows(spark):
    d0 = dt.date(2025, 1, 1)
    df = spark.createDataFrame([("A", d0 + dt.timedelta(days=i), float(i + 1)) for i in range(10)],
                               "sku_id string, date date, units_sold double")
    out = features.rolling_features(features.lag_features(df)).orderBy("date").collect()
    assert (out[0].rolling_mean, out[0].rolling_std, out[0].rolling_max, out[0].rolling_min) == (0, 0, 0, 0)
    assert out[1].rolling_std == 0.0 and out[1].rolling_mean == 1.0
    assert out[8].rolling_mean == sum(range(2, 9)) / 7 and out[8].rolling_min == 2.0 and out[8].rolling_max == 8.0
    assert out[0].lag_1 == 0.0 and out[1].lag_1 == 1.0 and out[7].lag_7 == 1.0


def test_dense_grid_fills_gaps(spark):
    sku = spark.createDataFrame([("A",), ("B",)], "sku_id string")
    sales = spark.createDataFrame([(dt.date(2025, 1, 1), "A", 2.0, 2.0, 1.0, 1), (dt.date(2025, 1, 4), "A", 3.0, 3.0, 1.0, 0)],
                                  "date date, sku_id string, units_sold double, revenue double, unit_price double, promo_flag int")
    cal = spark.createDataFrame([(dt.date(2025, 1, 2), 1)], "date date, is_holiday int")
    g = features.daily_grid(sku, sales, cal)
    assert g.count() == 8
    rows = {(r.sku_id, r.date.day): r for r in g.collect()}
    assert rows[("B", 1)].units_sold == 0.0 and rows[("A", 2)].is_holiday == 1 and rows[("A", 3)].units_sold == 0.0


def test_week_end_and_iso_week(spark):
    df = spark.createDataFrame([(dt.date(2025, 12, 29),), (dt.date(2026, 1, 4),), (dt.date(2025, 12, 28),)], "d date")
    r = df.select(week_end("d").alias("we"), F.weekofyear("d").alias("wk")).collect()
    assert r[0].we == dt.date(2026, 1, 4) and r[0].wk == 1
    assert r[1].we == dt.date(2026, 1, 4)
    assert r[2].we == dt.date(2025, 12, 28)


def test_cv_fold_bounds_for_98_weeks(spark):
    d0 = dt.date(2024, 1, 7)
    wk = spark.createDataFrame([(d0 + dt.timedelta(days=7 * i),) for i in range(98)], "date date")
    f = weekly.cv_folds(wk).collect()
    firsts = sorted({r.val_fold: r.week_rank for r in sorted(f, key=lambda r: -r.week_rank)
                     if r.val_fold is not None}.items())
    assert [rank for _, rank in firsts] == [18, 34, 50, 66, 82]
    assert all(r.fold_size == 16 for r in f)


def test_metrics_zero_actuals_and_empty(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 3.0)], "actual_sales double, forecast double")
    m = metrics.forecast_metrics(df).first()
    assert m.wape == 0.0 and m.bias == 0.0 and m.mae == 2.0
    e = metrics.forecast_metrics(df.limit(0)).first()
    assert e.wape is None and e.mae is None


def test_seasonal_naive_is_exact_lookup(spark):
    d0 = dt.date(2024, 1, 7)
    rows = [("A", d0 + dt.timedelta(days=7 * i), float(i)) for i in range(60) if i != 5]
    wk = spark.createDataFrame(rows, "sku_id string, date date, actual_sales double")
    out = {r.date: r.baseline_forecast for r in weekly.with_baseline(wk).collect()}
    assert out[d0 + dt.timedelta(days=7 * 52)] == 0.0
    assert out[d0 + dt.timedelta(days=7 * 57)] == 0.0          # week 5 is missing → 0
    assert out[d0 + dt.timedelta(days=7 * 58)] == 6.0


def test_grid_rows_are_not_exchanged_whatever_the_session_says(spark):
    sku = spark.createDataFrame([("A",), ("B",), ("C",), ("A",), (None,)], "sku_id string")
    cal = spark.createDataFrame([(dt.date(2024, 1, 2), 1)], "date date, is_holiday int")
    sales = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "A", 2.0, 4.0, 2.0, 0), (dt.date(2024, 1, 1), "A", 3.0, 9.0, 3.0, 1),
         (dt.date(2024, 1, 3), "A", 1.0, 1.0, 1.0, 0), (dt.date(2024, 1, 4), "B", 7.0, None, 1.0, 1),
         (dt.date(2024, 1, 2), "X", 5.0, 5.0, 1.0, 0), (None, "A", 9.0, 9.0, 1.0, 0),
         (dt.date(2024, 1, 2), None, 9.0, 9.0, 1.0, 0), (dt.date(2024, 1, 5), "X", 5.0, 5.0, 1.0, 0)],
        "date date, sku_id string, units_sold double, revenue double, unit_price double, promo_flag int")
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        g = features.lag_features(features.daily_grid(sku, sales, cal))
        plan = g._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert "hashpartitioning" not in plan.split("Generate")[0] and "hashpartitioning" in plan
        rows = {(r.sku_id, r.date.day): (r.units_sold, r.revenue, r.unit_price, r.promo_flag, r.is_holiday) for r in g.collect()}
    finally:
        spark.conf.set(key, was)
    days = [1, 2, 3, 4, 5]
    want = {(s, d): (0.0, 0.0, 0.0, 0, int(d == 2)) for s in ("A", "B", "C", None) for d in days}
    want |= {("A", 1): (5.0, 13.0, 2.5, 1, 0), ("A", 3): (1.0, 1.0, 1.0, 0, 0), ("B", 4): (7.0, 0.0, 1.0, 1, 0)}
    assert rows == want and g.count() == 20
    assert features.daily_grid(sku, sales.limit(0), cal).count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rolling_stats_come_from_offsets_of_one_window(spark):
    d0 = dt.date(2025, 1, 1)
    values = [4.0, None, 0.0, -2.5, 7.0, 7.0, 1.0, None, 3.0, 40.0, None, None, None, None, None, None, None, None, 5.0]
    rows = [(s, d0 + dt.timedelta(days=i), v, 0, 0) for s in ("A", "B") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "sku_id string, date date, units_sold double, promo_flag int, is_holiday int")
    out = features.daily_features(df)
    assert "RowFrame, -7, -1)" not in _plan(out)   # no frame that is aggregated anew for every row
    assert _plan(out).count("Window [") == 1
    for r in out.collect():
        i = (r.date - d0).days
        past = [v for v in values[max(0, i - 7):i] if v is not None]
        mean = sum(past) / len(past) if past else 0.0
        std = (sum((v - mean) ** 2 for v in past) / (len(past) - 1)) ** 0.5 if len(past) > 1 else 0.0
        assert abs(r.rolling_mean - mean) < 1e-12 and abs(r.rolling_std_7 - std) < 1e-9
        assert (r.rolling_max_7, r.rolling_min) == (max(past, default=0.0), min(past, default=0.0))
        assert [r.lag_1, r.lag_7, r.lag_14, r.lag_28] == [(values[i - k] if i >= k else None) or 0.0 for k in (1, 7, 14, 28)]
