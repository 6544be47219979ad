import datetime as dt
import math

from pyspark.sql import functions as F

from stockflow.operators import forecast, weekly


def _weekly(spark, n_skus=3, n_weeks=70):
    d0 = dt.date(2024, 1, 7)
    rows = []
    for s in range(n_skus):
        for i in range(n_weeks):
            d = d0 + dt.timedelta(days=7 * i)
            rows.append((f"S{s}", d, float(10 + s + (i % 4)), 1.0 + s, 2.0 + s, s % 2, s, float(i % 3), 2.0, 1.0,
                         0.5, 12.0, 1.0, 13.0, 9.0, 3.0, d.isocalendar()[1], d.month, (d.month - 1) // 3 + 1, 0, 1, 1))
    cols = ("sku_id string, date date, actual_sales double, unit_cost double, list_price double, category_encoded int, "
            "subcategory_encoded int, lag_1 double, lag_7 double, lag_14 double, lag_28 double, rolling_mean double, "
            "rolling_std double, rolling_max double, rolling_min double, day_of_week double, week_number int, "
            "month int, quarter int, holiday_flag int, promo_flag int, weekend_flag int")
    return spark.createDataFrame(rows, cols)


def test_recursive_features_constant_history(spark):
    state = spark.createDataFrame([("A", [5.0] * 28)], "sku_id string, hist array<double>")
    f = forecast.step_features(state, F.lit(dt.date(2026, 1, 11))).first()
    assert (f.lag_1, f.lag_7, f.lag_14, f.lag_28) == (5.0, 5.0, 5.0, 5.0)
    assert f.rolling_mean == 5.0 and f.rolling_std == 0.0 and f.day_of_week == 6 and f.week_number == 2


def test_initial_history_alignment(spark):
    wk = spark.createDataFrame([("A", dt.date(2025, 1, 5), 1.0), ("A", dt.date(2025, 1, 19), 3.0)],
                               "sku_id string, date date, actual_sales double")
    h = forecast.initial_history(wk, F.lit(dt.date(2025, 1, 19))).first().hist
    assert len(h) == 28 and h[0] == 3.0 and h[1] == 0.0 and h[2] == 1.0


def test_train_and_forecast_end_to_end(spark, tmp_dir):
    wk = weekly.with_baseline(_weekly(spark))
    sku_enc = wk.select("sku_id", "unit_cost", "list_price", "category_encoded", "subcategory_encoded").distinct()
    flags = spark.createDataFrame([(dt.date(2025, 5, 18), 1, 0)], "date date, holiday_flag int, promo_flag int")
    last = wk.agg(F.max("date")).first()[0]
    split = weekly.Split(start=F.lit(last - dt.timedelta(days=41)), end=F.lit(last), last_week=F.lit(last))
    p = forecast.ForecastParams(num_trees=5, cv_trees=3, max_depth=4)
    run = forecast.train_and_forecast(wk, sku_enc, flags, split, p, with_cv=True)
    res = run.results
    fut = res.filter(F.col("actual_sales").isNull()).collect()
    assert len(fut) == 3 * 6
    for r in res.filter(F.col("ml_forecast").isNotNull()).collect():
        assert r.lower_bound <= r.ml_forecast <= r.upper_bound and r.lower_bound >= 0
    # band widens with the horizon: width(step k) = 2 z σ √k (when not clipped at 0)
    steps = sorted({r.date for r in fut})
    w = {r.date: r.upper_bound - r.ml_forecast for r in fut if r.sku_id == "S0"}
    assert math.isclose(w[steps[3]] / w[steps[0]], 2.0, rel_tol=1e-6) if w[steps[0]] > 0 else True
    m = run.metrics.first()
    assert m.model == "RandomForestRegressor" and 0 <= m.ml_wape and m.improvement == m.baseline_wape - m.ml_wape
    cv = {r.model: r for r in run.cv_metrics.collect()}
    assert set(cv) == {"random_forest", "seasonal_naive"} and cv["random_forest"].n_rows > 0
    forecast.save_model(run, tmp_dir + "/model", spark)
    loaded = forecast.load_model(tmp_dir + "/model", spark)
    assert "model" in loaded and loaded["feature_cols"] == forecast.FEATURE_COLS


def test_partial_last_week_is_kept_on_request(spark):
    wk = weekly.with_baseline(_weekly(spark))
    sku_enc = wk.select("sku_id", "unit_cost", "list_price", "category_encoded", "subcategory_encoded").distinct()
    flags = spark.createDataFrame([(dt.date(2025, 5, 18), 1, 0)], "date date, holiday_flag int, promo_flag int")
    last = wk.agg(F.max("date")).first()[0]
    end = last - dt.timedelta(days=7)
    split = weekly.Split(start=F.lit(end - dt.timedelta(days=41)), end=F.lit(end), last_week=F.lit(last))
    for keep in (False, True):
        p = forecast.ForecastParams(num_trees=2, max_depth=3, keep_partial_week=keep)
        run = forecast.train_and_forecast(wk, sku_enc, flags, split, p)
        rows = run.results.filter(F.col("date") == F.lit(last)).collect()
        assert len(rows) == 3 * keep and all(r.ml_forecast is not None and r.actual_sales is not None for r in rows)
        assert run.results.count() == run.results.select("sku_id", "date").distinct().count()


def test_grid_partitions_follow_its_cells(spark, monkeypatch):
    from stockflow.operators import features
    sku = spark.createDataFrame([(f"S{i}",) for i in range(40)], "sku_id string")
    sales = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 4, 9),)], "date date")
    least = features.grid_partitions(sku, sales)
    monkeypatch.setattr(features, "CELLS", 100)
    assert least <= 8 and 36 <= features.grid_partitions(sku, sales) <= 44
    assert features.grid_partitions(sku, sales.limit(0)) == least


def test_formula_model_runs_through_the_whole_chain(spark, tmp_dir):
    wk = weekly.with_baseline(_weekly(spark, n_skus=2))
    sku_enc = wk.select("sku_id", "unit_cost", "list_price", "category_encoded", "subcategory_encoded").distinct()
    flags = spark.createDataFrame([(dt.date(2025, 5, 18), 1, 0)], "date date, holiday_flag int, promo_flag int")
    last = wk.agg(F.max("date")).first()[0]
    split = weekly.Split(start=F.lit(last - dt.timedelta(days=41)), end=F.lit(last), last_week=F.lit(last))
    p = forecast.ForecastParams(formula="lag_1 - 1")
    run = forecast.train_and_forecast(wk, sku_enc, flags, split, p, with_cv=True)
    # lag_1 of the weekly table is its own column; in the projection it is the week before.
    back = run.results.filter(F.col("actual_sales").isNotNull() & F.col("ml_forecast").isNotNull()).collect()
    lag = {(r.sku_id, r.date): r.lag_1 for r in wk.collect()}
    assert len(back) == 2 * 6 and all(r.ml_forecast == max(0.0, lag[r.sku_id, r.date] - 1) for r in back)
    actual = {(r.sku_id, r.date): r.actual_sales for r in wk.collect()}
    for r in run.results.filter(F.col("actual_sales").isNull()).collect():
        step = (r.date - last).days // 7
        assert r.ml_forecast == max(0.0, actual[r.sku_id, last] - step)
        assert math.isclose(r.std_error, run.std_error * step ** 0.5, rel_tol=1e-9)
    before = [actual[k] - max(0.0, lag[k] - 1) for k in actual if k[1] < last - dt.timedelta(days=41)]
    mean = sum(before) / len(before)
    assert math.isclose(run.std_error, (sum((x - mean) ** 2 for x in before) / len(before)) ** 0.5, rel_tol=1e-9)
    assert run.metrics.first().model == "Formula"
    assert {r.model for r in run.cv_metrics.collect()} == {"formula", "seasonal_naive"}
    forecast.save_model(run, tmp_dir + "/model", spark)
    again = forecast.load_model(tmp_dir + "/model", spark)["model"].transform(wk)
    assert again.filter(F.col("ml_forecast") != F.greatest(F.col("lag_1") - 1, F.lit(0.0))).count() == 0


def test_rows_are_dealt_anew_for_a_forest_only(spark, monkeypatch):
    wk = weekly.with_baseline(_weekly(spark, n_skus=1, n_weeks=20))
    sku_enc = wk.select("sku_id", "unit_cost", "list_price", "category_encoded", "subcategory_encoded").distinct()
    flags = spark.createDataFrame([(dt.date(2024, 5, 19), 1, 0)], "date date, holiday_flag int, promo_flag int")
    last = wk.agg(F.max("date")).first()[0]
    split = weekly.Split(start=F.lit(last - dt.timedelta(days=41)), end=F.lit(last), last_week=F.lit(last))

    def dealt(weekly_rows):
        raise AssertionError("the weekly table is written a second time")
    monkeypatch.setattr(forecast, "training_table", dealt)
    run = forecast.train_and_forecast(wk, sku_enc, flags, split, forecast.ForecastParams(formula="lag_1"))
    assert run.results.count() == 20 + 6
