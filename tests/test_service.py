"""What the batch jobs hand over: model bundles, the checked forecast load, reports."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from stockflow.operators import cleaning, forecast, risk, weekly
from stockflow.plans import jobs
from stockflow.sources import files
from stockflow.sources.adapters import raw_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("service"))
    jobs.run_cleaning_job(spark, raw_tables(spark, SF), out)
    jobs.run_forecast_job(spark, out, out, forecast.ForecastParams(num_trees=2, cv_trees=2, max_depth=3, z=2.0), with_cv=False)
    return out


def copy_of(done, tmp_dir):
    import shutil
    return shutil.copytree(done, f"{tmp_dir}/copy")


def test_load_forecast_gives_all_parts(spark, done):
    f = jobs.load_forecast(spark, done)
    assert f.results.count() > 0 and f.bad_records == 0 and f.metrics.first().model == "RandomForestRegressor"
    assert f.run_log.first().pipeline_status == "SUCCESS" and f.model["version"] == 1
    assert set(f.model["encoders"]) == {"category", "subcategory"}
    wide = f.results.filter("ml_forecast is not null and std_error > 0").agg(F.max(F.abs((F.col("upper_bound") - F.col("ml_forecast")) / 2.0 - F.col("std_error"))))
    assert wide.first()[0] < 1e-9                                         # z = 2 of this run, not 1.28


def test_every_missing_artefact_is_named_at_once(spark, tmp_dir):
    with pytest.raises(FileNotFoundError) as e:
        jobs.load_forecast(spark, tmp_dir)
    assert all(x in str(e.value) for x in ("forecast results", "forecast metrics", "run log", "forecast model"))


@pytest.mark.parametrize("what", ["cut results", "metrics", "run log", "model", "two"])
def test_cut_or_malformed_artefacts_are_named(spark, done, tmp_dir, what):
    out = copy_of(done, tmp_dir)

    def overwrite(path, text):
        for name in os.listdir(path):
            if name.endswith(".json"):
                with open(f"{path}/{name}", "w") as f:
                    f.write(text)
                if os.path.exists(f"{path}/.{name}.crc"):
                    os.remove(f"{path}/.{name}.crc")

    expected = []
    if what == "cut results":
        os.remove(f"{out}/forecast_results/_SUCCESS")
        expected = ["forecast results"]
    if what in ("metrics", "two"):
        overwrite(f"{out}/logs/forecast_metrics", '{"model": "m", "baseline_wape": 0.2')
        expected += ["forecast metrics"]
    if what in ("run log", "two"):
        overwrite(f"{out}/logs/pipeline_run_log", json.dumps({"raw_sales_rows": 3}))
        expected += ["run log"]
    if what == "model":
        os.remove(f"{out}/models/forecast_model/v1/_MANIFEST/_SUCCESS")
        expected = ["forecast model"]
    with pytest.raises(files.ContractError) as e:
        jobs.load_forecast(spark, out)
    assert all(x in str(e.value) for x in expected) and str(e.value).count(";") == len(expected) - 1


def test_bad_records_of_a_forecast_csv_are_set_apart(spark, done, tmp_dir):
    out = copy_of(done, tmp_dir)
    with open(f"{out}/results.csv", "w") as f:
        f.write("date,sku_id,actual_sales,baseline_forecast,ml_forecast,ml_upper_bound,ml_lower_bound,note\n"
                "2025-01-05,A,1,2.5,3,4,2,x\n2025-01-12,A,,2.5,3,4,2,\nsoon,A,1,2,3,4,2,y\n2025-01-19,A,many,2,3,4,2,z\n2025-01-26,B\n")
    f = jobs.load_forecast(spark, out, results="results.csv")
    assert [(r.sku_id, r.actual_sales, r.note) for r in f.results.orderBy("date").collect()][:2] == [("A", 1.0, "x"), ("A", None, None)]
    bad = spark.read.parquet(f"{out}/bad_records").collect()
    assert f.bad_records == len(bad) >= 2 and all(r.file.endswith("results.csv") for r in bad)
    assert {r.record.split(",")[0] for r in bad} >= {"soon", "2025-01-19"}
    with open(f"{out}/short.csv", "w") as f:
        f.write("date,sku_id\n2025-01-05,A\n")
    with pytest.raises(files.ContractError, match="ml_forecast"):
        jobs.load_forecast(spark, out, results="short.csv")


def test_reports_hold_forecast_risk_and_accuracies(spark, done, tmp_dir):
    f = jobs.load_forecast(spark, done)
    paths = jobs.run_reports_job(spark, done, tmp_dir, forecasts=f)
    read = lambda name: spark.read.option("header", True).csv(paths[name])
    assert read("forecast").count() == f.results.count() and read("risk").count() > 0
    m, k = f.metrics.first(), read("executive_kpis").first()
    assert float(k.forecast_accuracy) == pytest.approx(1 - m.ml_wape) and float(k.baseline_accuracy) == pytest.approx(1 - m.baseline_wape)
    health = {(r.section, r.measure): float(r.value) for r in read("pipeline_health").collect()}
    assert health["forecast", "wape_change"] == pytest.approx(m.ml_wape - m.baseline_wape)
    assert health["cleaning", "raw_sales_rows"] == f.run_log.first().raw_sales_rows


def test_a_killed_save_is_not_seen_and_versions_count_up(spark, done, tmp_dir):
    path = f"{copy_of(done, tmp_dir)}/models/forecast_model"
    run = forecast.ForecastRun(forecast.load_model(path, spark)["model"], 1.5, None, None, None)

    def killed(self, *a, **b):
        raise KeyboardInterrupt

    codes = spark.createDataFrame([("x", 0)], "category string, category_encoded int")
    create = type(spark).createDataFrame
    try:
        type(spark).createDataFrame = killed                              # the manifest is the last thing written
        with pytest.raises(KeyboardInterrupt):
            forecast.save_model(run, path, spark, {"category": codes})
    finally:
        type(spark).createDataFrame = create
    assert os.path.isdir(f"{path}/v2/model") and forecast.load_model(path, spark)["version"] == 1
    assert forecast.save_model(run, path, spark) == 3
    assert forecast.load_model(path, spark)["std_error"] == 1.5 and forecast.load_model(path, spark, 1)["version"] == 1
    with pytest.raises(ValueError):
        forecast.load_model(path, spark, 2)


def test_a_new_category_leaves_the_codes_of_a_saved_model(spark, done):
    model = forecast.load_model(f"{done}/models/forecast_model", spark)
    codes = {r.category: r.category_encoded for r in model["encoders"]["category"].collect()}
    sku = spark.createDataFrame([(c,) for c in [*codes, "Aaa new", None]], "category string")
    out = {r.category: r.category_encoded for r in forecast.encode_as_trained(sku, {"category": model["encoders"]["category"]}).collect()}
    assert {c: out[c] for c in codes} == codes and out["Aaa new"] == out[None] == forecast.UNKNOWN_CODE


def test_codes_are_dense_ranks_without_a_global_window(spark, monkeypatch):
    values = [f"v{(i * 7919) % 5000:05d}" for i in range(12_000)] + [None, "é", "Z", "a"]
    df = spark.createDataFrame([(v,) for v in values], "c string").repartition(7)
    out, maps = weekly.label_encode(df, ["c", "absent"])
    want = {v: i for i, v in enumerate(sorted({v or "nan" for v in values}, key=lambda v: v.encode()))}
    assert {(r.c, r.c_encoded) for r in out.collect()} == {(v, want[v or "nan"]) for v in set(values)} and set(maps) == {"c"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "hint" not in plan.lower() and "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_rows_read_as_text_compare_by_value(spark):
    day = "2025-01-01"
    raw = spark.createDataFrame([(day, "A", "1", "2.0", "2", "1"), (day, "A", "1.0", "2", "2.00", "1.0"), (day, "A", "one", "2", "2", "0"),
                                 (day, "A", "One", "2", "2", "0"), (day, "A", None, "2", "2", "0"), (day, "A", "-0", "0", "2", "0"), (day, "A", "0.0", "0", "2", "0")],
                                "date string, sku_id string, units_sold string, revenue string, unit_price string, promo_flag string")
    sku = spark.createDataFrame([("A",)], "sku_id string")
    out = cleaning.annotate_sales(raw, sku).collect()
    assert sorted((str(r.units_sold), r.n_copies, r.drop_reason) for r in out) == sorted(
        [("1.0", 2, None), ("None", 1, "coercion"), ("None", 1, "coercion"), ("None", 1, "missing"), ("0.0", 2, None)])
    cal = spark.createDataFrame([(day, "44.0", "1", "s", "1", "x")], "date string, week string, month string, season string, is_holiday string, promo_event string")
    assert cleaning.clean_calendar(cal).first().week == 44
    inv = spark.createDataFrame([(day, "A", "5", "0", "7", "9"), (day, "A", "5.0", "0.0", "7.0", "9.0")],
                                "date string, sku_id string, on_hand_units string, on_order_units string, lead_time_days string, reorder_point string")
    assert cleaning.clean_inventory(inv, sku).count() == 1


def test_latest_snapshot_has_one_row_per_sku(spark):
    d = dt.date(2025, 1, 5)
    inv = spark.createDataFrame([(d, "A", 5.0), (d, "A", 3.0), (d, "B", 1.0), (d - dt.timedelta(days=7), "C", 1.0)], "date date, sku_id string, on_hand_units double")
    assert sorted((r.sku_id, r.on_hand_units) for r in risk.latest_inventory(inv).collect()) == [("A", 3.0), ("B", 1.0)]


def test_audit_counters_come_with_the_writes(spark, tmp_dir):
    raw = raw_tables(spark, SF)
    log = jobs.run_cleaning_job(spark, raw, tmp_dir).first()
    ann, clean = (spark.read.parquet(f"{tmp_dir}/{n}") for n in ("_annotated_sales", "clean_sales"))
    assert log == cleaning.cleaning_audit(ann, clean).first()


def test_folds_fitted_at_once_equal_folds_in_turn(spark):
    from test_forecast import _weekly
    train = forecast.training_table(weekly.with_baseline(_weekly(spark, n_skus=4, n_weeks=60)))
    both = [sorted(map(tuple, forecast.cross_validate(train, forecast.ForecastParams(cv_trees=3, max_depth=4, cv_parallel=n)).collect())) for n in (1, 5)]
    assert both[0] == both[1]


def test_a_series_reads_one_bucket_and_joins_without_an_exchange(spark, done, tmp_dir, monkeypatch):
    res = spark.read.parquet(f"{done}/forecast_results")
    monkeypatch.setattr(files, "BUCKET_ROWS", max(1, res.count() // 7))
    buckets = files.bucket_count(res.count())
    assert buckets == 8 and files.bucket_count(0) == files.bucket_count(1) == 1
    path = f"{tmp_dir}/bucketed"
    table = files.write_bucketed(res, path, "series_test", "sku_id", ["sku_id", "date"], buckets)
    assert sorted(map(str, table.collect())) == sorted(map(str, res.collect()))
    again = files.open_bucketed(spark, path, "series_again", "sku_id", ["sku_id", "date"], buckets)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sku = res.first().sku_id
    # Only a scan that is planned bucket by bucket says in its plan how many it reads.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for t in (table, again):
        one = jobs.sku_series(t, sku)
        assert "SelectedBucketsCount: 1 out of 8" in plan(one)
        assert one.count() == res.filter(F.col("sku_id") == sku).count()
    try:
        joined = again.join(table.select("sku_id", "date", F.col("ml_forecast").alias("other")), ["sku_id", "date"])
        summed = again.groupBy("sku_id").agg(F.sum("ml_forecast"))
        assert "Exchange" not in plan(joined) and "Exchange" not in plan(summed) and joined.count() == res.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_the_forecast_job_leaves_a_bucketed_table(spark, done):
    table = jobs.open_forecast_table(spark, done)
    assert table.count() == jobs.load_forecast(spark, done).results.count()
    assert "Exchange" not in table.groupBy("sku_id").count()._jdf.queryExecution().executedPlan().toString()
