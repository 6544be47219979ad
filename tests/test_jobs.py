from pyspark.sql import functions as F

from stockflow.operators import forecast
from stockflow.plans import jobs
from stockflow.sources import files
from stockflow.sources.adapters import raw_tables

SF = "/root/testdata/sf0.001"


def test_jobs_end_to_end(spark, tmp_dir):
    log = jobs.run_cleaning_job(spark, raw_tables(spark, SF), tmp_dir, fmt="csv").first()
    assert log.raw_sales_rows == (log.clean_sales_rows + log.duplicate_sales_removed + log.missing_sales_removed
                                  + log.coercion_removed + log.negative_values_removed + log.invalid_skus_removed)
    assert files.path_exists(spark, tmp_dir + "/csv/clean_sales")
    run = jobs.run_forecast_job(spark, tmp_dir, tmp_dir, forecast.ForecastParams(num_trees=3, cv_trees=2, max_depth=3))
    res = spark.read.parquet(tmp_dir + "/forecast_results")
    assert res.filter(F.col("actual_sales").isNull()).count() > 0
    m = files.read_metrics_record(spark, tmp_dir + "/logs/forecast_metrics")
    assert m.count() == 1
    assert "model" in forecast.load_model(tmp_dir + "/models/forecast_model", spark)
    paths = jobs.run_reports_job(spark, tmp_dir, tmp_dir)
    assert spark.read.option("header", True).csv(paths["executive_kpis"]).count() == 1
    prev = jobs.head_preview(res, ["sku_id", "date"]).collect()
    assert len(prev) == 5


def test_jobs_from_csv_write_what_the_operators_give(spark):
    from stockflow.plans.catalog import QUERIES
    for job, own in (("job_clean_sales", "clean_sales"), ("job_clean_inventory", "clean_inventory"),
                     ("job_forecast", "formula_forecast"), ("job_risk", "risk_scores")):
        a, b = QUERIES[job](spark, SF), QUERIES[own](spark, SF)
        a, b = a.select(sorted(a.columns)), b.select(sorted(b.columns))
        assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, job


def test_job_queries_clean_nothing_a_second_time(spark, monkeypatch):
    from stockflow.plans.catalog import QUERIES, Workspace

    def again(self, name, *rest):
        raise AssertionError(f"{name} is built outside the jobs")
    monkeypatch.setattr(Workspace, "_layer", again)
    n = {q: QUERIES[q](spark, SF).count() for q in ("job_reorder_plan", "job_risk", "job_health", "job_model_scores", "job_forecast")}
    assert n["job_risk"] > 0 and n["job_model_scores"] > 0 and n["job_forecast"] > n["job_model_scores"]
