"""End-to-end batch jobs: cleaning, training / forecasting and report export.

Each job reads its inputs, runs the operators and writes its outputs once;
jobs communicate only through the written tables, so any of them can be
re-run on its own (and a lost executor never forces a re-run of an earlier
job).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stockflow.operators import cleaning, features, forecast, marts, risk, weekly
from stockflow.sources import files
from stockflow.sources.adapters import RawTables

CLEAN_TABLES = ["sku_master", "sales", "calendar", "inventory"]
FORECAST_TABLE = "stockflow_forecast_results"


def _p(base: str, name: str) -> str:
    return os.path.join(base, name) if "://" not in base else f"{base.rstrip('/')}/{name}"


def run_cleaning_job(spark: SparkSession, raw: RawTables, out_dir: str, fmt: str = "parquet") -> DataFrame:
    """Clean the four raw tables, write them and the run log; returns the
    run-log row. All tables are written anew on every run; counters come with
    the writes."""
    files.write_table(cleaning.clean_sku_master(raw.sku_master), _p(out_dir, "clean_sku_master"))
    sku = spark.read.parquet(_p(out_dir, "clean_sku_master"))
    ann_path = _p(out_dir, "_annotated_sales")
    # The counters of the run log are observed by the two writes: neither table is read for them.
    seen = [Observation("annotated"), Observation("clean")]
    files.write_table(cleaning.annotate_sales(raw.sales, sku).observe(seen[0], *cleaning.annotated_counters()), ann_path)
    ann = spark.read.parquet(ann_path)
    files.write_table(cleaning.finish_sales(ann).observe(seen[1], *cleaning.clean_counters()), _p(out_dir, "clean_sales"))
    files.write_table(cleaning.clean_calendar(raw.calendar), _p(out_dir, "clean_calendar"))
    files.write_table(cleaning.clean_inventory(raw.inventory, sku), _p(out_dir, "clean_inventory"))
    if fmt == "csv":   # header CSV copies of the clean layer, as the reference hands over
        for n in ("sku_master", "sales", "calendar", "inventory"):
            files.write_table(spark.read.parquet(_p(out_dir, f"clean_{n}")), _p(out_dir, f"csv/clean_{n}"), "csv")
    log = cleaning.observed_audit(spark, {**seen[0].get, **seen[1].get})
    files.write_record(log, _p(out_dir, "logs/pipeline_run_log"))
    return spark.read.schema(log.schema).json(_p(out_dir, "logs/pipeline_run_log"))


def read_clean_tables(spark: SparkSession, clean_dir: str) -> cleaning.CleanTables:
    paths = {n: _p(clean_dir, f"clean_{n}") for n in ("sku_master", "sales", "calendar", "inventory")}
    files.require_inputs(spark, paths)
    t = {n: spark.read.parquet(p) for n, p in paths.items()}
    return cleaning.CleanTables(sku_master=t["sku_master"], sales=t["sales"], calendar=t["calendar"],
                                inventory=t["inventory"])


def weekly_table(c: cleaning.CleanTables) -> DataFrame:
    """Weekly demand of the clean tables with attributes, codes and the seasonal baseline."""
    daily = features.daily_features(features.daily_grid(c.sku_master, c.sales, c.calendar))
    return weekly.with_baseline(weekly.weekly_demand(daily, c.sku_master))


def run_forecast_job(spark: SparkSession, clean_dir: str, out_dir: str,
                     params: forecast.ForecastParams | None = None, with_cv: bool = True) -> forecast.ForecastRun:
    """Features → weekly → forest → backtest → projection. Writes the result
    table in buckets of sku_id, sorted by date (a series is read from one bucket, a
    join by SKU needs no exchange), the metrics record and the model artifact."""
    c = read_clean_tables(spark, clean_dir)
    wk = weekly_table(c)
    sku_enc, encoders = weekly.label_encode(c.sku_master, ["category", "subcategory"])
    split = weekly.default_split(c.sales, wk)
    run = forecast.train_and_forecast(wk, sku_enc, weekly.week_calendar_flags(c.calendar), split, params, with_cv)
    res = files.check_forecast_contract(run.results)
    buckets = files.bucket_count(res.count())
    files.write_bucketed(res, _p(out_dir, "forecast_results"), FORECAST_TABLE, "sku_id", ["sku_id", "date"], buckets)
    files.write_record(spark.range(1).select(F.lit(buckets).alias("buckets")), _p(out_dir, "logs/forecast_layout"))
    files.write_record(run.metrics, _p(out_dir, "logs/forecast_metrics"))
    if run.cv_metrics is not None:
        files.write_table(run.cv_metrics, _p(out_dir, "logs/cv_metrics"))
    forecast.save_model(run, _p(out_dir, "models/forecast_model"), spark, encoders)
    return run


@dataclass
class Forecast:
    """What a forecast job left: the result table, its metrics, the cleaning job's run log, the
    model bundle, and how many records of the results couldn't be read."""
    results: DataFrame
    metrics: DataFrame
    run_log: DataFrame
    model: dict
    bad_records: int


def load_forecast(spark: SparkSession, out_dir: str, results: str = "forecast_results", work_dir: str | None = None) -> Forecast:
    """Everything that a consumer of the forecast needs, checked before any of it is used.

    All missing artefacts are named in one ``FileNotFoundError``; artefacts that are
    there but cut or malformed are named together, each with its problem, in one
    ``ContractError``. Results may be a table or header CSV (``results`` ending in
    ``.csv``), of which bad records are set apart under ``work_dir``."""
    paths = {"forecast results": _p(out_dir, results), "forecast metrics": _p(out_dir, "logs/forecast_metrics"),
             "run log": _p(out_dir, "logs/pipeline_run_log"), "forecast model": _p(out_dir, "models/forecast_model")}
    files.require_inputs(spark, paths)

    def read_results(path: str) -> tuple[DataFrame, int]:
        if path.endswith(".csv"):
            return files.read_forecast_csv(spark, path, _p(work_dir or out_dir, "bad_records"))
        if not files.table_complete(spark, path):
            raise files.ContractError("the table was not written to its end")
        return files.check_forecast_contract(spark.read.parquet(path)), 0

    readers = {"forecast results": read_results, "forecast metrics": lambda p: files.read_metrics_record(spark, p),
               "run log": lambda p: files.read_run_log(spark, p), "forecast model": lambda p: forecast.load_model(p, spark)}
    got, wrong = {}, []
    for name, path in paths.items():
        try:
            got[name] = readers[name](path)
        except Exception as e:  # noqa: BLE001  whatever is wrong with one, the others are looked at
            wrong.append(f"{name} ({path}): {str(e).splitlines()[0]}")
    if wrong:
        raise files.ContractError("; ".join(wrong))
    table, bad = got["forecast results"]
    return Forecast(table, got["forecast metrics"], got["run log"], got["forecast model"], bad)


def open_forecast_table(spark: SparkSession, out_dir: str) -> DataFrame:
    """The result table of a forecast job as a bucketed table of this session."""
    layout = spark.read.json(_p(out_dir, "logs/forecast_layout")).first()
    return files.open_bucketed(spark, _p(out_dir, "forecast_results"), FORECAST_TABLE, "sku_id", ["sku_id", "date"], layout.buckets)


def sku_series(results: DataFrame, sku_id: str) -> DataFrame:
    """The chart series of one SKU, by date; band rows are those without an actual."""
    one = results.filter(F.col("sku_id") == sku_id)
    return one.select("*", F.col("actual_sales").isNull().alias("is_band_row")).orderBy("date")


def run_reports_job(spark: SparkSession, clean_dir: str, out_dir: str, params: risk.RiskParams | None = None,
                    forecasts: Forecast | None = None) -> dict[str, str]:
    """Risk table once, then it and every decision table exported as header CSV
    (the dashboard's downloads); with ``forecasts`` the forecast table and the
    health table as well, and accuracies among the KPIs. Returns name → path."""
    c = read_clean_tables(spark, clean_dir)
    r = risk.risk_scores(risk.latest_inventory(c.inventory), c.sku_master, c.sales, params)
    r_path = _p(out_dir, "risk")
    files.write_table(r, r_path)
    r = spark.read.parquet(r_path)
    outputs = {
        "reorder_plan": marts.reorder_plan(r), "markdown_plan": marts.markdown_plan(r),
        "top_reorders": marts.top_reorders(r), "top_markdowns": marts.top_markdowns(r),
        "risk": r, "executive_kpis": marts.executive_kpis(r, forecasts.metrics if forecasts else None), "reorder_by_category": marts.reorder_by_category(r),
        "category_revenue_share": marts.category_revenue_share(c.sales, c.sku_master),
        "risk_matrix_points": marts.risk_matrix_points(r), "inventory_position": marts.inventory_position(r),
        "decision_rationale": marts.decision_rationale(r),
    }
    if forecasts:
        outputs |= {"forecast": forecasts.results, "pipeline_health": marts.pipeline_health(forecasts.run_log, forecasts.metrics)}
    paths = {}
    for name, df in outputs.items():
        paths[name] = _p(out_dir, f"reports/{name}")
        files.write_table(df, paths[name], "csv")
    return paths


def head_preview(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` rows under an explicit order (a top-n, not a scan prefix)."""
    return df.orderBy(*[F.col(c) for c in order]).limit(n)
