"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query derives the retail tables from the driver tables of ``sf_dir``
(``stockflow.sources.adapters``), runs the library operators and returns a
lazy DataFrame; nothing is collected. Column names match the DuckDB oracle in
``stockflow.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stockflow.operators import cleaning, features, forecast, marts, metrics, profile, risk, weekly
from stockflow.functions.columns import week_end
from stockflow.plans import jobs
from stockflow.session import ensure_checkpoint_dir, scratch_table_path
from stockflow.sources import files
from stockflow.sources.adapters import raw_tables
from stockflow.sources.tables import fingerprint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Parameters of the registered what-if query: lead-time overrides (None = the
# SKU's own) × safety-stock weeks, inside the reference's slider ranges.
SCENARIO_LEAD_DAYS = [None, 7, 14, 21, 30]
SCENARIO_SAFETY_WEEKS = [1.0, 1.5, 2.0, 3.0, 4.0]
FILTER_CATEGORY = "Kitchenware"
# Forest size of the registered forecast queries: the reference's 100 trees /
# 50 per CV fold; depth is MLlib-bounded.
FORECAST_PARAMS = forecast.ForecastParams(num_trees=100, cv_trees=50, max_depth=10)
# The same chain with a formula in place of the forest; the weeks after the backtest are kept.
FORMULA_PARAMS = forecast.ForecastParams(formula=forecast.LAG_MEAN, keep_partial_week=True)
PLOT_WEEKS_BEFORE_BACKTEST = 16
_FORECAST_RUNS: dict = {}
_JOB_RUNS: dict = {}
# Clean-layer tables already written in this application, by input version:
# later queries read them (load-or-build) instead of cleaning again.
_CLEAN_LAYER: dict = {}
_OBSERVED: dict = {}
SOURCE_TABLES = ["lineitem", "supplier"]


class Workspace:
    """Lazily built raw → clean → risk frames of one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ensure_checkpoint_dir(spark)
        self._key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir, SOURCE_TABLES))

    def _layer(self, name: str, build, counters=None) -> DataFrame:
        """Load-or-build of one clean-layer table for this input version. ``counters``
        (aggregates) are observed by the write and kept for the audit."""
        key = (*self._key, name)
        if key not in _CLEAN_LAYER:
            path = scratch_table_path(self.spark, name)
            df = build()
            seen = Observation(f"{name}-{uuid.uuid4().hex}")
            (df.observe(seen, *counters) if counters else df).write.mode("overwrite").parquet(path)
            _OBSERVED[key] = seen.get if counters else {}
            _CLEAN_LAYER[key] = path
        return self.spark.read.parquet(_CLEAN_LAYER[key])

    @property
    def audit_counters(self) -> dict:
        """What the writes of the annotated and the clean sales have counted."""
        self.annotated_sales, self.sales  # noqa: B018  written, if not yet
        return {**_OBSERVED[(*self._key, "annotated_sales")], **_OBSERVED[(*self._key, "clean_sales")]}

    @cached_property
    def raw(self):
        return raw_tables(self.spark, self.sf_dir)

    # The clean layer is written once per application and input version as
    # Parquet tables in the session's checkpoint folder (load-or-build): every
    # later use — joins, scalar subqueries for date bounds, windows, other
    # queries — scans the stored rows (with pruning) instead of re-running the
    # cleaning, and a lost executor recomputes nothing before it.

    @cached_property
    def sku(self) -> DataFrame:
        return self._layer("clean_sku_master", lambda: cleaning.clean_sku_master(self.raw.sku_master))

    @cached_property
    def calendar(self) -> DataFrame:
        return self._layer("clean_calendar", lambda: cleaning.clean_calendar(self.raw.calendar))

    @cached_property
    def inventory(self) -> DataFrame:
        return self._layer("clean_inventory", lambda: cleaning.clean_inventory(self.raw.inventory, self.sku))

    @cached_property
    def annotated_sales(self) -> DataFrame:
        # Written once: the fence aggregate and the join back both read it
        # (their plans prune differently, so Spark would not share the work).
        return self._layer("annotated_sales", lambda: cleaning.annotate_sales(self.raw.sales, self.sku), cleaning.annotated_counters())

    @cached_property
    def sales(self) -> DataFrame:
        return self._layer("clean_sales", lambda: cleaning.finish_sales(self.annotated_sales), cleaning.clean_counters())

    @cached_property
    def latest_inventory(self) -> DataFrame:
        return risk.latest_inventory(self.inventory)

    def risk(self, params: risk.RiskParams | None = None) -> DataFrame:
        return risk.risk_scores(self.latest_inventory, self.sku, self.sales, params)

    @cached_property
    def grid(self) -> DataFrame:
        return features.daily_grid(self.sku, self.sales, self.calendar)

    @cached_property
    def daily_features(self) -> DataFrame:
        return features.daily_features(self.grid)

    @cached_property
    def weekly(self) -> DataFrame:
        """Weekly demand with SKU attributes, codes and the seasonal baseline."""
        return weekly.with_baseline(weekly.weekly_demand(self.daily_features, self.sku))

    @cached_property
    def sku_enc(self) -> DataFrame:
        return weekly.label_encode(self.sku, ["category", "subcategory"])[0]

    @cached_property
    def week_flags(self) -> DataFrame:
        return weekly.week_calendar_flags(self.calendar)

    @property
    def forecast_run(self) -> forecast.ForecastRun:
        """One fitted forest per (application, data set), shared by the
        forecast queries — like a saved model artifact, training runs once."""
        return self._run("forecast", FORECAST_PARAMS)

    @property
    def formula_run(self) -> forecast.ForecastRun:
        """The forecast chain with the formula model, validation included."""
        return self._run("formula", FORMULA_PARAMS, with_cv=True)

    def _run(self, name: str, params: forecast.ForecastParams, with_cv: bool = False) -> forecast.ForecastRun:
        key = (*self._key, name)
        if key not in _FORECAST_RUNS:
            _FORECAST_RUNS[key] = forecast.train_and_forecast(self.weekly, self.sku_enc, self.week_flags,
                                                              self.split, params, with_cv)
        return _FORECAST_RUNS[key]

    @property
    def job_dir(self) -> str:
        """Where the cleaning, forecast and reports jobs have written, run once over header CSV
        copies of the raw tables; each job reads what the one before wrote."""
        key = (*self._key, "jobs")
        if key not in _JOB_RUNS:
            out = scratch_table_path(self.spark, "jobs")
            for name, table in _raw_dict(self).items():
                files.write_table(table, f"{out}/raw/{name}.csv", "csv")
            jobs.run_cleaning_job(self.spark, files.read_raw_tables(self.spark, f"{out}/raw"), out)
            jobs.run_forecast_job(self.spark, out, out, FORMULA_PARAMS)
            jobs.run_reports_job(self.spark, out, out, forecasts=jobs.load_forecast(self.spark, out))
            _JOB_RUNS[key] = out
        return _JOB_RUNS[key]

    @cached_property
    def split(self) -> weekly.Split:
        return weekly.default_split(self.sales, self.weekly)


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Round float columns whose last bits depend on summation order, so two
    engines agree value for value (the oracle SQL rounds the same columns)."""
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def query(name: str):
    def deco(fn: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Workspace(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# ---- scans and cleaning -------------------------------------------------------

@query("scan_sales")
def _scan_sales(w: Workspace) -> DataFrame:
    """Raw sales as a CSV reader would deliver them (dirt included)."""
    return w.raw.sales


@query("clean_sku_master")
def _clean_sku(w: Workspace) -> DataFrame:
    return w.sku


@query("clean_calendar")
def _clean_calendar(w: Workspace) -> DataFrame:
    return w.calendar


@query("clean_inventory")
def _clean_inventory(w: Workspace) -> DataFrame:
    return w.inventory


@query("clean_sales")
def _clean_sales(w: Workspace) -> DataFrame:
    return w.sales


@query("revenue_consistency")
def _revenue_consistency(w: Workspace) -> DataFrame:
    """Surviving rows whose revenue disagreed with units × price."""
    a = w.annotated_sales.filter(F.col("revenue_corrected"))
    return a.select("date", "sku_id", "units_sold", "unit_price",
                    F.col("revenue").alias("revenue_reported"),
                    (F.col("units_sold") * F.col("unit_price")).alias("revenue_corrected"))


@query("outlier_cap")
def _outlier_cap(w: Workspace) -> DataFrame:
    """Per-SKU quartiles, fence and number of capped rows."""
    f = cleaning.outlier_fences(cleaning.survivors(w.annotated_sales))
    capped = w.sales.groupBy("sku_id").agg(F.count_if("outlier_flag").cast("bigint").alias("capped_rows"))
    return f.join(capped, "sku_id", "inner")


@query("cleaning_audit")
def _cleaning_audit(w: Workspace) -> DataFrame:
    """The run log, from counters that came with the writes of the clean layer."""
    return cleaning.observed_audit(w.spark, w.audit_counters)


# ---- risk -----------------------------------------------------------------------

@query("latest_inventory")
def _latest_inventory(w: Workspace) -> DataFrame:
    return w.latest_inventory


@query("demand_rates")
def _demand_rates(w: Workspace) -> DataFrame:
    """Trailing weekly demand per master SKU with the default for absent SKUs."""
    return risk.attach_rates(w.sku.select("sku_id"), w.sales)


@query("risk_scores")
def _risk_scores(w: Workspace) -> DataFrame:
    return w.risk()


@query("risk_quadrants")
def _risk_quadrants(w: Workspace) -> DataFrame:
    return w.risk().groupBy("quadrant").agg(F.count(F.lit(1)).cast("bigint").alias("sku_count"))


@query("risk_financials")
def _risk_financials(w: Workspace) -> DataFrame:
    return w.risk().select("sku_id", "quadrant", "units_short", "sales_at_risk", "excess_units", "capital_locked")


@query("risk_by_category_filter")
def _risk_by_category(w: Workspace) -> DataFrame:
    return w.risk(risk.RiskParams(category=FILTER_CATEGORY))


@query("risk_lead_override")
def _risk_lead_override(w: Workspace) -> DataFrame:
    """Risk with every lead time replaced by a 21-day simulation value and
    2.5 weeks of safety stock."""
    return w.risk(risk.RiskParams(safety_stock_weeks=2.5, lead_time_override=True, lead_time_days=21))


@query("risk_scenarios")
def _risk_scenarios(w: Workspace) -> DataFrame:
    grid = risk.scenario_grid(SCENARIO_LEAD_DAYS, SCENARIO_SAFETY_WEEKS)
    r = risk.risk_scenarios(w.latest_inventory, w.sku, w.sales, grid)
    return r.select("scenario_id", "lead_override", "safety_stock_weeks", "sku_id", "lead_time_days",
                    "reorder_point_calc", "stockout_risk", "overstock_risk", "quadrant",
                    "sales_at_risk", "capital_locked")


# ---- decision marts ---------------------------------------------------------------

@query("top_reorders")
def _top_reorders(w: Workspace) -> DataFrame:
    return marts.top_reorders(w.risk())


@query("top_markdowns")
def _top_markdowns(w: Workspace) -> DataFrame:
    return marts.top_markdowns(w.risk())


@query("reorder_plan")
def _reorder_plan(w: Workspace) -> DataFrame:
    return marts.reorder_plan(w.risk())


@query("markdown_plan")
def _markdown_plan(w: Workspace) -> DataFrame:
    return marts.markdown_plan(w.risk())


@query("category_revenue_share")
def _category_revenue_share(w: Workspace) -> DataFrame:
    return rounded(marts.category_revenue_share(w.sales, w.sku), ["revenue", "percent"])


@query("reorder_by_category")
def _reorder_by_category(w: Workspace) -> DataFrame:
    return marts.reorder_by_category(w.risk())


@query("executive_kpis")
def _executive_kpis(w: Workspace) -> DataFrame:
    return rounded(marts.executive_kpis(w.risk()), ["total_sales_at_risk", "total_capital_locked"])


@query("risk_matrix_points")
def _risk_matrix_points(w: Workspace) -> DataFrame:
    return marts.risk_matrix_points(w.risk())


@query("inventory_position")
def _inventory_position(w: Workspace) -> DataFrame:
    return marts.inventory_position(w.risk())


@query("decision_rationale")
def _decision_rationale(w: Workspace) -> DataFrame:
    return marts.decision_rationale(w.risk())


# ---- daily features ----------------------------------------------------------------

@query("daily_grid")
def _daily_grid(w: Workspace) -> DataFrame:
    return rounded(w.grid, ["revenue", "unit_price"], 8)


@query("lag_features")
def _lag_features(w: Workspace) -> DataFrame:
    return features.lag_features(w.grid.select("sku_id", "date", "units_sold"))


@query("rolling_features")
def _rolling_features(w: Workspace) -> DataFrame:
    return rounded(features.rolling_features(w.grid.select("sku_id", "date", "units_sold")),
                   ["rolling_std_7", "rolling_std"])


@query("calendar_features")
def _calendar_features(w: Workspace) -> DataFrame:
    c = w.calendar.select("date", "is_holiday", "promo_event")
    hol, promo = features.flag_columns(c)
    return features.calendar_features(c).select("*", hol.alias("holiday_flag"), promo.alias("promo_flag"))


@query("daily_features")
def _daily_features(w: Workspace) -> DataFrame:
    return rounded(rounded(w.daily_features, ["revenue", "unit_price"], 8), ["rolling_std_7", "rolling_std"])


# ---- weekly demand -------------------------------------------------------------------

@query("weekly_demand")
def _weekly_demand(w: Workspace) -> DataFrame:
    return rounded(w.weekly, weekly.MEAN_COLS)


@query("week_calendar_flags")
def _week_calendar_flags(w: Workspace) -> DataFrame:
    return weekly.week_calendar_flags(w.calendar)


@query("label_encode")
def _label_encode(w: Workspace) -> DataFrame:
    enc, _ = weekly.label_encode(w.sku.select("sku_id", "category", "subcategory"), ["category", "subcategory"])
    return enc


@query("seasonal_naive")
def _seasonal_naive(w: Workspace) -> DataFrame:
    return w.weekly.select("sku_id", "date", "actual_sales", "baseline_forecast")


@query("backtest_metrics")
def _backtest_metrics(w: Workspace) -> DataFrame:
    """Seasonal-naive error over the backtest weeks."""
    sp = w.split
    bt = w.weekly.filter((F.col("date") >= sp.start) & (F.col("date") <= sp.end))
    m = metrics.forecast_metrics(bt, "actual_sales", "baseline_forecast")
    return m.select(F.lit("seasonal_naive").alias("model"), "*")


@query("cv_folds")
def _cv_folds(w: Workspace) -> DataFrame:
    return weekly.cv_folds(w.weekly.filter(F.col("date") < w.split.start))


@query("forecast_result_union")
def _forecast_result_union(w: Workspace) -> DataFrame:
    """History, backtest and future rows with actuals and the baseline; the
    future baseline looks up actuals 52 weeks back (0 when absent)."""
    sp = w.split
    wk = w.weekly.select("date", "sku_id", "actual_sales", "baseline_forecast")
    hist = wk.filter(F.col("date") < sp.start).withColumn("segment", F.lit("history"))
    bt = wk.filter((F.col("date") >= sp.start) & (F.col("date") <= sp.end)).withColumn("segment", F.lit("backtest"))
    fut = weekly.future_baseline(w.weekly, sp.last_week).withColumn("segment", F.lit("future"))
    return hist.unionByName(bt).unionByName(fut)


# ---- forecasting (MLlib; rows-only checks) ---------------------------------------------

@query("recursive_features")
def _recursive_features(w: Workspace) -> DataFrame:
    """Model inputs of the first projected week for every SKU (no model)."""
    last = w.split.last_week
    state = forecast.initial_history(w.weekly, last)
    f = forecast.recursive_features(state, F.date_add(last, 7), w.sku_enc, w.week_flags)
    return f.select("sku_id", "date", *forecast.FEATURE_COLS)


@query("rf_forecast")
def _rf_forecast(w: Workspace) -> DataFrame:
    """Forecast result table: history, backtest with predictions and bands,
    recursive future."""
    return w.forecast_run.results


@query("recursive_forecast")
def _recursive_forecast(w: Workspace) -> DataFrame:
    return w.forecast_run.results.filter(F.col("actual_sales").isNull() & F.col("ml_forecast").isNotNull())


@query("forecast_metrics_record")
def _forecast_metrics_record(w: Workspace) -> DataFrame:
    return w.forecast_run.metrics


@query("rf_cv_metrics")
def _rf_cv_metrics(w: Workspace) -> DataFrame:
    """Pooled expanding-window CV metrics of the forest and the baseline."""
    train = forecast.training_table(w.weekly).filter(F.col("date") < w.split.start)
    return forecast.cross_validate(train, FORECAST_PARAMS)


@query("forecast_series")
def _forecast_series(w: Workspace) -> DataFrame:
    """Chart series of every SKU from a plot start date; band rows are those
    without an actual."""
    start = F.date_sub(w.split.start, 7 * PLOT_WEEKS_BEFORE_BACKTEST)
    r = w.forecast_run.results.filter(F.col("date") >= start)
    return r.select("*", F.col("actual_sales").isNull().alias("is_band_row")).orderBy("sku_id", "date")


# ---- the forecast chain with a formula model (every step has an oracle) ----------------

METRIC_COLS = ["wape", "mae", "rmse", "bias", "baseline_wape", "ml_wape", "improvement"]
BAND_COLS = ["lower_bound", "upper_bound", "ml_lower_bound", "ml_upper_bound", "std_error"]


@query("formula_forecast")
def _formula_forecast(w: Workspace) -> DataFrame:
    """Result table of the formula model: history, backtest, weeks after it, projection."""
    return rounded(w.formula_run.results, BAND_COLS)


@query("formula_recursive_forecast")
def _formula_recursive_forecast(w: Workspace) -> DataFrame:
    """The recursive projection alone: six weeks a SKU, each step fed by the one before."""
    r = w.formula_run.results
    return rounded(r.filter(F.col("actual_sales").isNull() & F.col("ml_forecast").isNotNull())
                   .select("date", "sku_id", "baseline_forecast", "ml_forecast", "lower_bound", "upper_bound"), BAND_COLS)


@query("formula_metrics_record")
def _formula_metrics_record(w: Workspace) -> DataFrame:
    """Errors of model and baseline over the backtest, and the improvement."""
    return rounded(w.formula_run.metrics.drop("training_date"), METRIC_COLS)


@query("formula_cv_metrics")
def _formula_cv_metrics(w: Workspace) -> DataFrame:
    """Pooled expanding-window validation of model and baseline."""
    return rounded(w.formula_run.cv_metrics, METRIC_COLS)


@query("formula_series")
def _formula_series(w: Workspace) -> DataFrame:
    """Chart series of every SKU from the plot start on."""
    start = F.date_sub(w.split.start, 7 * PLOT_WEEKS_BEFORE_BACKTEST)
    r = w.formula_run.results.filter(F.col("date") >= start)
    return rounded(r.select("*", F.col("actual_sales").isNull().alias("is_band_row")).orderBy("sku_id", "date"), BAND_COLS)


@query("formula_kpis")
def _formula_kpis(w: Workspace) -> DataFrame:
    """The KPI row with the accuracies of the formula model and the baseline."""
    return rounded(marts.executive_kpis(w.risk(), w.formula_run.metrics),
                   ["total_sales_at_risk", "total_capital_locked", "forecast_accuracy", "baseline_accuracy", "improvement"])


@query("formula_health")
def _formula_health(w: Workspace) -> DataFrame:
    """Pipeline health: counters of the cleaning and the error comparison, a row each."""
    log = cleaning.observed_audit(w.spark, w.audit_counters)
    return rounded(marts.pipeline_health(log, w.formula_run.metrics), ["value"])


# ---- the batch jobs, from CSV to the written artefacts, read back -----------------------

def _job_clean(table: str):
    @query(f"job_clean_{table}")
    def _job_table(w: Workspace) -> DataFrame:
        """A clean table that the cleaning job wrote from CSV."""
        return getattr(jobs.read_clean_tables(w.spark, w.job_dir), table)


for _table in jobs.CLEAN_TABLES:
    _job_clean(_table)


@query("job_run_log")
def _job_run_log(w: Workspace) -> DataFrame:
    """The cleaning job's run log, read under its contract."""
    return jobs.load_forecast(w.spark, w.job_dir).run_log


@query("job_forecast")
def _job_forecast(w: Workspace) -> DataFrame:
    """The forecast job's result table, loaded with all checks."""
    return rounded(jobs.load_forecast(w.spark, w.job_dir).results, BAND_COLS)


@query("job_metrics")
def _job_metrics(w: Workspace) -> DataFrame:
    """The forecast job's metrics record, read under its contract."""
    return rounded(files.read_metrics_record(w.spark, f"{w.job_dir}/logs/forecast_metrics").drop("training_date"), METRIC_COLS)


@query("job_model_scores")
def _job_model_scores(w: Workspace) -> DataFrame:
    """Weekly demand of the job's clean tables, encoded and scored by the saved model bundle."""
    bundle = forecast.load_model(f"{w.job_dir}/models/forecast_model", w.spark)
    wk = jobs.weekly_table(jobs.read_clean_tables(w.spark, w.job_dir))
    wk = forecast.encode_as_trained(wk.drop("category_encoded", "subcategory_encoded"), bundle["encoders"])
    return bundle["model"].transform(wk).select("sku_id", "date", "category_encoded", "subcategory_encoded", "ml_forecast")


def _report(w: Workspace, name: str, like: DataFrame) -> DataFrame:
    """An exported CSV report with the types of ``like``."""
    return w.spark.read.schema(like.schema).option("header", True).csv(f"{w.job_dir}/reports/{name}")


def _job_risk_table(w: Workspace) -> DataFrame:
    """The risk table that the reports job wrote, and from which it exported: the types of its
    reports come from there, nothing is cleaned again for them."""
    return w.spark.read.parquet(f"{w.job_dir}/risk")


@query("job_reorder_plan")
def _job_reorder_plan(w: Workspace) -> DataFrame:
    """The reorder plan as exported by the reports job."""
    return _report(w, "reorder_plan", marts.reorder_plan(_job_risk_table(w)))


@query("job_risk")
def _job_risk(w: Workspace) -> DataFrame:
    """The risk table as exported by the reports job."""
    return _report(w, "risk", _job_risk_table(w))


@query("job_health")
def _job_health(w: Workspace) -> DataFrame:
    """The health table as exported by the reports job."""
    f = jobs.load_forecast(w.spark, w.job_dir)
    return rounded(_report(w, "pipeline_health", marts.pipeline_health(f.run_log, f.metrics)), ["value"])


@query("job_preview")
def _job_preview(w: Workspace) -> DataFrame:
    """The first five rows of the written risk table by SKU."""
    return jobs.head_preview(_job_risk_table(w), ["sku_id"])


# ---- profiling and dimensions ---------------------------------------------------------

def _raw_dict(w: Workspace) -> dict[str, DataFrame]:
    r = w.raw
    return {"sales_daily": r.sales, "inventory_snapshots": r.inventory, "calendar": r.calendar,
            "sku_master": r.sku_master}


@query("profile_shape")
def _profile_shape(w: Workspace) -> DataFrame:
    return profile.profile_shape(_raw_dict(w))


@query("profile_schema")
def _profile_schema(w: Workspace) -> DataFrame:
    return profile.profile_schema(_raw_dict(w))


@query("profile_nulls")
def _profile_nulls(w: Workspace) -> DataFrame:
    return profile.profile_nulls(_raw_dict(w))


@query("profile_duplicates")
def _profile_duplicates(w: Workspace) -> DataFrame:
    return profile.profile_duplicates(_raw_dict(w))


@query("profile_describe")
def _profile_describe(w: Workspace) -> DataFrame:
    """describe(include="all") of every column of the four raw tables
    (order-dependent mean / std and interpolated quartiles rounded)."""
    return rounded(profile.describe_all(_raw_dict(w)), ["mean", "std", "p25", "p50", "p75"])


@query("dimension_values")
def _dimension_values(w: Workspace) -> DataFrame:
    """Distinct category, subcategory and SKU values of the clean master
    (the filter lists), plus the distinct weekly dates."""
    sku = w.sku
    parts = [sku.select(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).distinct()
             for d in ("category", "subcategory", "sku_id")]
    parts.append(w.weekly.select(F.lit("week").alias("dimension"), F.col("date").cast("string").alias("value"))
                 .distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("weekly_total")
def _weekly_total(w: Workspace) -> DataFrame:
    """Total clean units per Sunday-ending week, empty weeks as 0. The week
    spine is generated from the (bounded) first / last week."""
    s = w.sales.select(week_end(F.col("date")).alias("week_end"), "units_sold")
    tot = s.groupBy("week_end").agg(F.sum("units_sold").alias("total_units"))
    b = s.select(F.struct(F.min("week_end").alias("a"), F.max("week_end").alias("b"))).scalar()
    spine = w.spark.range(1).select(F.explode(F.sequence(b.getField("a"), b.getField("b"),
                                                         F.expr("INTERVAL 7 DAYS"))).alias("week_end"))
    return spine.join(tot, "week_end", "left").select(
        "week_end", F.coalesce("total_units", F.lit(0.0)).alias("total_units"))
