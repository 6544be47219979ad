"""Weekly demand: roll-up of the daily features to Sunday-ending weeks,
SKU attributes and label encodings, seasonal-naive baseline, week calendar
flags, train / backtest / future split and expanding CV folds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockflow.functions.columns import week_end
from stockflow.session import materialize

SEASON_DAYS = 364
BACKTEST_WEEKS = 6
HORIZON_WEEKS = 6
CV_SPLITS = 5

SUM_COLS = ["lag_1", "lag_7", "lag_14", "lag_28"]
MEAN_COLS = ["rolling_mean_7", "rolling_std_7", "rolling_max_7", "rolling_min_7",
             "rolling_mean", "rolling_std", "rolling_max", "rolling_min", "day_of_week"]
FIRST_COLS = ["week_number", "month", "quarter"]
MAX_COLS = ["holiday_flag", "promo_flag", "promotion_flag", "weekend_flag"]


def weekly_rollup(daily: DataFrame) -> DataFrame:
    """(sku_id, week ending Sunday) aggregates; ``first`` columns come from
    the earliest day of the week (``min_by``, independent of row order)."""
    d = daily.withColumn("week_end", week_end(F.col("date")))
    aggs = [F.sum("units_sold").alias("actual_sales")]
    aggs += [F.sum(c).alias(c) for c in SUM_COLS]
    aggs += [F.avg(c).alias(c) for c in MEAN_COLS]
    aggs += [F.min_by(c, "date").alias(c) for c in FIRST_COLS]
    aggs += [F.max(c).alias(c) for c in MAX_COLS]
    return d.groupBy("sku_id", "week_end").agg(*aggs).withColumnRenamed("week_end", "date")


def value_codes(values: DataFrame, col: str, code: str) -> DataFrame:
    """``col`` and its 0-based rank (``code``) among the distinct ``values``, without a window over
    all of them: ranges of values are sorted each by itself and written with their
    places; a place plus the number of values in the ranges before is the rank.
    What passes the driver is one count a range."""
    n = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranges = values.select(col).repartitionByRange(n, col).sortWithinPartitions(col)
    placed = materialize(ranges.select(col, F.spark_partition_id().alias("_range"), place.alias("_place")), f"codes_{col}")
    counts = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    before = F.array(*[F.lit(sum(c for k, c in counts.items() if k < i)).cast("long") for i in range(n)])
    return placed.select(col, (F.get(before, F.col("_range")) + F.col("_place")).cast("int").alias(code))


def label_encode(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``<col>_encoded`` = rank of the value among the sorted distinct values
    (0-based, NULL encoded as the text "nan"). Columns absent from ``df`` are
    skipped. Returns the frame and the value → code tables.

    The ranks are a distributed dense rank (``value_codes``), whatever the number
    of values; how the codes are joined is left to the planner.
    """
    mapping = {}
    out = df
    for c in cols:
        if c not in df.columns:
            continue
        v = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        codes = value_codes(df.select(v.alias("_v")).distinct(), "_v", f"{c}_encoded")
        mapping[c] = codes.withColumnRenamed("_v", c)
        out = out.withColumn("_v", v).join(codes, "_v", "left").drop("_v")
    return out, mapping


def weekly_demand(daily_feats: DataFrame, sku: DataFrame) -> DataFrame:
    """Weekly roll-up ⟕ SKU attributes with category / subcategory codes.

    Codes are computed on the SKU master (the weekly table carries exactly the
    master's SKUs), so only a dimension-sized table is ranked and joined."""
    sku_enc, _ = label_encode(sku, ["category", "subcategory"])
    w = weekly_rollup(daily_feats)
    return w.join(sku_enc, "sku_id", "left")


def seasonal_naive(weekly: DataFrame, value: str = "actual_sales", days: int = SEASON_DAYS) -> Column:
    """Value of the same SKU exactly ``days`` earlier, 0.0 when absent.

    A RANGE frame of width zero at offset −days on the day number: an exact
    keyed lookup that reuses the sku_id partitioning instead of a self-join.
    """
    w = (Window.partitionBy("sku_id").orderBy(F.unix_date(F.col("date")))
               .rangeBetween(-days, -days))
    return F.coalesce(F.first(value).over(w), F.lit(0.0))


def with_baseline(weekly: DataFrame) -> DataFrame:
    return weekly.withColumn("baseline_forecast", seasonal_naive(weekly))


@dataclass
class Split:
    """Backtest window [start, end] (weeks dated by their Sunday); training
    is every week before ``start``; the future starts a week after the last
    weekly date."""
    start: Column
    end: Column
    last_week: Column


def default_split(sales: DataFrame, weekly: DataFrame, backtest_weeks: int = BACKTEST_WEEKS) -> Split:
    """Backtest = the last ``backtest_weeks`` complete weeks of sales."""
    last_sale = sales.select(F.max("date")).scalar()
    end = F.date_sub(F.date_trunc("week", F.date_add(last_sale, 1)).cast("date"), 1)
    start = F.date_sub(end, 7 * backtest_weeks - 1)
    # The daily grid ends on the last sale, so the last weekly date is the
    # Sunday closing that day: no pass over the weekly table is needed.
    return Split(start=start, end=end, last_week=week_end(last_sale))


def week_calendar_flags(calendar: DataFrame) -> DataFrame:
    """Per week ending Sunday: any holiday, any promotion event (7 days)."""
    return (calendar.groupBy(week_end(F.col("date")).alias("date"))
                    .agg(F.max((F.col("is_holiday") > 0).cast("int")).alias("holiday_flag"),
                         F.max(F.col("promo_event").isNotNull().cast("int")).alias("promo_flag")))


def cv_folds(train_weeks: DataFrame, n_splits: int = CV_SPLITS) -> DataFrame:
    """Expanding-window folds over the sorted distinct training weeks:
    n weeks, fold size t = n // (n_splits + 1); fold i validates ranks
    [n − (n_splits − i)·t, n − (n_splits − 1 − i)·t) and trains on every lower
    rank. One row per week with its rank and validation fold (NULL = train
    only). The ranking runs over distinct week dates only."""
    weeks = train_weeks.select("date").distinct()
    w = Window.orderBy("date")
    r = weeks.select("date", (F.row_number().over(w) - 1).cast("int").alias("week_rank"),
                     F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("n_weeks"))
    t = (F.col("n_weeks") / (n_splits + 1)).cast("int")
    first_val = F.col("n_weeks") - n_splits * t
    fold = F.when((t > 0) & (F.col("week_rank") >= first_val),
                  ((F.col("week_rank") - first_val) / t).cast("int"))
    return r.select("date", "week_rank", "n_weeks", t.alias("fold_size"), fold.alias("val_fold"))


def future_baseline(weekly: DataFrame, last_week: Column, horizon: int = HORIZON_WEEKS,
                    days: int = SEASON_DAYS) -> DataFrame:
    """Future weeks (Sundays after ``last_week``) per SKU with the baseline =
    actual ``days`` earlier (actuals only). Generated per SKU, then a
    (sku_id, date) lookup join against the weekly actuals."""
    skus = weekly.select("sku_id").distinct()
    fut = skus.select("sku_id", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    fut = fut.select("sku_id", "step", F.date_add(last_week, F.col("step") * 7).alias("date"))
    # Only the weeks exactly ``days`` before the horizon are looked up: the
    # filter is applied before the join, so one row per SKU and step crosses
    # the exchange instead of the whole weekly history.
    lo, hi = F.date_sub(F.date_add(last_week, 7), days), F.date_sub(F.date_add(last_week, 7 * horizon), days)
    past = weekly.filter((F.col("date") >= lo) & (F.col("date") <= hi)).select(
        "sku_id", F.date_add(F.col("date"), days).alias("date"), F.col("actual_sales").alias("_past"))
    return fut.join(past, ["sku_id", "date"], "left").select(
        "date", "sku_id", F.lit(None).cast("double").alias("actual_sales"),
        F.coalesce(F.col("_past"), F.lit(0.0)).alias("baseline_forecast"))
