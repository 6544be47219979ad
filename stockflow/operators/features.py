"""Daily time-series features on a dense SKU × day grid.

Partitioning plan: the daily sales are aggregated to (sku_id, date), dealt by
``sku_id`` once and repeated over the days without sales; the lag / rolling windows and
the weekly roll-up then reuse that partitioning, whatever the session's settings. Every
SKU holds exactly one row per day, so partitions are even whatever the sales skew.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAGS = [1, 7, 14, 28]
ROLL_WINDOW = 7
VALUE_COLS = ["units_sold", "revenue", "unit_price", "promo_flag"]


def sales_daily(sales: DataFrame) -> DataFrame:
    """Unique (sku_id, date) sales: units and revenue summed, promo flag max,
    unit price averaged. Partial aggregation absorbs hot SKUs."""
    return sales.groupBy("sku_id", "date").agg(
        F.sum("units_sold").alias("units_sold"),
        F.sum("revenue").alias("revenue"),
        F.avg("unit_price").alias("unit_price"),
        F.max("promo_flag").cast("int").alias("promo_flag"),
    )


def date_spine(sales: DataFrame):
    """(first, last) sale date from one scalar subquery (a struct)."""
    b = sales.select(F.struct(F.min("date").alias("d0"), F.max("date").alias("d1"))).scalar()
    return b.getField("d0"), b.getField("d1")


def daily_grid(sku: DataFrame, sales: DataFrame, calendar: DataFrame,
               num_partitions: int | None = None) -> DataFrame:
    """Every master SKU × every day from the first to the last sale.

    Each SKU gets a start row on the day before the spine; every row is then repeated up to
    the day before the SKU's next one, the first of them with the day's sales, the
    others without. So only days with sales are exchanged, by ``sku_id``, and the
    grid has no join by day that a session would deal anew by (sku_id, date). Gaps are
    zero-filled; holidays come from the calendar (0 when absent). The
    calendar side is one row per day of the spine, so it is broadcast.
    """
    d0, d1 = date_spine(sales)
    n = num_partitions or grid_partitions(sku, sales)
    daily = sales_daily(sales.filter(F.col("sku_id").isNotNull() & F.col("date").isNotNull()))
    starts = sku.select("sku_id").distinct().select("sku_id", F.date_sub(d0, 1).alias("date"), F.lit(True).alias("_start"))
    # An explicit partition count: the days with sales are few next to their grid, so a
    # size-based (AQE-coalesced) partitioning would put the whole exploded grid
    # and every window over it into one task.
    rows = daily.unionByName(starts, allowMissingColumns=True).repartition(n, "sku_id")
    w = _w("sku_id", "date")
    # A SKU's start row is its first; without one it isn't in the master.
    rows = rows.select("*", F.lead("date").over(w).alias("_next"), F.first("_start").over(w).alias("_known")).filter("_known")
    span = F.sequence(F.col("date"), F.coalesce(F.date_sub("_next", 1), d1))
    g = rows.select("sku_id", "date", F.explode(span).alias("_day"), *VALUE_COLS).filter(F.col("_day") >= d0)
    own = F.col("_day") == F.col("date")
    g = g.select("sku_id", F.col("_day").alias("date"), *[F.when(own, F.col(c)).alias(c) for c in VALUE_COLS])
    cal = F.broadcast(calendar.select("date", "is_holiday"))
    g = g.join(cal, "date", "left")
    return g.select(
        "sku_id", "date",
        F.coalesce("units_sold", F.lit(0.0)).alias("units_sold"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("unit_price", F.lit(0.0)).alias("unit_price"),
        F.coalesce("promo_flag", F.lit(0)).cast("int").alias("promo_flag"),
        F.coalesce("is_holiday", F.lit(0)).cast("int").alias("is_holiday"),
    )


CELLS = 1_000_000   # SKU-days of a partition at most, on average


def grid_partitions(sku: DataFrame, sales: DataFrame) -> int:
    """Partitions of the SKU × day grid: by its number of cells, and at least the session's
    shuffle partitions and the default parallelism. Two small jobs over the SKU list
    and the (min, max) of the sales dates."""
    spark = sku.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    days = sales.select(F.date_diff(F.max("date"), F.min("date"))).first()[0]
    skus = sku.select(F.approx_count_distinct("sku_id")).first()[0]
    return max(least, -(-skus * ((days or 0) + 1) // CELLS))


def _w(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def lag_columns(target: str = "units_sold", lags=LAGS, key: str = "sku_id", order: str = "date"):
    w = _w(key, order)
    return [F.coalesce(F.lag(target, k).over(w), F.lit(0.0)).alias(f"lag_{k}") for k in lags]


def past_columns(offsets, target: str = "units_sold", key: str = "sku_id", order: str = "date"):
    """``_past_<k>``: the value ``k`` rows before; null where there is no such row or it has no value."""
    w = _w(key, order)
    return [F.lag(F.col(target).cast("double"), k).over(w).alias(f"_past_{k}") for k in offsets]


def rolling_stats(df: DataFrame, window: int = ROLL_WINDOW) -> DataFrame:
    """``df`` with stats over the ``window`` rows before the current one, from their ``past_columns``
    (the current row is excluded, so no leakage); at least one row, else 0.0; sample std.

    Every row before is read once a row; a moving frame would be aggregated anew from
    all its rows for every row. Oldest first, as a frame adds them."""
    past = [F.col(f"_past_{k}") for k in range(window, 0, -1)]
    n = reduce(add, [F.when(x.isNotNull(), 1).otherwise(0) for x in past])
    total = reduce(add, [F.coalesce(x, F.lit(0.0)) for x in past])
    df = df.select("*", n.alias("_n"), F.try_divide(total, n).alias("_mean"))
    squares = reduce(add, [F.coalesce((x - F.col("_mean")) * (x - F.col("_mean")), F.lit(0.0)) for x in past])
    both = [*past, past[0]]  # greatest and least want two
    stats = {"mean": F.col("_mean"), "std": F.when(F.col("_n") > 1, F.sqrt(F.try_divide(squares, F.col("_n") - 1))),
             "max": F.greatest(*both), "min": F.least(*both)}
    return df.select("*", *[F.coalesce(x, F.lit(0.0)).alias(f"rolling_{name}_{window}") for name, x in stats.items()]).drop("_n", "_mean")


def lag_features(df: DataFrame, target: str = "units_sold", lags=LAGS, key: str = "sku_id",
                 order: str = "date") -> DataFrame:
    return df.select("*", *lag_columns(target, lags, key, order))


def rolling_features(df: DataFrame, target: str = "units_sold", window: int = ROLL_WINDOW,
                     key: str = "sku_id", order: str = "date") -> DataFrame:
    out = rolling_stats(df.select("*", *past_columns(range(1, window + 1), target, key, order)), window)
    return out.drop(*[f"_past_{k}" for k in range(1, window + 1)]).select("*", *[F.col(f"rolling_{n}_{window}").alias(f"rolling_{n}") for n in ("mean", "std", "max", "min")])


def calendar_columns(date_col: str = "date"):
    d = F.col(date_col)
    return [F.weekday(d).alias("day_of_week"), F.weekofyear(d).alias("week_number"),
            F.month(d).alias("month"), F.quarter(d).alias("quarter"),
            (F.weekday(d) >= 5).cast("int").alias("weekend_flag")]


def calendar_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    """Monday = 0 day of week, ISO week, month, quarter, Sat/Sun flag."""
    return df.select("*", *calendar_columns(date_col))


def flag_columns(df: DataFrame):
    """Holiday from ``is_holiday`` else ``holiday_flag`` else 0; promo from
    ``promo_flag`` else ``promotion_flag`` else 0; ``promotion_flag`` alias."""
    cols = set(df.columns)
    hol = (F.col("is_holiday") if "is_holiday" in cols else
           F.col("holiday_flag") if "holiday_flag" in cols else F.lit(0)).cast("int")
    promo = (F.col("promo_flag") if "promo_flag" in cols else
             F.col("promotion_flag") if "promotion_flag" in cols else F.lit(0)).cast("int")
    return hol, promo


def daily_features(df: DataFrame, target: str = "units_sold", date_col: str = "date") -> DataFrame:
    """Lags, shifted rolling stats, calendar parts and flags; lags and stats share
    the offsets of one window (same partition / order), so one sort per
    partition."""
    hol, promo = flag_columns(df)
    keep = [c for c in df.columns if c not in ("holiday_flag", "promo_flag", "promotion_flag")]
    offsets = sorted({*LAGS, *range(1, ROLL_WINDOW + 1)})
    out = df.select(*keep, hol.alias("holiday_flag"), promo.alias("promo_flag"), *past_columns(offsets, target, order=date_col))
    out = rolling_stats(out)
    stats = ("mean", "std", "max", "min")
    return out.select(*keep, *[F.coalesce(f"_past_{k}", F.lit(0.0)).alias(f"lag_{k}") for k in LAGS],
                      *[f"rolling_{n}_{ROLL_WINDOW}" for n in stats],
                      *calendar_columns(date_col), "holiday_flag", "promo_flag",
                      *[F.col(f"rolling_{n}_{ROLL_WINDOW}").alias(f"rolling_{n}") for n in stats],
                      F.col("promo_flag").alias("promotion_flag"))
