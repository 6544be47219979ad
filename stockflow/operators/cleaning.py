"""Cleaning and validation of the four raw tables (SKU master, calendar,
sales, inventory) with an audit of what each step removed or changed.

The sales pipeline is one annotated plan: every distinct raw row carries its
multiplicity and the first step that rejects it, so the clean table and the
audit counters are two projections of the same DataFrame instead of one
``count()`` per step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.functions.columns import clip_keep_null, nan_to_null, title_case
from stockflow.operators.quantiles import keyed_quantiles

SALES_COLS = ["date", "sku_id", "units_sold", "revenue", "unit_price", "promo_flag"]
INVENTORY_COLS = ["date", "sku_id", "on_hand_units", "on_order_units", "lead_time_days", "reorder_point"]

# Outlier rule: upper fence q3 + IQR_MULT * (q3 - q1), only for SKUs with more
# than MIN_ROWS_FOR_FENCE clean rows. Revenue rule: |rev - units*price| must not
# exceed REV_REL_TOL * units*price + REV_ABS_TOL.
IQR_MULT = 3.0
MIN_ROWS_FOR_FENCE = 4
REV_REL_TOL = 0.01
REV_ABS_TOL = 1.0


COUNTERS = ["raw_sales_rows", "clean_sales_rows", "duplicate_sales_removed", "missing_sales_removed", "invalid_skus_removed",
            "negative_values_removed", "revenue_consistency_corrected", "outliers_capped", "coercion_removed"]


@dataclass
class CleanTables:
    sku_master: DataFrame
    sales: DataFrame
    calendar: DataFrame
    inventory: DataFrame


def _num(c: str):
    """Lenient numeric coercion: anything not a number becomes NULL."""
    return nan_to_null(F.col(c).try_cast("double"))


def canonical(df: DataFrame, numbers: list[str]) -> DataFrame:
    """``df`` with number columns that were read as text in one spelling per value (``1``, ``1.0`` and
    ``01`` alike), so that rows compare by value; text that is no number stays."""
    def column(c: str):
        if c not in numbers or df.schema[c].dataType.typeName() != "string":
            return F.col(c)
        value = F.trim(c).try_cast("double")
        plain = value.isNotNull() & ~F.isnan(value)
        return F.when(plain, (value + F.lit(0.0)).cast("string")).otherwise(F.col(c)).alias(c)
    return df.select(*[column(c) for c in df.columns])


def parsed(df: DataFrame, numbers: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """What ``canonical`` compares, without writing numbers as text again: a number column that was
    read as text becomes its value, and text that is no number a column of its own (null
    elsewhere). Returns the frame and number column -> column of such text."""
    texts, cols = {}, []
    for c in df.columns:
        if c not in numbers or df.schema[c].dataType.typeName() != "string":
            cols.append(F.col(c))
            continue
        value = F.trim(c).try_cast("double")
        plain = value.isNotNull() & ~F.isnan(value)
        texts[c] = f"_text_{c}"
        cols += [F.when(plain, value + F.lit(0.0)).alias(c), F.when(~plain, F.col(c)).alias(texts[c])]
    return df.select(*cols), texts


def _whole(c: str):
    """A number, given as text or not, without its fraction; null where it is none."""
    return _num(c).try_cast("int")


def keep_first(df: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per ``key``: the first by ``order`` (default: all other columns).

    ``min_by`` over a struct is a partial aggregate, so duplicates collapse
    map-side and a key with many copies never lands whole in one task.
    """
    rest = [c for c in df.columns if c != key]
    order = order or rest
    picked = (df.groupBy(key)
                .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def parse_date(c: str):
    """Strict date parse: with ANSI on, malformed text raises."""
    return F.to_date(F.col(c))


def clean_sku_master(sku_raw: DataFrame) -> DataFrame:
    df = sku_raw.withColumn("launch_date", parse_date("launch_date"))
    df = keep_first(df, "sku_id").dropna(subset=["sku_id"])
    cols = []
    for c in df.columns:
        if c in ("unit_cost", "list_price"):
            cols.append(F.abs(_num(c)).alias(c))
        elif c in ("category", "subcategory"):
            cols.append(F.coalesce(title_case(F.col(c)), F.lit("Nan")).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def clean_calendar(cal_raw: DataFrame) -> DataFrame:
    df = cal_raw.withColumn("date", parse_date("date"))
    df = keep_first(df, "date").dropna(subset=["date"])
    return df.select(
        *[F.col(c) for c in df.columns if c not in ("week", "month", "is_holiday")],
        _whole("week").alias("week"),
        _whole("month").alias("month"),
        F.coalesce(_num("is_holiday"), F.lit(0.0)).cast("int").alias("is_holiday"),
    ).select(*df.columns)


def annotate_sales(sales_raw: DataFrame, sku_clean: DataFrame) -> DataFrame:
    """Distinct raw sales rows with ``n_copies`` and ``drop_reason`` (the first
    failing rule, in the reference order), coerced values and the
    revenue-consistency flag."""
    raw, texts = parsed(sales_raw.withColumn("date", parse_date("date")), ["units_sold", "revenue", "unit_price", "promo_flag"])
    # Whole-row DISTINCT with multiplicity (nulls compare equal, as in pandas). Nearly all rows
    # differ, so merging them before the shuffle would fill a hash map with a whole file split
    # and spill it. Rows are dealt by their values first and counted part by part; a given
    # number of parts isn't coalesced into ones whose map would spill.
    keys = [*SALES_COLS, *texts.values()]
    parts = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = raw.repartition(parts, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"))
    valid = sku_clean.select("sku_id").distinct().withColumn("_known", F.lit(True))
    d = d.join(valid, "sku_id", "left")
    units, rev, price = _num("units_sold"), _num("revenue"), _num("unit_price")

    def absent(c: str):
        return F.col(c).isNull() & F.col(texts[c]).isNull() if c in texts else F.col(c).isNull()
    missing = F.col("sku_id").isNull() | F.col("date").isNull() | absent("units_sold") | absent("revenue")
    d = d.select(
        "date", "sku_id", "n_copies", "_known", missing.alias("_missing"),
        units.alias("units_sold"), rev.alias("revenue"), price.alias("unit_price"),
        F.coalesce(_num("promo_flag"), F.lit(0.0)).cast("int").alias("promo_flag"),
    )
    reason = (F.when(F.col("_missing"), "missing")
               .when(F.col("units_sold").isNull() | F.col("revenue").isNull() | F.col("unit_price").isNull(),
                     "coercion")
               .when((F.col("units_sold") < 0) | (F.col("revenue") < 0) | (F.col("unit_price") < 0), "negative")
               .when(F.col("_known").isNull(), "invalid_sku"))
    expected = F.col("units_sold") * F.col("unit_price")
    mismatch = F.abs(F.col("revenue") - expected) > (REV_REL_TOL * expected + REV_ABS_TOL)
    return d.select(
        "date", "sku_id", "units_sold", "revenue", "unit_price", "promo_flag", "n_copies",
        reason.alias("drop_reason"),
    ).withColumn("revenue_corrected", F.when(F.col("drop_reason").isNull(), mismatch).otherwise(F.lit(False)))


def grouped_quantiles(df: DataFrame, key: str, col: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of ``col`` per ``key``: key, ``n``, ``q<i>``. A key
    with very many distinct values is never in one task (``keyed_quantiles``)."""
    return keyed_quantiles(df, [key], col, probs)


def outlier_fences(sales: DataFrame) -> DataFrame:
    """Per-SKU upper fence from exact linear quartiles, for SKUs with more than
    ``MIN_ROWS_FOR_FENCE`` rows (see ``grouped_quantiles`` for the plan)."""
    q = grouped_quantiles(sales, "sku_id", "units_sold", [0.25, 0.75]).filter(F.col("n") > MIN_ROWS_FOR_FENCE)
    return q.select("sku_id", F.col("q0").alias("q1"), F.col("q1").alias("q3"),
                    (F.col("q1") + IQR_MULT * (F.col("q1") - F.col("q0"))).alias("fence"))


def survivors(annotated: DataFrame) -> DataFrame:
    """Rows of ``annotate_sales`` that pass every rule, revenue fixed."""
    s = annotated.filter(F.col("drop_reason").isNull())
    expected = F.col("units_sold") * F.col("unit_price")
    return s.select("date", "sku_id", "units_sold",
                    F.when(F.col("revenue_corrected"), expected).otherwise(F.col("revenue")).alias("revenue"),
                    "unit_price", "promo_flag")


def cap_outliers(s: DataFrame) -> DataFrame:
    """Units above the SKU's fence are set to the fence, revenue recomputed
    and the row flagged. The fence table has one row per SKU and is joined
    back (broadcast by the planner when it is small)."""
    f = outlier_fences(s)
    s = s.join(f.select("sku_id", "fence"), "sku_id", "left")
    cap = F.coalesce(F.col("units_sold") > F.col("fence"), F.lit(False))
    return s.select(
        "date", "sku_id",
        F.when(cap, F.col("fence")).otherwise(F.col("units_sold")).alias("units_sold"),
        F.when(cap, F.col("fence") * F.col("unit_price")).otherwise(F.col("revenue")).alias("revenue"),
        "unit_price", "promo_flag",
        cap.alias("outlier_flag"),
    )


def finish_sales(annotated: DataFrame) -> DataFrame:
    """Survivors of ``annotate_sales`` with revenue fixed and outliers capped."""
    return cap_outliers(survivors(annotated))


def clean_sales(sales_raw: DataFrame, sku_clean: DataFrame) -> DataFrame:
    return finish_sales(annotate_sales(sales_raw, sku_clean))


def clean_inventory(inv_raw: DataFrame, sku_clean: DataFrame) -> DataFrame:
    df = canonical(inv_raw.withColumn("date", parse_date("date")),
                   ["on_hand_units", "on_order_units", "lead_time_days", "reorder_point"]).dropDuplicates()
    df = df.dropna(subset=["sku_id", "date"])
    df = df.join(sku_clean.select("sku_id").distinct(), "sku_id", "left_semi")
    return df.select(
        "date", "sku_id",
        clip_keep_null(F.coalesce(_num("on_hand_units"), F.lit(0.0)), lo=0.0).alias("on_hand_units"),
        clip_keep_null(F.coalesce(_num("on_order_units"), F.lit(0.0)), lo=0.0).alias("on_order_units"),
        clip_keep_null(F.coalesce(_num("lead_time_days"), F.lit(14.0)), lo=1.0).cast("int").alias("lead_time_days"),
        clip_keep_null(F.coalesce(_num("reorder_point"), F.lit(10.0)), lo=0.0).cast("int").alias("reorder_point"),
    )


def cleaning_audit(annotated: DataFrame, clean: DataFrame) -> DataFrame:
    """Run-log counters as one row (reference counters plus
    ``coercion_removed``, which the reference drops silently)."""
    a, c = annotated.agg(*annotated_counters()), clean.agg(*clean_counters())
    # Two one-row aggregates side by side: union them and fold with max.
    out = a.unionByName(c, allowMissingColumns=True)
    return audit_row(out.agg(*[F.max(x).alias(x) for x in out.columns]))


def annotated_counters() -> list:
    """Aggregates over ``annotate_sales``."""
    dropped = {"missing": "missing_sales_removed", "coercion": "coercion_removed", "negative": "negative_values_removed",
               "invalid_sku": "invalid_skus_removed"}
    return [F.sum("n_copies").cast("bigint").alias("raw_sales_rows"),
            (F.sum("n_copies") - F.count(F.lit(1))).cast("bigint").alias("duplicate_sales_removed"),
            *[F.count_if(F.col("drop_reason") == reason).cast("bigint").alias(name) for reason, name in dropped.items()],
            F.count_if(F.col("revenue_corrected")).cast("bigint").alias("revenue_consistency_corrected")]


def clean_counters() -> list:
    """Aggregates over the clean sales."""
    return [F.count(F.lit(1)).cast("bigint").alias("clean_sales_rows"),
            F.count_if("outlier_flag").cast("bigint").alias("outliers_capped")]


def observed_audit(spark: SparkSession, counters: dict) -> DataFrame:
    """The run-log row from counters that were observed while the tables were written. Of an
    empty table an observed sum is null, as that of an aggregate."""
    return audit_row(spark.range(1).select(*[F.lit(counters.get(x)).cast("bigint").alias(x) for x in COUNTERS]))


def audit_row(out: DataFrame) -> DataFrame:
    return out.select(
        *COUNTERS,
        (F.col("raw_sales_rows") - F.col("clean_sales_rows")).cast("bigint").alias("rows_dropped"),
        F.when(F.col("raw_sales_rows") > 0, F.col("clean_sales_rows") / F.col("raw_sales_rows"))
         .otherwise(F.lit(None).cast("double")).alias("retention_ratio"),
        F.lit("SUCCESS").alias("pipeline_status"),
    )


def clean_all(raw) -> CleanTables:
    """The four clean tables, in the order sku, sales, calendar, inventory."""
    sku = clean_sku_master(raw.sku_master)
    return CleanTables(
        sku_master=sku,
        sales=clean_sales(raw.sales, sku),
        calendar=clean_calendar(raw.calendar),
        inventory=clean_inventory(raw.inventory, sku),
    )
