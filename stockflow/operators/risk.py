"""Stockout / overstock risk scoring, money at stake and what-if scenarios.

Inputs are the clean tables. One projection evaluates every formula, so the
whole score is a single whole-stage-codegen span after two joins
(snapshot ⋈ SKU master, ⟕ demand rates).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.functions.columns import clip_keep_null, max0
from stockflow.operators.cleaning import keep_first

# Fixed values of the scoring model.
DEFAULT_RATE = 0.1            # weekly demand assumed for SKUs with no sale in a window
EPS = 1e-5
WEEKS_LONG, WEEKS_SHORT = 12, 4
LEAD_TIME_CAP_DAYS = 21.0
TREND_WEIGHT, TREND_CAP = 0.3, 0.4
W_DEFICIT, W_LEAD, W_TREND, W_PROMO = 0.55, 0.15, 0.15, 0.15
OVERSTOCK_LIMIT_WEEKS, OVERSTOCK_SCALE_WEEKS, EXCESS_WEEKS = 8.0, 16.0, 6.0
HIGH, LOW = 0.55, 0.45
PROMO_SENSITIVITY = {"Small Appliances": 0.25, "Furnishings": 0.2, "Home Decor": 0.15, "Kitchenware": 0.1}
PROMO_DEFAULT = 0.05
REORDER, MARKDOWN, WATCH, HEALTHY = "REORDER NOW", "MARKDOWN / CLEAR", "WATCH / VOLATILE", "HEALTHY"


@dataclass
class RiskParams:
    safety_stock_weeks: float = 1.5
    lead_time_override: bool = False
    lead_time_days: int = 14
    category: str = "All"
    promo_sensitivity: dict = field(default_factory=lambda: dict(PROMO_SENSITIVITY))


def latest_inventory(inventory: DataFrame) -> DataFrame:
    """Rows of the newest snapshot date (one global date, not per SKU), one per SKU:
    of several the first in the order of the columns. The max date is a scalar
    subquery: evaluated once, then a pushed-down filter."""
    last = inventory.select(F.max("date")).scalar()
    return keep_first(inventory.filter(F.col("date") == last), "sku_id")


def demand_rates(sales: DataFrame) -> DataFrame:
    """Average weekly units per SKU over the trailing 12 and 4 weeks (windows
    inclusive of both ends: 85 and 29 days), from the last sale date overall.

    NULL (not 0) when a SKU has no row in a window, so the default applies
    only to absent SKUs. One partial aggregate; the filter prunes row groups.
    """
    end = sales.select(F.max("date")).scalar()
    long_start = F.date_sub(end, 7 * WEEKS_LONG)
    short_start = F.date_sub(end, 7 * WEEKS_SHORT)
    recent = sales.filter((F.col("date") >= long_start) & (F.col("date") <= end))
    return recent.groupBy("sku_id").agg(
        (F.sum("units_sold") / float(WEEKS_LONG)).alias("rate_12w"),
        (F.sum(F.when(F.col("date") >= short_start, F.col("units_sold"))) / float(WEEKS_SHORT)).alias("rate_4w"),
    )


def attach_rates(df: DataFrame, sales: DataFrame) -> DataFrame:
    """Left join of the rates with the 0.1 default for SKUs without sales."""
    r = demand_rates(sales)
    out = df.join(r, "sku_id", "left")
    w12 = F.coalesce(F.col("rate_12w"), F.lit(DEFAULT_RATE))
    w4 = F.coalesce(F.col("rate_4w"), F.lit(DEFAULT_RATE))
    return out.withColumn("weekly_avg_sales", w12).withColumn("weekly_avg_sales_4w", w4) \
              .withColumn("sales_trend_multiplier", w4 / (w12 + EPS)).drop("rate_12w", "rate_4w")


def promo_exposure(category: Column, sensitivity: dict) -> Column:
    m = F.create_map(*[x for k, v in sensitivity.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(m, category), F.lit(PROMO_DEFAULT))


def score_columns(lead: Column, ss_weeks: Column, sensitivity: dict) -> list[Column]:
    """The formula chain as named columns, in output order. Expects
    on_hand_units, on_order_units, weekly_avg_sales, sales_trend_multiplier,
    category, list_price, unit_cost in scope."""
    w12 = F.col("weekly_avg_sales")
    ltd = w12 * (lead / 7.0)
    ss = w12 * ss_weeks
    rop = ltd + ss
    supply = F.col("on_hand_units") + F.col("on_order_units")
    deficit = clip_keep_null(1.0 - supply / (rop + EPS), 0.0, 1.0)
    lead_exp = clip_keep_null(lead / LEAD_TIME_CAP_DAYS, 0.0, 1.0)
    trend_exp = clip_keep_null((F.col("sales_trend_multiplier") - 1.0) * TREND_WEIGHT, 0.0, TREND_CAP)
    promo = promo_exposure(F.col("category"), sensitivity)
    stockout = clip_keep_null(W_DEFICIT * deficit + W_LEAD * lead_exp + W_TREND * trend_exp + W_PROMO * promo,
                              0.0, 1.0)
    overstock = clip_keep_null(F.col("on_hand_units") / (w12 * OVERSTOCK_SCALE_WEEKS + EPS), 0.0, 1.0)
    quadrant = (F.when((stockout > HIGH) & (overstock < LOW), REORDER)
                 .when((overstock > HIGH) & (stockout < LOW), MARKDOWN)
                 .when((stockout > HIGH) & (overstock > LOW), WATCH)
                 .otherwise(HEALTHY))
    short = max0(rop - supply)
    excess = max0(F.col("on_hand_units") - w12 * EXCESS_WEEKS)
    return [
        ltd.alias("lead_time_demand"), ss.alias("safety_stock"), rop.alias("reorder_point_calc"),
        supply.alias("current_supply"), deficit.alias("stock_deficit_factor"),
        lead_exp.alias("lead_time_exposure"), trend_exp.alias("trend_exposure"),
        promo.alias("promo_exposure"), stockout.alias("stockout_risk"),
        (w12 * OVERSTOCK_LIMIT_WEEKS).alias("overstock_limit"), overstock.alias("overstock_risk"),
        quadrant.alias("quadrant"), short.alias("units_short"),
        (short * F.col("list_price")).alias("sales_at_risk"),
        excess.alias("excess_units"), (excess * F.col("unit_cost")).alias("capital_locked"),
    ]


def risk_base(latest_inv: DataFrame, sku: DataFrame, sales: DataFrame, category: str = "All") -> DataFrame:
    """Snapshot ⋈ SKU master (inner), optional category filter, ⟕ demand rates.
    The sales end date is taken before the category filter."""
    df = latest_inv.join(sku, "sku_id", "inner")
    df = df.select("date", "sku_id", *[c for c in latest_inv.columns if c not in ("date", "sku_id")],
                   *[c for c in sku.columns if c != "sku_id"])
    if category != "All":
        df = df.filter(F.col("category") == category)
    return attach_rates(df, sales)


def risk_scores(latest_inv: DataFrame, sku: DataFrame, sales: DataFrame,
                params: RiskParams | None = None) -> DataFrame:
    """One row per SKU of the latest snapshot with all scores, the quadrant and
    the money at stake. An unknown category yields zero rows with the full
    schema."""
    p = params or RiskParams()
    base = risk_base(latest_inv, sku, sales, p.category)
    lead = F.lit(int(p.lead_time_days)) if p.lead_time_override else F.col("lead_time_days")
    base = base.withColumn("lead_time_days", lead.cast("int"))
    return base.select("*", *score_columns(F.col("lead_time_days"), F.lit(float(p.safety_stock_weeks)),
                                           p.promo_sensitivity))


def scenario_grid(lead_days: list[int | None], safety_weeks: list[float]) -> list[tuple[int | None, float]]:
    """Scenario list (lead-time override or None for the SKU's own, safety
    stock weeks); a small driver-side parameter, never data."""
    return [(lt, float(ss)) for lt in lead_days for ss in safety_weeks]


def risk_scenarios(latest_inv: DataFrame, sku: DataFrame, sales: DataFrame,
                   scenarios: list[tuple[int | None, float]], category: str = "All",
                   sensitivity: dict | None = None) -> DataFrame:
    """Risk of every SKU under every what-if scenario in one job.

    The scenario list is a parameter of bounded length, attached to each SKU
    row by a generator (``explode`` of a literal array), so no join and no
    shuffle is added: rows = SKUs × scenarios by definition of the report.
    """
    base = risk_base(latest_inv, sku, sales, category)
    arr = F.array(*[F.struct(F.lit(i).alias("scenario_id"),
                             F.lit(lt).cast("int").alias("lead_override"),
                             F.lit(ss).cast("double").alias("safety_stock_weeks"))
                    for i, (lt, ss) in enumerate(scenarios)])
    x = base.select("*", F.explode(arr).alias("_s")).select("*", "_s.*").drop("_s")
    x = x.withColumn("lead_time_days", F.coalesce(F.col("lead_override"), F.col("lead_time_days")).cast("int"))
    return x.select("*", *score_columns(F.col("lead_time_days"), F.col("safety_stock_weeks"),
                                        sensitivity or PROMO_SENSITIVITY))
