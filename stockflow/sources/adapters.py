"""Retail-shaped raw inputs derived from the TPC-H-like driver tables.

The domain has four raw tables (SKU master, daily sales, weekly inventory
snapshots, calendar). The driver ships lineitem / supplier instead, so:

* a **SKU** is a supplier (``SKU_00042``), its category from ``s_suppkey % 5``;
* a **sale** is a lineitem on its ship date, units = quantity, unit price =
  extended price / quantity, promo = discount >= 8 %;
* **inventory** is 8 weekly Sunday snapshots per SKU ending the Sunday before
  the last sales week;
* the **calendar** spans the sales dates.

Dirt (duplicates, repeated SKUs, dates and snapshots, nulls, text for numbers,
negatives, unknown SKUs, revenue mismatches, spikes, mis-cased / padded categories,
negative cost) is injected by deterministic modular predicates on the keys so the
cleaning steps have work to do. The same
definitions exist as SQL in ``stockflow.plans.oracle`` for the DuckDB oracle.
Everything is a projection / generator over the scans: work grows with the
tables and nothing passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.functions.columns import null_if_na_token
from stockflow.sources.tables import read_table

# Category names by s_suppkey % 5.
CATEGORIES = ["Small Appliances", "Furnishings", "Home Decor", "Kitchenware", "Décor"]
INVENTORY_WEEKS = 8


@dataclass
class RawTables:
    sku_master: DataFrame
    sales: DataFrame
    inventory: DataFrame
    calendar: DataFrame


def sku_code(key: Column) -> Column:
    return F.concat(F.lit("SKU_"), F.lpad(key.cast("string"), 5, "0"))


def _copies(which: dict[int, Column]) -> Column:
    """The numbers of a row's copies: 0, and every other one whose condition holds."""
    return F.explode(F.filter(F.array(F.lit(0), *[F.when(cond, F.lit(i)) for i, cond in which.items()]), lambda x: x.isNotNull()))


def sku_master_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier; some SKUs stand twice with different attributes (copy 1), and
    some rows once more without their code (copy 2)."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    k = F.col("s_suppkey")
    cat = F.lit(CATEGORIES[4])
    for i in (3, 2, 1, 0):
        cat = F.when(k % 5 == i, F.lit(CATEGORIES[i])).otherwise(cat)
    base = (F.lit(100) + (k * 37) % 900).cast("double")
    copy = F.col("_copy")
    s = s.select("*", _copies({1: k % 50 == 9, 2: k % 100 == 99}).alias("_copy"))
    return s.select(
        F.when(copy != 2, sku_code(k)).alias("sku_id"),
        F.when(k % 10 == 3, F.lower(cat)).when(k % 10 == 6, F.concat(cat, F.lit(" "))).otherwise(cat).alias("category"),
        F.concat(F.lit("sub "), ((k + copy * 3) % 7).cast("string")).alias("subcategory"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k % 365).cast("int")).alias("launch_date"),
        (base * F.when(k % 25 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))).alias("unit_cost"),
        (base * F.lit(1.6) + copy).alias("list_price"),
    )


def _sales_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate"])
    o, q = F.col("l_orderkey"), F.col("l_quantity")
    return li.select(
        o,
        F.col("l_shipdate").cast("date").alias("date"),
        F.when(o % 997 == 1, F.lit("SKU_BAD")).otherwise(sku_code(F.col("l_suppkey"))).alias("sku_id"),
        F.when(o % 125 == 3, F.lit(None).cast("double"))
         .when(o % 333 == 5, -q)
         .when(o % 211 == 7, q * 40)
         .otherwise(q).alias("units_sold"),
        (F.col("l_extendedprice") / q).alias("unit_price"),
        F.when(F.col("l_discount") >= 0.08, 1).otherwise(0).alias("promo_flag"),
    )


def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per lineitem plus exact copies of the rows of every 500th order."""
    b = _sales_base(spark, sf_dir)
    rev = F.when(F.col("l_orderkey") % 170 == 9, F.col("units_sold") * F.col("unit_price") * 1.5) \
           .otherwise(F.col("units_sold") * F.col("unit_price"))
    cols = [F.col("date"), F.col("sku_id"), F.col("units_sold"), rev.alias("revenue"),
            F.col("unit_price"), F.col("promo_flag")]
    # The copies are generated (explode) rather than a second scan + union.
    copies = F.when(F.col("l_orderkey") % 500 == 11, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return b.select(*cols, F.explode(copies).alias("_copy")).drop("_copy")


def inventory_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly snapshots: for every supplier the 8 Sundays ending the Sunday
    before the week of the last ship date. Lead times are text; some rows stand twice with
    the same lead time in another spelling (copy 1), some SKUs twice in the latest snapshot
    with different stock on order (copy 2)."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    last = read_table(spark, sf_dir, "lineitem", ["l_shipdate"]) \
        .select(F.max(F.col("l_shipdate").cast("date"))).scalar()
    latest = F.date_sub(F.date_trunc("week", last).cast("date"), 1)
    k, w, copy = F.col("s_suppkey"), F.col("_k"), F.col("_copy")
    return (s.select(k, F.explode(F.sequence(F.lit(0), F.lit(INVENTORY_WEEKS - 1))).alias("_k"))
             .select("*", _copies({1: k % 20 == 5, 2: (k % 60 == 17) & (w == 0)}).alias("_copy"))
             .select(
                 F.date_sub(latest, (w * 7).cast("int")).alias("date"),
                 sku_code(k).alias("sku_id"),
                 F.when(k % 31 == 4, F.lit(None).cast("double"))
                  .when(k % 41 == 6, F.lit(-5.0))
                  .otherwise(((k * 53 + w * 17) % 600).cast("double")).alias("on_hand_units"),
                 ((k * 29 + w) % 90 + F.when(copy == 2, 10).otherwise(0)).cast("double").alias("on_order_units"),
                 F.when(k % 37 == 8, F.lit(None).cast("string")).when(k % 43 == 2, F.lit("two weeks"))
                  .otherwise(F.concat((F.lit(7) * (F.lit(1) + k % 3)).cast("string"),
                                      F.when(copy == 1, ".0").otherwise(""))).alias("lead_time_days"),
                 (F.lit(10) + k % 40).cast("int").alias("reorder_point"),
             ))


def calendar_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per day between the first and last ship date; the 13th and the 20th of a month
    stand twice, with another holiday flag and another season."""
    li = read_table(spark, sf_dir, "lineitem", ["l_shipdate"])
    d = li.select(F.min(F.col("l_shipdate").cast("date")).alias("d0"),
                  F.max(F.col("l_shipdate").cast("date")).alias("d1"))
    day = F.col("date")
    # The last Friday of a quarter is a holiday with a closing sale.
    closing = (F.month(day) % 3 == 0) & (F.dayofweek(day) == 6) & (F.dayofmonth(F.last_day(day)) - F.dayofmonth(day) < 7)
    promo = F.when(closing, F.concat(F.lit("Closing Q"), F.quarter(day).cast("string"))).otherwise("None")
    copy = F.col("_copy")
    return (d.select(F.explode(F.sequence("d0", "d1")).alias("date"))
             .select(day, _copies({1: F.dayofmonth(day) == 13, 2: F.dayofmonth(day) == 20}).alias("_copy"))
             .select(
                 day,
                 F.weekofyear(day).cast("int").alias("week"),
                 F.month(day).cast("int").alias("month"),
                 F.when(copy == 2, "Again").when(F.month(day).isin(12, 1, 2), "Winter").when(F.month(day).isin(3, 4, 5), "Spring")
                  .when(F.month(day).isin(6, 7, 8), "Summer").otherwise("Autumn").alias("season"),
                 F.when(closing | (copy == 1), 1).otherwise(0).alias("is_holiday"),
                 promo.alias("promo_event"),
             ))


def as_scanned(df: DataFrame) -> DataFrame:
    """What a pandas CSV read would hand over: NA text tokens in string
    columns become NULL (the text ``"None"`` included)."""
    return df.select(*[null_if_na_token(f.name).alias(f.name) if f.dataType.typeName() == "string"
                       else F.col(f.name) for f in df.schema.fields])


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    return RawTables(
        sku_master=as_scanned(sku_master_raw(spark, sf_dir)),
        sales=as_scanned(sales_raw(spark, sf_dir)),
        inventory=as_scanned(inventory_raw(spark, sf_dir)),
        calendar=as_scanned(calendar_raw(spark, sf_dir)),
    )
