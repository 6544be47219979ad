"""Findings of the first review: half-written tables, re-runs, rounding, trimming,
quantiles that depend on a plan, and the grid's exchanges."""

import numpy as np
from pyspark.sql import functions as F

from stockflow.functions.columns import fixed, rupees, title_case
from stockflow.operators import features
from stockflow.operators.profile import exact_quantiles
from stockflow.sources import files


def test_half_written_table_is_built_again(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    spark.range(3).write.parquet(path)
    import os
    os.remove(f"{path}/_SUCCESS")
    assert files.load_or_build(spark, path, lambda: spark.range(100)).count() == 100
    assert files.load_or_build(spark, path, lambda: spark.range(5)).count() == 100


def test_labels_round_halves_to_even(spark):
    row = spark.range(1).select(rupees(F.lit(112500.0)).alias("a"), rupees(F.lit(100500.0)).alias("b"), fixed(F.lit(12.25), 1).alias("c"),
                                rupees(F.lit(12345.4)).alias("d")).first()
    assert tuple(row) == ("₹1.12L", "₹1.00L", "12.2", "₹12,345")


def test_trim_takes_all_white_space(spark):
    df = spark.createDataFrame([("Kitchenware\t",), ("  kitchenware\r\n",)], "c string")
    assert {r.c for r in df.select(title_case("c").alias("c")).collect()} == {"Kitchenware"}


def test_quantiles_do_not_depend_on_exchange_reuse(spark):
    df = spark.range(0, 3_000_000, 1, 6).select(((F.col("id") * 7919) % 3_000_017).cast("double").alias("v"))
    want = np.quantile((np.arange(3_000_000, dtype=np.int64) * 7919 % 3_000_017).astype(float), [0.0, 0.25, 0.5, 0.75, 1.0])
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            row = exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0]).first()
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        assert row.n == 3_000_000 and np.allclose([row[f"q_{p}"] for p in (0, 25, 50, 75, 100)], want)


def test_the_exploded_grid_is_not_exchanged(spark):
    sku = spark.createDataFrame([(f"S{i}",) for i in range(9)], "sku_id string")
    sales = spark.createDataFrame([("S1", "2024-01-01", 1.0, 2.0, 2.0, 0), ("S2", "2024-02-01", 1.0, 2.0, 2.0, 0)],
                                  "sku_id string, date string, units_sold double, revenue double, unit_price double, promo_flag int") \
        .withColumn("date", F.to_date("date"))
    calendar = sales.select("date", F.lit(0).alias("is_holiday"))
    grid = features.daily_grid(sku, sales, calendar, num_partitions=7)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    generate = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above = [x for i, x in enumerate(lines[:generate]) if depth(x) < depth(lines[generate]) and all(depth(y) > depth(x) for y in lines[i + 1:generate + 1])]
    assert not any("Exchange hashpartitioning" in x for x in above), plan
    assert grid.count() == 9 * 32
