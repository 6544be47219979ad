"""Forecast error metrics as one aggregate (optionally per group)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forecast_metrics(df: DataFrame, actual: str = "actual_sales", forecast: str = "forecast",
                     by: list[str] | None = None) -> DataFrame:
    """WAPE, MAE, RMSE and signed bias; ratios are 0 when Σ actual ≤ 0.
    NULL metrics (not an error) on an empty input."""
    err = F.col(forecast) - F.col(actual)
    g = df.groupBy(*by) if by else df
    m = g.agg(F.sum(F.abs(err)).alias("_abs"), F.sum(actual).alias("_act"), F.sum(err).alias("_err"),
              F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("_mse"), F.count(F.lit(1)).alias("n"))
    pos = F.col("_act") > 0
    return m.select(*(by or []),
                    F.when(pos, F.col("_abs") / F.col("_act")).when(F.col("n") > 0, F.lit(0.0)).alias("wape"),
                    F.col("mae"), F.sqrt("_mse").alias("rmse"),
                    F.when(pos, F.col("_err") / F.col("_act")).when(F.col("n") > 0, F.lit(0.0)).alias("bias"),
                    F.col("n").cast("bigint").alias("n_rows"))
