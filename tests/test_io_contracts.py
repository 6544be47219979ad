import json
import os

import pytest
from pyspark.sql import functions as F

from stockflow.sources import files


def test_require_inputs_lists_all_missing(spark, tmp_dir):
    with pytest.raises(FileNotFoundError) as e:
        files.require_inputs(spark, {"a": tmp_dir + "/a.csv", "b": tmp_dir + "/b.csv"})
    assert "a.csv (a)" in str(e.value) and "b.csv (b)" in str(e.value)


def test_csv_scan_nulls_na_tokens(spark, tmp_dir):
    p = os.path.join(tmp_dir, "calendar.csv")
    with open(p, "w") as f:
        f.write("date,week,month,season,is_holiday,promo_event\n2025-01-01,1,1,Winter,1,New Year\n"
                "2025-01-02,1,1,Winter,0,None\n")
    df = files.read_csv_table(spark, p, files.RAW_SCHEMAS["calendar"])
    assert [r.promo_event for r in df.orderBy("date").collect()] == ["New Year", None]


def test_load_or_build_builds_once(spark, tmp_dir):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)
    p = tmp_dir + "/t"
    assert files.load_or_build(spark, p, build).count() == 3
    assert files.load_or_build(spark, p, build).count() == 3
    assert len(calls) == 1


def test_metrics_contract(spark, tmp_dir):
    good = {"model": "m", "baseline_wape": 0.2, "ml_wape": 0.1, "mae": 1.0, "rmse": 2.0, "bias": 0.0,
            "improvement": 0.1, "training_date": "2026-01-01"}
    p = tmp_dir + "/good.json"
    with open(p, "w") as f:
        json.dump(good, f, indent=4)
    assert files.read_metrics_record(spark, p).first().ml_wape == 0.1
    bad = dict(good)
    bad.pop("rmse")
    q = tmp_dir + "/bad.json"
    with open(q, "w") as f:
        json.dump(bad, f)
    with pytest.raises(ValueError, match="rmse"):
        files.read_metrics_record(spark, q)
    r = tmp_dir + "/broken.json"
    with open(r, "w") as f:
        f.write("{not json")
    with pytest.raises(ValueError):
        files.read_metrics_record(spark, r)


def test_forecast_contract(spark):
    df = spark.createDataFrame([("2025-01-05", "A", 1.0)], "date string, sku_id string, actual_sales double")
    with pytest.raises(ValueError, match="baseline_forecast"):
        files.check_forecast_contract(df)
    ok = df.select("*", *[F.lit(0.0).alias(c) for c in ("baseline_forecast", "ml_forecast", "ml_upper_bound",
                                                          "ml_lower_bound")])
    assert str(files.check_forecast_contract(ok).schema["date"].dataType) == "DateType()"


def test_record_sink_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "SUCCESS")], "raw_sales_rows long, pipeline_status string")
    files.write_record(df, tmp_dir + "/log")
    assert spark.read.json(tmp_dir + "/log").first().pipeline_status == "SUCCESS"
