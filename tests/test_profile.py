"""describe() of all columns against pandas, and its number of passes."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest

from stockflow.operators import profile


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=int(i)) for i in rng.integers(0, 400, 500)]
    a = [(float(x) if x > 0.1 else None, int(y), d if y % 9 else None, s, bool(y % 2)) for x, y, d, s in
         zip(rng.normal(2, 1, 500), rng.integers(-5, 50, 500), days, rng.choice(["b", "a", "c", None], 500, p=[0.35, 0.35, 0.2, 0.1]))]
    made = {"a": spark.createDataFrame(a, "x double, n int, day date, name string, flag boolean"),
            "b": spark.createDataFrame([(1, None, None), (2, None, None)], "n long, none string, nothing double"),
            "empty": spark.createDataFrame([], "x double, s string, t timestamp")}
    out = {}
    for name, df in made.items():
        path = str(tmp_path_factory.mktemp(name) / name)
        df.write.parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def test_describe_equals_pandas(tables):
    rows = {(r.table_name, r.column_name): r for r in profile.describe_all(tables).collect()}
    assert set(rows) == {(t, c) for t, df in tables.items() for c in df.columns}
    p = tables["a"].toPandas()
    for c in ("x", "n"):
        want, r = p[c].describe(), rows["a", c]
        got = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        assert np.allclose(got, want.to_numpy(), rtol=1e-9) and r.kind == "number" and r.top is None and r.time_min is None
    day, r = pd.to_datetime(p["day"]).describe(), rows["a", "day"]
    assert [r["count"], *(r[f"time_{c}"] for c in ("mean", "min", "p25", "p50", "p75", "max"))] == [
        day["count"], *(str(day[c].floor("s"))[:19] for c in ("mean", "min", "25%", "50%", "75%", "max"))]
    r, counts = rows["a", "name"], p["name"].value_counts()
    assert (r["count"], r.unique, r.top, r.freq) == (p["name"].count(), 3, min(counts[counts == counts.max()].index), counts.max())
    assert rows["a", "flag"].unique == 2 and rows["a", "flag"].kind == "text"
    assert [rows["b", "none"][c] for c in ("count", "unique", "top", "freq")] == [0, 0, None, None]
    assert rows["b", "nothing"]["count"] == 0 and rows["b", "nothing"].p50 is None and rows["b", "n"].p50 == 1.5
    assert all(rows["empty", c]["count"] == 0 for c in ("x", "s", "t"))


def test_describe_takes_three_passes_and_no_subqueries(tables, monkeypatch):
    plans, write = [], profile.materialize

    def keep(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(profile, "materialize", keep)
    out = profile.describe_all(tables)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    text = "\n".join(plans)
    for name, df in tables.items():
        path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://") if df.inputFiles() else None
        assert path is None or len(re.findall(re.escape(path), text)) <= 3, name
    assert "ubquery" not in text and "CartesianProduct" not in text


def test_dtype_of_integers_with_nulls(spark):
    df = spark.createDataFrame([(1, 1, True), (None, 2, None)], "a int, b int, c boolean")
    got = {r.column_name: r.dtype for r in profile.profile_schema({"t": df}).collect()}
    assert got == {"a": "float64", "b": "int64", "c": "object"}
