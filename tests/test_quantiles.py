"""Distributed exact quantiles against NumPy's linear interpolation."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockflow.operators import quantiles
from stockflow.operators.cleaning import grouped_quantiles
from stockflow.operators.profile import exact_quantiles
from stockflow.operators.quantiles import keyed_quantiles

PROBS = [0.25, 0.5, 0.75]


def test_exact_quantiles_match_numpy_across_partitions(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 50, 3000), rng.normal(100, 30, 2000).round(3), [1e6]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        row = exact_quantiles(df, "x", PROBS).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert row.n == len(vals)
    for p in PROBS:
        assert np.isclose(row[f"q_{int(p * 100)}"], np.quantile(vals, p), rtol=0, atol=1e-9)


def test_grouped_quantiles_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 20, 4000)]          # a third-plus of all rows
    rows += [(f"k{i % 50}", float(v)) for i, v in enumerate(rng.integers(0, 100, 6000))]
    rows += [("tiny", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r for r in grouped_quantiles(df, "k", "v", PROBS).collect()}
    by_key = {}
    for k, v in rows:
        by_key.setdefault(k, []).append(v)
    for k, vs in by_key.items():
        assert got[k].n == len(vs)
        for i, p in enumerate(PROBS):
            assert np.isclose(got[k][f"q{i}"], np.quantile(vs, p), rtol=0, atol=1e-9), (k, p)
    assert got["tiny"].q0 == 5.0 and got["tiny"].q2 == 5.0
    assert df.filter(F.col("k") == "hot").count() == 4000


def test_keyed_quantiles_of_many_shapes(spark):
    """Rank positions, ties at an edge, few rows and brackets that leave most rows out."""
    rng = np.random.default_rng(11)
    groups = {"one": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 999 + [7.0], "steps": sorted(list(range(10)) * 400),
              "wide": rng.normal(0, 1, 20_000), "edge": [0.0] * 2500 + [1.0] * 2500 + [2.0] * 5000, "neg": -rng.random(3001)}
    groups |= {f"n{n}": rng.integers(0, 6, n) for n in range(3, 40)}
    rows = [(k, None if i % 7 == 9 else float(v)) for k, vs in groups.items() for i, v in enumerate(vs)] + [("null", None), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for accuracy in (20, 1000):
        got = {r.k: r for r in keyed_quantiles(df, ["k"], "v", probs, accuracy).collect()}
        assert set(got) == set(groups) | {None} and got[None].q3 == 4.0
        for k, vs in groups.items():
            for i, p in enumerate(probs):
                assert np.isclose(got[k][f"q{i}"], np.quantile(vs, p), rtol=1e-12, atol=1e-9), (k, p, accuracy)


def test_keyed_quantiles_keep_little_of_a_hot_key(spark, monkeypatch):
    """100,000 different values of one key: what its window sees is some 6 / accuracy of them a position."""
    df = spark.range(100_000).select(F.lit("hot").alias("k"), F.col("id").cast("double").alias("v"))
    seen = []
    over = Window.partitionBy

    def partition_by(*cols):
        seen.append(cols)
        return over(*cols)

    monkeypatch.setattr(quantiles.Window, "partitionBy", staticmethod(partition_by))
    r = keyed_quantiles(df, ["k"], "v", [0.25, 0.75], 1000).first()
    assert (r.q0, r.q1, r.n) == (24999.75, 74999.25, 100_000) and seen == [("k",)]
    edges = df.groupBy("k").agg(quantiles.sketch(F.col("v"), [0.25, 0.75], 1000).alias("e")).first().e
    kept = sum(df.filter(F.col("v").between(a, b)).count() for a, b in zip(edges[::2], edges[1::2]))
    assert kept <= 2 * 10 / 1000 * 100_000
