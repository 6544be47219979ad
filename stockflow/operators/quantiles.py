"""Exact quantiles of many keyed groups at once, of any size.

A first pass keeps one mergeable quantile sketch per key and takes from it a
lower and an upper edge around every position asked for. A second pass counts:
values on or between two edges of a position are counted value by value, all
others only by the gap that they lie in, so what is left of a key is a few gaps
and about ``6 / accuracy`` of its rows per position. Running counts over these few
find the order statistics exactly.

Neither pass gathers a key's rows or values: both are partial aggregates, and
the second is dealt by key, gap and value. Edges are attached through a salted
key, so the values of one key are spread over ``SALT`` join tasks unless the edges are
small enough for the planner to broadcast (a single value that is a large part of
all rows is left to the adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT = 32


def _edges(probs: list[float], accuracy: int) -> list[float]:
    """Ranks, as shares, just below and above each position. The sketch errs by one
    row in ``accuracy``; of few rows by none, so that positions lie at most one
    row outside, where the next value beyond an edge is known as well."""
    margin = 3.0 / accuracy
    return [min(1.0, max(0.0, p + s * margin)) for p in probs for s in (-1, 1)]


def sketch(col: Column, probs: list[float], accuracy: int) -> Column:
    """Aggregate: the lower and the upper edge of each position."""
    return F.percentile_approx(col, _edges(probs, accuracy), accuracy)


def keyed_quantiles(df: DataFrame, keys: list[str], col: str, probs: list[float], accuracy: int = 1000,
                    edges: DataFrame | None = None) -> DataFrame:
    """keys, ``n`` and ``q0``, ``q1``, ...: exact quantiles, interpolated linearly as pandas does,
    of the non-null values of every key that has any. ``edges`` (keys, ``_edges``): sketches
    already taken with another aggregate of the same rows."""
    rows = df.select(*keys, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if edges is None:
        edges = rows.groupBy(*keys).agg(sketch(F.col("_v"), probs, accuracy).alias("_edges"))
    names = {k: f"_of_{i}" for i, k in enumerate(keys)}
    salted = edges.select(*[F.col(k).alias(n) for k, n in names.items()], "_edges",
                          F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_of_salt"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALT)).cast("int"))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()] + [F.col("_salt") == F.col("_of_salt")]
    found = rows.join(salted, on)
    # A value's gap: the number of edges below it. On or between the two edges of a
    # position a value is counted by itself.
    v, e = F.col("_v"), [F.get("_edges", F.lit(i)) for i in range(2 * len(probs))]
    gap = sum(F.when(x < v, 1).otherwise(0) for x in e)
    inside = v.isin(*e)
    for x, y in zip(e[::2], e[1::2]):
        inside = inside | v.between(x, y)
    cells = found.select(*keys, v.alias("_v"), gap.alias("_gap"), F.when(inside, v).alias("_point")).groupBy(*keys, "_gap", "_point").agg(
        F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    w = Window.partitionBy(*keys)
    cells = cells.select(*keys, "_c", "_least", "_most", F.sum("_c").over(w).alias("_n"),
                         F.sum("_c").over(w.orderBy("_least").rowsBetween(Window.unboundedPreceding, 0)).alias("_end"))
    start, end, n = F.col("_end") - F.col("_c"), F.col("_end"), F.col("_n")

    def at(k: Column) -> Column:
        """The k-th value (from 0), known if it stands at a gap's end or the gap is one value."""
        known = F.when(k == start, F.col("_least")).when((k == end - 1) | (F.col("_least") == F.col("_most")), F.col("_most"))
        return F.max(F.when((start <= k) & (k < end), known))

    picks = []
    for i, p in enumerate(probs):
        k = F.floor(F.lit(p) * (n - 1))
        picks += [at(k).alias(f"_lo{i}"), at(k + 1).alias(f"_hi{i}"), F.max(F.lit(p) * (n - 1) - k).alias(f"_f{i}")]
    a = cells.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)
    out = []
    for i in range(len(probs)):
        lo, hi, f = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        missed = lo.isNull() | ((f > 0) & hi.isNull())
        out.append(F.when(missed, F.raise_error(F.lit("a quantile lies outside its edges")).cast("double"))
                   .otherwise(F.when(f > 0, lo + (hi - lo) * f).otherwise(lo)).alias(f"q{i}"))
    return a.select(*keys, "n", *out)
