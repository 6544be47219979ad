"""Data-quality profile of any set of tables: shape, schema with non-null
counts, null counts, duplicate rows and a describe() with exact quartiles.

Shape, schema and null counts are one aggregate pass a table, all columns at
once, unpivoted afterwards. describe() unpivots first, so that all columns of
all tables are groups of the same three passes, however many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.operators.quantiles import keyed_quantiles, sketch
from stockflow.session import materialize

QUARTILES = [0.25, 0.5, 0.75]


def pandas_dtype(dt: T.DataType) -> str:
    """The dtype name a pandas reader would report for a Spark type."""
    if isinstance(dt, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float64"
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "int64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime64[ns]"
    return "object"


def read_dtype(dt: T.DataType, nulls: Column) -> Column:
    """``pandas_dtype`` of a column with that many nulls: integers and truth values have no
    null of their own there."""
    name = pandas_dtype(dt)
    other = {"int64": "float64", "bool": "object"}.get(name)
    return F.when(nulls > 0, other).otherwise(name) if other else F.lit(name)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def profile_shape(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
                     .select(F.lit(name).alias("table_name"), "n_rows",
                             F.lit(len(df.columns)).alias("n_columns"))
                   for name, df in tables.items()])


def _column_counts(name: str, df: DataFrame) -> DataFrame:
    """One pass: rows and non-null count of every column, unpivoted."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                                         read_dtype(df.schema[c].dataType, F.col("_n") - F.col(f"_c{i}")).alias("dtype"),
                                         F.col(f"_c{i}").alias("non_null")) for i, c in enumerate(cols)]))
    return agg.select(F.lit(name).alias("table_name"), F.col("_n").alias("n_rows"), stack.alias("s")).select(
        "table_name", "s.position", "s.column_name", "s.dtype",
        F.col("s.non_null").cast("bigint").alias("non_null"),
        (F.col("n_rows") - F.col("s.non_null")).cast("bigint").alias("null_count"))


def profile_schema(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([_column_counts(n, df) for n, df in tables.items()]).drop("null_count")


def profile_nulls(tables: dict[str, DataFrame]) -> DataFrame:
    return _union([_column_counts(n, df) for n, df in tables.items()]).select(
        "table_name", "column_name", "null_count")


def profile_duplicates(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that repeat an earlier row (nulls compare equal): n − distinct.
    The grouping aggregate merges copies map-side."""
    return _union([df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_k"))
                     .agg(F.coalesce(F.sum(F.col("_k") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
                     .select(F.lit(name).alias("table_name"), "duplicate_rows")
                   for name, df in tables.items()])


ACCURACY = 100_000  # of the sketches of describe()
TIME = "yyyy-MM-dd HH:mm:ss"


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """Exact linearly interpolated quantiles (pandas / NumPy default) of one column, in two
    scans. One row: ``n`` and ``q_<p>`` columns."""
    q = keyed_quantiles(df.select(F.lit(0).alias("all"), col), ["all"], col, probs, ACCURACY)
    one = q.unionByName(df.sparkSession.range(1).select(F.lit(0).alias("all")), allowMissingColumns=True)
    return one.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(f"q{i}").alias(f"q_{int(p * 100)}") for i, p in enumerate(probs)])


def kind_of(dt: T.DataType) -> str:
    """How describe() sees a column: number, time, or text for everything else."""
    if isinstance(dt, T.NumericType):
        return "number"
    return "time" if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "text"


def _as_number(df: DataFrame, c: str) -> Column:
    """Numbers as they are, times as seconds."""
    if kind_of(df.schema[c].dataType) == "number":
        return F.col(c).cast("double")
    if isinstance(df.schema[c].dataType, T.DateType):
        return F.unix_date(F.col(c)).cast("double") * 86400.0
    return F.unix_micros(F.col(c).cast("timestamp")).cast("double") / 1e6


def _unpivot(tables: dict[str, DataFrame], kinds: tuple[str, ...], value) -> DataFrame:
    """table_name, column_name, kind, v: a row per cell of the columns of these kinds, and a
    null for each such column, so that a column of an empty table counts as well."""
    parts, names = [], []
    for name, df in tables.items():
        cols = [c for c in df.columns if kind_of(df.schema[c].dataType) in kinds]
        if not cols:
            continue
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(kind_of(df.schema[c].dataType)).alias("k"), value(df, c).alias("v")) for c in cols])
        parts.append(df.select(F.explode(cells).alias("x")).select(
            F.lit(name).alias("table_name"), F.col("x.c").alias("column_name"), F.col("x.k").alias("kind"), F.col("x.v").alias("v")))
        names += [F.struct(F.lit(name), F.lit(c), F.lit(kind_of(df.schema[c].dataType))) for c in cols]
    spark = next(iter(tables.values())).sparkSession
    if not parts:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(c) for c in ("table_name", "column_name", "kind", "v")])
    none = spark.range(1).select(F.explode(F.array(*names)).alias("x")).select(
        F.col("x.col1").alias("table_name"), F.col("x.col2").alias("column_name"), F.col("x.col3").alias("kind"),
        F.lit(None).cast(parts[0].schema["v"].dataType).alias("v"))
    return _union([*parts, none])


def describe_numeric(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, kind, count, mean, std (ddof 1), min, p25, p50, p75, max of every
    number and time column (times in seconds), in two passes over all of them: one
    aggregate with a quantile sketch a column, one exact count around the quartiles."""
    keys = ["table_name", "column_name", "kind"]
    cells = _unpivot(tables, ("number", "time"), _as_number)
    v = F.col("v").cast("double")
    # At most one row a column; written once, as both the counts and the result read it.
    stats = materialize(cells.groupBy(*keys).agg(
        F.count(v).cast("bigint").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        F.max(v).alias("max"), sketch(v, QUARTILES, ACCURACY).alias("_edges")), "describe")
    q = keyed_quantiles(cells, keys, "v", QUARTILES, ACCURACY, edges=stats.filter("_edges IS NOT NULL").select(*keys, "_edges"))
    return stats.join(q.select(*keys, F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75")), keys, "left") \
        .select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe_text(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, kind, count, unique, top (most frequent; smallest on ties), freq
    of all other columns, in one pass. As the distinct values are counted exactly
    anyway, the most frequent one comes from the same counts."""
    keys = ["table_name", "column_name", "kind"]
    cells = _unpivot(tables, ("text",), lambda df, c: F.col(c).cast("string"))
    counts = cells.groupBy(*keys, "v").agg(F.count("v").alias("k"))
    return counts.groupBy(*keys).agg(
        F.sum("k").cast("bigint").alias("count"), F.count("v").cast("bigint").alias("unique"),
        F.min_by("v", F.when(F.col("v").isNotNull(), F.struct(-F.col("k"), F.col("v")))).alias("top"),
        F.max(F.when(F.col("v").isNotNull(), F.col("k"))).cast("bigint").alias("freq"))


def describe_all(tables: dict[str, DataFrame]) -> DataFrame:
    """describe(include="all") of every column of every table, a row a column. Numbers fill
    mean to max, times time_mean to time_max (as text, to the second), other columns unique,
    top and freq; std is that of numbers. Three passes over each table."""
    both = describe_numeric(tables).unionByName(describe_text(tables), allowMissingColumns=True)
    number, time = F.col("kind") == "number", F.col("kind") == "time"
    shown = ["mean", "min", "p25", "p50", "p75", "max"]
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")

    def as_time(c: str) -> Column:
        seconds = F.floor(F.col(c)).cast("decimal(18,6)")
        return F.date_format(epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds), TIME)

    return both.select("table_name", "column_name", "kind", "count", "unique", "top", "freq", *[F.when(number, F.col(c)).alias(c) for c in
                       ("mean", "std", "min", "p25", "p50", "p75", "max")], *[F.when(time, as_time(c)).alias(f"time_{c}") for c in shown])
