"""File sources and sinks of the pipeline: header CSV scans with explicit
schemas and pandas-style missing-value tokens, required-input checks,
load-or-build of the clean layer, table / record sinks and the contracts of
the forecast outputs. Paths may be any Hadoop file system URI."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockflow.sources.adapters import as_scanned

S = T.StringType()

# Raw layer: every column that the cleaning coerces is read as text.
RAW_SCHEMAS = {
    "sales_daily": T.StructType([T.StructField(c, S) for c in
                                 ("date", "sku_id", "units_sold", "revenue", "unit_price", "promo_flag")]),
    "inventory_snapshots": T.StructType([T.StructField(c, S) for c in
                                         ("date", "sku_id", "on_hand_units", "on_order_units", "lead_time_days",
                                          "reorder_point")]),
    "calendar": T.StructType([T.StructField(c, S) for c in
                              ("date", "week", "month", "season", "is_holiday", "promo_event")]),
    "sku_master": T.StructType([T.StructField(c, S) for c in
                                ("sku_id", "category", "subcategory", "launch_date", "unit_cost", "list_price")]),
}

FORECAST_REQUIRED_COLUMNS = ["date", "sku_id", "actual_sales", "baseline_forecast", "ml_forecast",
                             "ml_upper_bound", "ml_lower_bound"]
METRICS_REQUIRED_KEYS = ["model", "baseline_wape", "ml_wape", "mae", "rmse", "bias", "improvement", "training_date"]
RUN_LOG_REQUIRED_KEYS = ["raw_sales_rows", "clean_sales_rows", "duplicate_sales_removed", "missing_sales_removed", "invalid_skus_removed",
                         "negative_values_removed", "revenue_consistency_corrected", "outliers_capped", "pipeline_status"]
FORECAST_CSV_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("sku_id", S)] +
                                   [T.StructField(c, T.DoubleType()) for c in FORECAST_REQUIRED_COLUMNS[2:]])
METRICS_SCHEMA = T.StructType([T.StructField("model", S)] +
                              [T.StructField(k, T.DoubleType()) for k in
                               ("baseline_wape", "ml_wape", "mae", "rmse", "bias", "improvement")] +
                              [T.StructField("training_date", S)])


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def table_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table folder was written to its end (its success marker is there)."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")


class ContractError(ValueError):
    """An input file that doesn't have the promised form."""


def require_inputs(spark: SparkSession, paths: dict[str, str]) -> None:
    """Fail before any scan, listing every missing input."""
    missing = [f"{p} ({name})" for name, p in paths.items() if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError("no input at: " + ", ".join(missing))


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with an explicit schema (no inference pass); the pandas NA
    tokens in text columns (``"None"`` included) become NULL."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return as_scanned(df)


def read_raw_tables(spark: SparkSession, data_dir: str):
    """The four raw tables of a folder (``<name>.csv``), checked first."""
    from stockflow.sources.adapters import RawTables
    paths = {n: f"{data_dir.rstrip('/')}/{n}.csv" for n in RAW_SCHEMAS}
    require_inputs(spark, paths)
    t = {n: read_csv_table(spark, p, RAW_SCHEMAS[n]) for n, p in paths.items()}
    return RawTables(sku_master=t["sku_master"], sales=t["sales_daily"], inventory=t["inventory_snapshots"],
                     calendar=t["calendar"])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite sink; CSV gets a header. No driver-side coalescing: every
    task writes its own part file."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


BUCKET_ROWS = 2_000_000   # rows of a bucket on average


def bucket_count(rows: int) -> int:
    """A power of two, so that tables of different size still join bucket by bucket."""
    n = 1
    while n * BUCKET_ROWS < rows:
        n *= 2
    return n


def write_bucketed(df: DataFrame, path: str, name: str, key: str, order: list[str], buckets: int) -> DataFrame:
    """Writes ``df`` at ``path`` in buckets of ``key``, rows of a bucket in ``order``, and registers it as
    table ``name``. A filter on one key then reads one bucket, and joins and aggregates by
    the key need no exchange. One file a bucket: the rows are exchanged once for it."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(*order) \
        .format("parquet").saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, name: str, key: str, order: list[str], buckets: int) -> DataFrame:
    """A bucketed table that another session has written at ``path``, registered again
    (the path alone doesn't say that it is bucketed)."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    spark.sql(f"CREATE TABLE `{name}` ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({', '.join(order)}) "
              f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the materialised table at ``path`` if it was written completely, else
    build it, write it (over what a lost writer left) and read the written copy."""
    if not table_complete(spark, path):
        write_table(build(), path)
    return spark.read.parquet(path)


def write_record(df: DataFrame, path: str) -> None:
    """One-row record (run log, metrics) as a JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_record(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A JSON record with all required keys: malformed JSON or a missing key
    raises ``ValueError`` naming the problem."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no record at {path}")
    try:
        raw = spark.read.option("mode", "FAILFAST").option("multiLine", True).json(path)
        cols = set(raw.columns)
        if "_corrupt_record" in cols:
            raise ValueError("corrupt record")
        raw.first()
    except Exception as e:  # noqa: BLE001
        raise ContractError(f"{path} is not a JSON record: {e}") from e
    missing = [k for k in required if k not in cols]
    if missing:
        raise ContractError(f"{path} lacks {', '.join(missing)}")
    return raw


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The cleaning job's run log, with its required counters."""
    return read_record(spark, path, RUN_LOG_REQUIRED_KEYS)


def read_metrics_record(spark: SparkSession, path: str) -> DataFrame:
    """Metrics JSON with the required-key contract, typed."""
    raw = read_record(spark, path, METRICS_REQUIRED_KEYS)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in METRICS_SCHEMA.fields])


def check_forecast_contract(df: DataFrame) -> DataFrame:
    """Required forecast columns present (``ValueError`` listing the absent
    ones); dates parsed strictly, so a malformed date fails the job."""
    missing = [c for c in FORECAST_REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ContractError(f"a forecast table needs the columns {', '.join(missing)}")
    if not isinstance(df.schema["date"].dataType, T.DateType):
        df = df.withColumn("date", F.to_date(F.col("date")))
    return df


def read_forecast_csv(spark: SparkSession, path: str, bad_path: str) -> tuple[DataFrame, int]:
    """A forecast table handed over as header CSV: the good rows, typed, and the number
    of bad records (cut lines, text where a number or a date belongs), which are
    written to ``bad_path`` as they were read, with the file they came from."""
    names = spark.read.option("header", True).csv(path).columns
    missing = [c for c in FORECAST_REQUIRED_COLUMNS if c not in names]
    if missing:
        raise ContractError(f"a forecast table needs the columns {', '.join(missing)}")
    typed = {f.name: f for f in FORECAST_CSV_SCHEMA.fields}
    schema = T.StructType([typed.get(c, T.StructField(c, S)) for c in names] + [T.StructField("_corrupt_record", S)])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)
    lost = F.col("_corrupt_record").isNotNull() | F.col("date").isNull() | F.col("sku_id").isNull()
    write_table(rows.filter(lost).select(F.coalesce("_corrupt_record", F.to_json(F.struct(*names))).alias("record"),
                                         F.col("_metadata.file_path").alias("file")), bad_path)
    return rows.filter(~lost).drop("_corrupt_record"), spark.read.parquet(bad_path).count()
