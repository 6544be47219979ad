"""Scans of the driver's Parquet tables (one file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting ``columns`` here keeps ``ReadSchema`` narrow even
    before Catalyst's own pruning runs."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def fingerprint(spark: SparkSession, sf_dir: str, names: list[str]) -> tuple:
    """Every file of each table with its size and modification time: the identity of
    the input version, used to reuse tables derived from it."""
    sc = spark.sparkContext
    out = []
    for n in names:
        p = sc._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, n))
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        found, files = fs.listFiles(p, True), []
        while found.hasNext():
            f = found.next()
            files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        out.append((n, tuple(sorted(files))))
    return tuple(out)
