"""Parquet and CSV scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), compression: str = "zstd") -> None:
    """Overwrite; the output committer makes the swap visible only when the job succeeds."""
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_panel(df: DataFrame, path: str, date_col: str = "Date") -> None:
    """Panel sink laid out by year, so a date filter prunes directories."""
    write_parquet(df.withColumn("Year", F.year(date_col)), path, partition_by=["Year"])


def write_by_sector(df: DataFrame, path: str, sector_col: str = "Sector") -> None:
    """One directory per sector instead of a dictionary of frames."""
    write_parquet(df.withColumn("_sector", F.col(sector_col)), path, partition_by=["_sector"])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Header CSV; a byte-order mark in front of the first column name is dropped."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("enforceSchema", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df.toDF(*[name.lstrip("﻿") for name in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv_after_marker(
    spark: SparkSession, path: str, columns: Sequence[str], marker: str, encoding: str = "shift_jis",
) -> DataFrame:
    """CSV files that open with free text: keep the records after the row whose first cell is ``marker``.

    Only the marker positions travel through a join.  Rows of a file are ordered
    by the split's offset, then by position inside the split, so a file may span
    several tasks.
    """
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(columns))])
    raw = (
        spark.read.option("encoding", encoding).option("mode", "PERMISSIVE").schema(schema).csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"),
                F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_row"))
    )
    starts = raw.filter(F.col("_0") == marker).groupBy("_file").agg(F.min("_row").alias("_start"))
    body = raw.join(starts, "_file").filter(F.col("_row") > F.col("_start"))
    return body.select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(columns)])


def normalise_vendor_series(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Vendor price export: first five columns by position, thousands separators stripped; ``keep`` columns pass through."""
    first = df.select(*df.columns[:5], *keep).toDF("Date", "Close", "Open", "High", "Low", *keep)
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("double").alias(c)
    return first.select(F.to_date("Date").alias("Date"), *[number(c) for c in ("Close", "Open", "High", "Low")], *keep)
