"""Readers that narrow stored tables to a universe and a period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLCV = ("Open", "High", "Low", "Close", "Volume")


def filter_universe(
    df: DataFrame, listing: DataFrame, predicate: str | Column | None = None,
    codes: Sequence[str] | DataFrame | None = None, code_col: str = "Code",
) -> DataFrame:
    """Keep rows of listed codes that satisfy ``predicate``; a predicate beats a code list."""
    if predicate is not None:
        wanted = listing.filter(predicate).select(F.col("Code").cast("string").alias(code_col))
        return df.join(wanted, code_col, "left_semi")
    if isinstance(codes, DataFrame):
        return df.join(codes.select(F.col("Code").cast("string").alias(code_col)), code_col, "left_semi")
    if codes is not None:
        return df.filter(F.col(code_col).isin([str(c) for c in codes]))
    return df


def until(df: DataFrame, end: dt.date | str, date_col: str = "Date") -> DataFrame:
    return df.filter(F.col(date_col) <= F.lit(str(end)).cast("date"))


def between(df: DataFrame, start: dt.date | str, end: dt.date | str, date_col: str = "Date") -> DataFrame:
    """Closed interval."""
    return df.filter(F.col(date_col).between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))


def rebase_prices(df: DataFrame, factor: str = "CumulativeAdjustmentFactor", columns: Sequence[str] = OHLCV) -> DataFrame:
    """Scale each code by its last known cumulative factor."""
    w = Window.partitionBy("Code").orderBy("Date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(factor, ignorenulls=True).over(w)
    out = df.withColumn("_last", last)
    return out.select(*[(F.col(c) * F.col("_last")).alias(c) if c in columns else F.col(c) for c in df.columns])


def read_prices(
    prices: DataFrame, listing: DataFrame, predicate: str | Column | None = None,
    codes: Sequence[str] | DataFrame | None = None, end: dt.date | str | None = None,
) -> DataFrame:
    """Universe filter, end date, rebase."""
    out = filter_universe(prices, listing, predicate, codes)
    return rebase_prices(until(out, end) if end is not None else out)


def catalogue_status(catalogue: DataFrame, series: DataFrame) -> DataFrame:
    """Per catalogued series: whether data exists, how much, and up to when."""
    seen = series.groupBy("Name").agg(F.count(F.lit(1)).alias("RecordCount"), F.max("Date").alias("LastDate"))
    return catalogue.join(seen, "Name", "left").select(
        "Name", "Group", "is_adopted",
        F.coalesce("RecordCount", F.lit(0).cast("long")).alias("RecordCount"), "LastDate",
        F.when(F.col("RecordCount").isNull(), "no file").otherwise("has data").alias("Status"),
    )
