"""Checks on incoming series and outcome summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import windows as P

REQUIRED = ("Date", "Open", "Close", "High", "Low")


def missing_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> list[str]:
    return [c for c in required if c not in df.columns]


def integrity(series: DataFrame) -> DataFrame:
    """Per series: rows, repeated dates, price columns without a value, rows with High below Low."""
    prices = [c for c in REQUIRED[1:] if c in series.columns]
    bad = (F.col("High") < F.col("Low")).cast("long") if {"High", "Low"} <= set(prices) else F.lit(0)
    # Dates collapse first, so a repeated date never gathers in a distinct set.
    per_date = series.groupBy("Name", "Date").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(bad), F.lit(0)).alias("_bad"), *[F.count(c).alias(c) for c in prices])
    empty = sum(((F.sum(c) == 0).cast("int") for c in prices), F.lit(0))
    out = per_date.groupBy("Name").agg(
        F.sum("_n").alias("Rows"), (F.sum("_n") - F.count(F.lit(1))).alias("RepeatedDates"),
        empty.alias("EmptyColumns"), F.sum("_bad").alias("HighBelowLow"))
    return out.withColumn("Valid", (F.col("RepeatedDates") == 0) & (F.col("EmptyColumns") == 0) & (F.col("HighBelowLow") == 0))


def date_gaps(series: DataFrame, max_gap_days: int = 7) -> DataFrame:
    """Per series: number and largest size of gaps longer than ``max_gap_days``."""
    days = series.select("Name", "Date").distinct()
    gap = F.datediff(F.col("Date"), P.shift("Date", 1, "Name"))
    return days.withColumn("_gap", gap).filter(F.col("_gap") > max_gap_days).groupBy("Name").agg(
        F.count(F.lit(1)).alias("Gaps"), F.max("_gap").alias("LargestGap"))


def outcome_summary(results: DataFrame) -> DataFrame:
    """Total, successful and failed updates per group."""
    ok = F.sum(F.col("Success").cast("long"))
    return results.groupBy("Group").agg(
        F.count(F.lit(1)).alias("Total"), ok.alias("Succeeded"), (F.count(F.lit(1)) - ok).alias("Failed"))
