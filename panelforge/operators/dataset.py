"""Leak-free train and test sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.readers import between

KEYS = ["Date", "Sector"]


def append_next_day(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """One empty row per sector on the first calendar day after the panel."""
    last = panel.agg(F.max("Date"))
    following = calendar.filter(F.col("Date") > last.scalar()).agg(F.min("Date").alias("Date"))
    rows = panel.select("Sector").distinct().withColumn("Date", following.scalar()).filter(F.col("Date").isNotNull())
    return panel.unionByName(rows, allowMissingColumns=True)


def lag_features(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Yesterday's features on today's row; ``keep`` columns stay on their day."""
    w = Window.partitionBy("Sector").orderBy("Date")
    return features.select(*[
        F.col(c) if c in KEYS or c in keep else F.lag(c).over(w).alias(c) for c in features.columns])


def align(features: DataFrame, target: DataFrame) -> DataFrame:
    return features.join(target.select(*KEYS).distinct(), KEYS, "left_semi")


def drop_outliers(target: DataFrame, width: float) -> DataFrame:
    """Rows within ``width`` sample deviations of their sector's mean.

    The bounds come from a pre-aggregated join, not from a window that would hold a
    sector's rows in one task.
    """
    bounds = target.groupBy("Sector").agg(F.avg("Target").alias("_m"), F.stddev_samp("Target").alias("_s"))
    inside = F.col("Target").between(F.col("_m") - F.col("_s") * width, F.col("_m") + F.col("_s") * width)
    return target.join(bounds, "Sector").filter(inside).select(*target.columns)


@dataclass(frozen=True)
class TrainTest:
    target_train: DataFrame
    target_test: DataFrame
    features_train: DataFrame
    features_test: DataFrame


def train_test(
    target: DataFrame, features: DataFrame, train: tuple[str, str], test: tuple[str, str],
    calendar: DataFrame | None = None, outlier_width: float = 0.0, keep: Sequence[str] = (), reuse_features: bool = False,
) -> TrainTest:
    """Next-day row, lag, alignment, split, outliers, in that order."""
    if calendar is not None:
        target = append_next_day(target, calendar)
        if not reuse_features:
            features = append_next_day(features, calendar)
    features = align(lag_features(features, keep), target)
    target_train, features_train = between(target, *train), between(features, *train)
    if outlier_width:
        target_train = drop_outliers(target_train, outlier_width)
        features_train = align(features_train, target_train)
    return TrainTest(target_train, between(target, *test), features_train, between(features, *test))


def append_model_output(features: DataFrame, predictions: DataFrame, name: str) -> DataFrame:
    """Another model's prediction as a feature of the same day."""
    return features.join(predictions.select(*KEYS, F.col("Pred").alias(name)), KEYS, "left")


def raw_returns_with_predictions(raw: DataFrame, predictions: DataFrame, start: str, end: str) -> DataFrame:
    """Raw targets of every predicted row in a period."""
    joined = predictions.select(*KEYS, "Pred").join(raw, KEYS, "left")
    return between(joined, start, end)


def one_hot(df: DataFrame, names: Sequence[str], column: str = "Sector") -> DataFrame:
    """Indicator columns for a known list of names."""
    return df.select("*", *[(F.col(column) == n).cast("int").alias(f"{column}_{n}") for n in names])

