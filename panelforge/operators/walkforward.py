"""Linear models refitted every month on the past alone, from sums that are made once.

A month's rows of a sector become one row of sums of products. A refit needs the sums before its month, which is one running total, or
the difference of two where the model looks back a limited number of months; no row is read twice however often models are refitted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["Date", "Sector"]
#: Squared share of a feature's variance that others leave unexplained, below which a model counts as singular.
SINGULAR = 1e-10


def month_number(date: str = "Date") -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def _products(columns: Sequence[str]) -> list[tuple[int, int]]:
    """Places of (1, columns..) whose products are summed, the upper triangle by rows."""
    k = len(columns) + 1
    return [(i, j) for i in range(k) for j in range(i, k)]


def monthly_moments(target: DataFrame, features: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``Sector, Month, s0, s1, ..``: sums of products of (1, features.., Target) over a month's complete rows.

    A sector has a row for every month in which it has features, also where no row is complete. Columns should lie around zero, as
    returns do; scale others first. The sums are partial aggregates, so no task holds a sector's rows.
    """
    names = [*columns, "Target"]
    rows = features.select(*KEYS, *columns).join(target.select(*KEYS, "Target"), KEYS, "left")
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    terms = [F.lit(1.0), *[F.when(whole, F.col(c).cast("double")).otherwise(0.0) for c in names]]
    terms[0] = F.when(whole, 1.0).otherwise(0.0)
    sums = [F.sum(terms[i] if i == 0 and j == 0 else terms[j] if i == 0 else terms[i] * terms[j]).alias(f"s{n}") for n, (i, j) in enumerate(_products(names))]
    return rows.groupBy("Sector", month_number().alias("Month")).agg(*sums)


def past_moments(moments: DataFrame, months: int | None = None) -> DataFrame:
    """The sums over all months before each row's month, or over so many of them.

    The window holds a row for every month of a sector.
    """
    by = Window.partitionBy("Sector").orderBy("Month")
    names = [c for c in moments.columns if c not in ("Sector", "Month")]
    before, long_before = by.rangeBetween(Window.unboundedPreceding, -1), by.rangeBetween(Window.unboundedPreceding, -(months or 0) - 1)

    def total(c: str) -> Column:
        all_of_it = F.coalesce(F.sum(c).over(before), F.lit(0.0))
        return all_of_it if months is None else all_of_it - F.coalesce(F.sum(c).over(long_before), F.lit(0.0))
    return moments.select("Sector", "Month", *[total(c).alias(c) for c in names])


def solve_moments(sums: np.ndarray, k: int) -> np.ndarray:
    """Intercept and ``k`` coefficients by least squares for every row of sums; a singular model has its mean alone."""
    size = k + 2
    m = np.zeros((len(sums), size, size))
    upper = np.triu_indices(size)
    m[:, upper[0], upper[1]] = m[:, upper[1], upper[0]] = sums
    n = np.maximum(m[:, 0, 0], 1.0)
    mean = m[:, 0, 1:] / n[:, None]
    cov = m[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    xx, xy = cov[:, :k, :k], cov[:, :k, k]
    out = np.zeros((len(sums), k + 1))
    out[:, 0] = mean[:, k]
    scale = np.sqrt(np.clip(np.einsum("rii->ri", xx), 0, None))
    fit = (scale > 0).all(axis=1)
    unit = xx[fit] / (scale[fit][:, :, None] * scale[fit][:, None, :])
    regular = np.linalg.det(unit) > SINGULAR
    at = np.flatnonzero(fit)[regular]
    coef = np.linalg.solve(unit[regular], (xy[at] / scale[at])[:, :, None])[:, :, 0] / scale[at]
    out[at, 1:] = coef
    out[at, 0] -= (coef * mean[at, :k]).sum(axis=1)
    return out


def walk_forward_models(target: DataFrame, features: DataFrame, columns: Sequence[str], months: int | None = None, min_rows: int = 60) -> DataFrame:
    """``Sector, Month, Rows, Coef`` (intercept first): the model for each month, from the months before it.

    Models with fewer rows than ``min_rows`` are left out. A model whose features are linearly dependent has its mean alone.
    """
    k, names = len(columns), [f"s{i}" for i in range(len(_products([*columns, "Target"])))]
    past = past_moments(monthly_moments(target, features, columns), months).filter(F.col("s0") >= min_rows - 0.5)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[["Sector", "Month"]].copy()
            out["Rows"] = frame["s0"].round().astype("int64")
            out["Coef"] = list(solve_moments(frame[names].to_numpy(), k))
            yield out
    return past.mapInPandas(solve, "Sector string, Month int, Rows long, Coef array<double>")


def walk_forward_predictions(target: DataFrame, features: DataFrame, columns: Sequence[str], months: int | None = None, min_rows: int = 60) -> DataFrame:
    """``Date, Sector, Pred`` for every row of ``features``; null where a feature is, or where the past holds too few rows."""
    models = walk_forward_models(target, features, columns, months, min_rows).select("Sector", F.col("Month").alias("_month"), "Coef")
    rows = features.select(*KEYS, *columns).withColumn("_month", month_number()).join(models, ["Sector", "_month"], "left")
    total = F.get("Coef", 0)
    for i, c in enumerate(columns):
        total = total + F.col(c) * F.get("Coef", i + 1)
    return rows.select(*KEYS, total.alias("Pred"))
