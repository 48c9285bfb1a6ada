"""Aggregate expressions that stay null where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over rows with both values, null where a side does not vary.

    The built-in ``corr`` raises on a constant side in ANSI mode.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when(~flat, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
