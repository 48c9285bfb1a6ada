"""Small dense matrices from distributed rows.

Only a k x k matrix reaches the driver; k is the number of columns or sectors and
is checked against ``MAX_DIM``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DIM = 2000
#: Numbers a task holds in partial sums.
HELD = 1 << 24


def check_dim(k: int) -> int:
    if k > MAX_DIM:
        raise ValueError(f"{k} columns: the driver-side solve is meant for at most {MAX_DIM}")
    return k


def column_array(columns: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])


def gram(df: DataFrame, array_col: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Sum of x xT over the rows, upper triangle in long form ``(by.., i, j, value)`` with i <= j.

    A task adds up one matrix per key over all its batches and emits each once (earlier
    when the matrices held pass ``HELD`` numbers); the partial sums meet in a hash aggregate.
    """
    check_dim(k)
    keys = list(by)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(k)
        ii, jj = (pa.array(m.astype("int32")) for m in upper)
        held: dict[tuple, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for key, total in held.items():
                cols = [pa.array([v] * len(ii)) for v in key] + [ii, jj, pa.array(total[upper])]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, "i", "j", "value"])
            held.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            pdf = batch.to_pandas()
            groups = pdf.groupby(keys, sort=False, dropna=False) if keys else [((), pdf)]
            for key, part in groups:
                x = np.stack(part[array_col].to_numpy())
                key = key if isinstance(key, tuple) else (key,)
                held[key] = held[key] + x.T @ x if key in held else x.T @ x
            if len(held) * k * k > HELD:
                yield from emit()
        yield from emit()

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys] + ["i int", "j int", "value double"])
    rows = df.select(*keys, array_col).filter(F.col(array_col).isNotNull())
    return rows.mapInArrow(partial, schema).groupBy(*keys, "i", "j").agg(F.sum("value").alias("value"))


def masked_grams(df: DataFrame, columns: Sequence[str], groups: Sequence[Sequence[int]], shift: Sequence[float]) -> list[np.ndarray]:
    """For each group of columns the sum of z zT over the rows in which all of them are known, z being 1 and the moved values.

    One pass for any number of groups; a task sends one upper triangle a group. ``shift`` is taken off each column first.
    """
    sizes = [len(g) + 1 for g in groups]
    check_dim(max(sizes, default=0))
    if sum(k * k for k in sizes) > HELD:
        raise ValueError("too many columns in all groups")
    move, places = np.array(shift, dtype=float), [list(g) for g in groups]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((k, k)) for k in sizes]
        for batch in batches:
            if batch.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - move
                for total, g in zip(totals, places, strict=True):
                    part = x[:, g]
                    part = part[~np.isnan(part).any(axis=1)]
                    z = np.column_stack([np.ones(len(part)), part])
                    total += z.T @ z
        at = [np.triu_indices(k) for k in sizes]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.full(len(i), n) for n, (i, _) in enumerate(at)] or [np.zeros(0)]), pa.int32()),
            pa.array(np.concatenate([i for i, _ in at] or [np.zeros(0)]), pa.int32()), pa.array(np.concatenate([j for _, j in at] or [np.zeros(0)]), pa.int32()),
            pa.array(np.concatenate([t[i, j] for t, (i, j) in zip(totals, at, strict=True)] or [np.zeros(0)]))], ["g", "i", "j", "value"])
    rows = df.select(*[F.col(c).cast("double").alias(f"c{n}") for n, c in enumerate(columns)])
    sums = rows.mapInArrow(partial, "g int, i int, j int, value double").groupBy("g", "i", "j").agg(F.sum("value").alias("value")).toPandas()
    parts = dict(list(sums.groupby("g")))
    return [to_matrix(parts[n], k) if n in parts else np.zeros((k, k)) for n, k in enumerate(sizes)]


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Pearson correlations over the rows that have both values; NaN where a side does not vary there.

    Presence marks, values and squares of all columns are multiplied in one pass.
    """
    k = len(columns)
    check_dim(3 * k)
    found = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    mean = [float(found[f"m{i}"] or 0.0) for i in range(k)]
    scale = [float(found[f"s{i}"] or 0.0) or 1.0 for i in range(k)]
    x = [(F.col(c).cast("double") - m) / s for c, m, s in zip(columns, mean, scale, strict=True)]
    zero = F.lit(0.0)
    z = F.array(*[F.when(v.isNotNull(), 1.0).otherwise(0.0) for v in x], *[F.coalesce(v, zero) for v in x], *[F.coalesce(v * v, zero) for v in x])
    g = to_matrix(gram(df.select(z.alias("_z")), "_z", 3 * k).toPandas(), 3 * k)
    n, sx, sxy, sxx = g[:k, :k], g[k : 2 * k, :k], g[k : 2 * k, k : 2 * k], g[2 * k :, :k]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = sxy / n - (sx / n) * (sx.T / n)
        var = sxx / n - (sx / n) ** 2
        var = np.where(var > 1e-12 * np.maximum(sxx / n, 1e-300), var, np.nan)
        return cov / np.sqrt(var * var.T)


def to_matrix(rows: pd.DataFrame, k: int) -> np.ndarray:
    """The whole symmetric matrix from its upper triangle."""
    m = np.zeros((k, k))
    i, j, value = (rows[c].to_numpy() for c in ("i", "j", "value"))
    m[i, j] = m[j, i] = value
    return m


def moments(df: DataFrame, array_col: str, shift: Sequence[float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean vector and centred scatter matrix of an array column in one pass.

    ``shift`` lies near the means, so taking the mean out afterwards loses no digits.
    """
    k = len(shift)
    moved = F.zip_with(array_col, F.array(*[F.lit(float(v)) for v in shift]), lambda x, m: x - m)
    rows = df.filter(F.col(array_col).isNotNull()).select(F.concat(F.array(F.lit(1.0)), moved).alias("_x"))
    g = to_matrix(gram(rows, "_x", k + 1).toPandas(), k + 1)
    n = g[0, 0]
    if n == 0:
        return 0.0, np.asarray(shift, dtype=float), np.zeros((k, k))
    mean = g[0, 1:] / n
    return float(n), np.asarray(shift, dtype=float) + mean, g[1:, 1:] - n * np.outer(mean, mean)


def principal_axes(scatter: np.ndarray, n_components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending, all) and the leading axes as rows, largest loading positive."""
    values, vectors = np.linalg.eigh(scatter)
    order = np.argsort(values)[::-1]
    axes = vectors[:, order[:n_components]].T
    flip = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return np.clip(values[order], 0, None), axes * flip[:, None]
