"""Clusters that are split in two again and again until no split separates them.

All open clusters of a level are split at once: rows carry their cluster, a job adds up counts, sums and squares by cluster and side,
and the next job gets the centres that follow. The silhouette of a split needs the same sums only, so no distances between rows are
made, and a cluster that holds most rows is spread over the tasks like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import stage

#: Numbers of centres that travel to the rows at a time; more open clusters take turns.
SENT = 1 << 20
#: Splits of a split, after which something is wrong: a row's path is that long.
DEEPEST = 1000

#: Takes rows and the number of each row's cluster, gives each row's side.
Sides = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _matrix(batch: pa.RecordBatch, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    at = np.array([known[p] for p in batch.column("path").to_pylist()], dtype=np.int64)
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), at


def _moments(points: DataFrame, paths: list[str], sides: Sides, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sums and sums of squares by cluster and side."""
    known, size = {p: i for i, p in enumerate(paths)}, len(paths) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = np.zeros(size), np.zeros((size, dim)), np.zeros((size, dim))
        for batch in batches:
            if batch.num_rows:
                x, at = _matrix(batch, known)
                cell = at * 2 + sides(x, at)
                n += np.bincount(cell, minlength=size)
                np.add.at(s, cell, x)
                np.add.at(q, cell, x * x)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(held, dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(held)), pa.int32()), pa.array(np.repeat(n[held], dim)),
            pa.array(s[held].ravel()), pa.array(q[held].ravel())], ["cell", "dim", "n", "s", "q"])
    rows = points.mapInArrow(run, "cell int, dim int, n double, s double, q double").groupBy("cell", "dim").agg(*[F.sum(c).alias(c) for c in "nsq"]).collect()
    n, s, q = np.zeros(size), np.zeros((size, dim)), np.zeros((size, dim))
    for r in rows:
        n[r["cell"]], s[r["cell"], r["dim"]], q[r["cell"], r["dim"]] = r["n"], r["s"], r["q"]
    return n.reshape(-1, 2), s.reshape(-1, 2, dim), q.reshape(-1, 2, dim)


def _nearer(centres: np.ndarray) -> Sides:
    def sides(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = [((x - centres[at, side]) ** 2).sum(axis=1) for side in (0, 1)]
        return (np.where(np.isnan(d[1]), np.inf, d[1]) < np.where(np.isnan(d[0]), np.inf, d[0])).astype(np.int64)
    return sides


def _separation(points: DataFrame, paths: list[str], sides: Sides, n: np.ndarray, centres: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Mean silhouette of each cluster's split in squared distances; the only row of a side counts 0."""
    known = {p: i for i, p in enumerate(paths)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(paths))
        for batch in batches:
            if batch.num_rows:
                x, at = _matrix(batch, known)
                side = sides(x, at)
                norm = (x * x).sum(axis=1)
                mean = [norm - 2 * (x * centres[at, s]).sum(axis=1) + square[at, s] for s in (0, 1)]
                own, other = np.where(side == 0, mean[0], mean[1]), np.where(side == 0, mean[1], mean[0])
                count = n[at, side]
                a = own * count / np.maximum(count - 1, 1)
                largest = np.maximum(a, other)
                value = np.where((count > 1) & (largest > 0), (other - a) / np.where(largest > 0, largest, 1), 0.0)
                total += np.bincount(at, np.nan_to_num(value), minlength=len(paths))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(paths)), pa.int32()), pa.array(total)], ["cluster", "s"])
    out = np.zeros(len(paths))
    for r in points.mapInArrow(run, "cluster int, s double").groupBy("cluster").agg(F.sum("s").alias("s")).collect():
        out[r["cluster"]] = r["s"]
    return out / np.maximum(n.sum(axis=1), 1)


def recursive_splits(points: DataFrame, least: float = 0.1, iterations: int = 6, vec: str = "vector", key: str = "id") -> DataFrame:
    """``key, Path, Cluster``: the sides a row took, as 0 and 1, and the number of the cluster in order of paths.

    A cluster is cut at the mean of the coordinate that varies most, its two centres move ``iterations`` times, and the split counts if
    its mean silhouette reaches ``least``; then both sides are tried in turn. There is no depth and no smallest size beyond one row. Rows
    without a vector drop out; equal rows share their cluster.
    """
    kind = dict(points.dtypes)[key]
    rows = stage(points.filter(F.col(vec).isNotNull()).select(F.col(key).alias("id"), F.lit("").alias("path"), F.col(vec).cast("array<double>").alias("x")), "splits")
    dims = rows.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if dims.low != dims.high:
        raise ValueError("vectors differ in dimension")
    done, dim = [], dims.high or 0
    turn = max(1, SENT // (2 * max(dim, 1)))
    for _ in range(DEEPEST):
        open_paths = [r.path for r in rows.select("path").distinct().collect()] if turn >= 1 else []
        if not open_paths or not dim:
            break
        split: list[DataFrame] = []
        for at in range(0, len(open_paths), turn):
            paths = sorted(open_paths)[at : at + turn]
            some = rows if len(open_paths) <= turn else rows.filter(F.col("path").between(paths[0], paths[-1]))
            n, s, q = _moments(some, paths, lambda x, at: np.zeros(len(x), dtype=np.int64), dim)
            mean = s[:, 0] / n[:, :1]
            spread = q[:, 0] / n[:, :1] - mean**2
            widest = spread.argmax(axis=1)
            cut = mean[np.arange(len(paths)), widest]

            def sides(x: np.ndarray, at: np.ndarray, widest=widest, cut=cut) -> np.ndarray:
                return (x[np.arange(len(x)), widest[at]] > cut[at]).astype(np.int64)
            for _ in range(iterations):
                n, s, _ = _moments(some, paths, sides, dim)
                with np.errstate(invalid="ignore", divide="ignore"):
                    sides = _nearer(s / n[:, :, None])
            n, s, q = _moments(some, paths, sides, dim)
            with np.errstate(invalid="ignore", divide="ignore"):
                centres, square = s / n[:, :, None], q.sum(axis=2) / n
            accepted = (_separation(some, paths, sides, n, centres, square) >= least) & (n > 0).all(axis=1)
            known = {p: i for i, p in enumerate(paths)}

            def move(batches: Iterator[pa.RecordBatch], sides=sides, accepted=accepted, known=known) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        x, at = _matrix(batch, known)
                        side = sides(x, at)
                        names = [p + str(d) if accepted[i] else p for p, i, d in zip(batch.column("path").to_pylist(), at, side, strict=True)]
                        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names), batch.column("x"), pa.array(accepted[at])], ["id", "path", "x", "again"])
            split.append(some.mapInArrow(move, f"id {kind}, path string, x array<double>, again boolean"))
        level = split[0]
        for more in split[1:]:
            level = level.unionByName(more)
        level = stage(level, "splits")
        done.append(level.filter(~F.col("again")).select("id", "path"))
        rows = level.filter("again").select("id", "path", "x")
    else:
        raise RuntimeError("splits did not end")
    out = rows.select("id", "path")
    for part in done:
        out = out.unionByName(part)
    numbers = out.select("path").distinct().withColumn("Cluster", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))  # a row a cluster
    return out.join(numbers, "path").select(F.col("id").alias(key), F.col("path").alias("Path"), "Cluster")
