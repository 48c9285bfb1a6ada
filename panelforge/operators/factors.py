"""Leading components of a panel with any number of items, by block Lanczos steps over the days.

An item is a row that holds its value on every day, so the calendar bounds its size. A step sends a few vectors over days to the rows
and gets back the sum over items of x (x . q); neither an items x items nor a days x days matrix is ever made, and the driver holds days
times a few dozen numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import stage

#: Days of a panel, at most.
MAX_DAYS = 20_000
#: Vectors beyond the wanted ones in a block, steps at most, and the size of residuals that ends them.
SPARE, MAX_STEPS, TOLERANCE = 3, 60, 1e-11


@dataclass
class ItemRows:
    """The panel with one row per item: ``item, x`` (days in order, as bytes of doubles), and the days."""

    rows: DataFrame
    days: list
    item: str
    value: str


def item_rows(panel: DataFrame, value: str, item: str, centre: str) -> ItemRows:
    """Holes are filled forward, then backward, per item; items without a value drop out.

    ``centre`` "item" takes out each item's mean over days, "day" each day's mean over items.
    """
    days = [r[0] for r in panel.select("Date").distinct().orderBy("Date").limit(MAX_DAYS + 1).collect()]
    if len(days) > MAX_DAYS:
        raise ValueError(f"more than {MAX_DAYS} days")
    number = {d: i for i, d in enumerate(days)}
    lists = panel.filter(F.col(value).isNotNull()).groupBy(item).agg(F.collect_list("Date").alias("d"), F.collect_list(F.col(value).cast("double")).alias("v"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, v in zip(batch.column("d").to_pylist(), batch.column("v").to_pylist(), strict=True):
                at = np.array([number[x] for x in d])
                order = np.argsort(at, kind="stable")
                at, v = at[order], np.array(v)[order]
                x = v[np.maximum(np.searchsorted(at, np.arange(len(days)), side="right") - 1, 0)]
                out.append((x - x.mean() if centre == "item" else x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(item), pa.array(out, pa.binary())], [item, "x"])
    kind = dict(panel.dtypes)[item]
    rows = stage(lists.mapInArrow(fill, f"`{item}` {kind}, x binary"), "item-rows")
    if centre == "day":
        n = rows.count()
        mean = _sums(rows, np.zeros((len(days), 0)), with_total=True)[1] / max(n, 1)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(np.frombuffer(x) - mean).tobytes() for x in batch.column("x").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(item), pa.array(out, pa.binary())], [item, "x"])
        rows = stage(rows.mapInArrow(move, f"`{item}` {kind}, x binary"), "item-rows")
    return ItemRows(rows, days, item, value)


def _sums(rows: DataFrame, q: np.ndarray, with_total: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sum over items of x (x . q), days by vectors, and the sum of x."""
    days, width = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((days, width + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(batch.num_rows, days)
                total[:, :width] += x.T @ (x @ q)
                if with_total:
                    total[:, width] += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(days), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width + 1).cast(pa.list_(pa.float64()))], ["day", "s"])
    parts = rows.select("x").mapInArrow(run, "day int, s array<double>").groupBy("day").agg(F.array(*[F.sum(F.get("s", i)) for i in range(width + 1)]).alias("s")).collect()
    out = np.zeros((days, width + 1))
    for r in parts:
        out[r.day] = r.s
    return out[:, :width], out[:, width]


def _independent(block: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """An orthonormal basis of what a block has beside the basis; directions below rounding are left out."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    return u[:, s > 1e-12 * scale]


def leading_days(panel: ItemRows, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the sum of x xT over items, and their vectors over days (fewer, if the rank is lower)."""
    days = len(panel.days)
    if not days or k <= 0:
        return np.zeros(0), np.zeros((days, 0))
    start = np.random.default_rng(seed).normal(size=(days, min(k + SPARE, days)))
    basis, image = np.zeros((days, 0)), np.zeros((days, 0))
    block, values, vectors = np.linalg.qr(start)[0], np.zeros(0), np.zeros((days, 0))
    for _ in range(MAX_STEPS):
        done, _ = _sums(panel.rows, block)
        basis, image = np.hstack([basis, block]), np.hstack([image, done])
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(theta)[::-1][:k]
        values, vectors = np.clip(theta[order], 0, None), basis @ y[:, order]
        rest = np.linalg.norm(image @ y[:, order] - vectors * theta[order], axis=0)
        top = max(float(values.max(initial=0.0)), 1e-300)
        block = _independent(done, basis, max(np.linalg.norm(done), 1e-300))
        if rest.max(initial=0.0) <= TOLERANCE * top or not block.shape[1]:
            break
    keep = values > 1e-14 * max(float(values.max(initial=0.0)), 1e-300)
    return values[keep], vectors[:, keep]


def _long(panel: ItemRows, change, name: str) -> DataFrame:
    """Rows ``Date, item, value`` of every item's changed vector."""
    item, value, length = panel.item, panel.value, len(panel.days)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [change(np.frombuffer(x)) for x in batch.column("x").to_pylist()]
            places = pa.array(np.arange(len(out) + 1) * length, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(item), pa.ListArray.from_arrays(places, pa.array(np.concatenate(out) if out else np.zeros(0)))], [item, "x"])
    kind = dict(panel.rows.dtypes)[item]
    wide = panel.rows.mapInArrow(run, f"`{item}` {kind}, x array<double>")
    days = F.array(*[F.lit(d) for d in panel.days]) if len(panel.days) <= 512 else None
    if days is not None:
        return wide.select(F.inline(F.arrays_zip(days.alias("Date"), F.col("x").alias(value))), item).select("Date", item, value)
    calendar = panel.rows.sparkSession.createDataFrame([(i, d) for i, d in enumerate(panel.days)], "day int, Date date")
    return wide.select(item, F.posexplode("x").alias("day", value)).join(F.broadcast(calendar), "day").select("Date", item, value)  # a row a day


def remove_factors(panel: DataFrame, k: int, value: str = "value", item: str = "Code") -> DataFrame:
    """``Date, item, value``: what the first ``k`` components leave of a whole panel; ``k`` 0 is the panel itself.

    Values are centred per item. Holes are filled first, so every item has every day.
    """
    if k <= 0:
        return panel
    rows = item_rows(panel, value, item, "item")
    _, u = leading_days(rows, k)
    return _long(rows, lambda x: x - u @ (u.T @ x), value)


def item_coordinates(panel: DataFrame, n_components: int = 3, value: str = "Target", item: str = "Sector") -> DataFrame:
    """Items as points: ``item, Feature0, ...``, their coordinates along the leading components of the items' spread around the mean item.

    Of each component the item furthest from the origin has a positive coordinate.
    """
    rows = item_rows(panel, value, item, "day")
    values, u = leading_days(rows, n_components)
    names = [f"Feature{i}" for i in range(u.shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([u.T @ np.frombuffer(x) for x in batch.column("x").to_pylist()]).reshape(batch.num_rows, u.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(item), *(pa.array(at[:, i]) for i in range(u.shape[1]))], [item, *names])
    kind = dict(panel.dtypes)[item]
    found = stage(rows.rows.mapInArrow(run, ", ".join([f"`{item}` {kind}", *(f"{n} double" for n in names)])), "item-coordinates")
    if not names:
        return found
    signs = found.agg(*[F.max_by(F.signum(n), F.struct(F.round(F.abs(n), 9), item)).alias(n) for n in names]).first()
    return found.select(item, *[(F.col(n) * F.lit(signs[n] or 1.0)).alias(n) for n in names])
