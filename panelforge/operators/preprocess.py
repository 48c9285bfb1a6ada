"""Fit on a date range, apply to every date: scaling, PCA, neutralisation, step chains.

A fit returns plain numbers (one aggregate row, or a k x k matrix with a checked
k); a transform is a projection of literals and never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import windows as P
from panelforge.operators import linalg as L
from panelforge.session import reuse

KEYS = ("Date", "Sector")


def fit_range(df: DataFrame, start: str | None = None, end: str | None = None, date_col: str = "Date") -> DataFrame:
    """Rows of the closed fit interval; each fit refuses an empty one when it sees its counts."""
    if start is not None:
        df = df.filter(F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date_col) <= F.lit(end).cast("date"))
    return df


def require_rows(n: int | float | None) -> None:
    if not n:
        raise ValueError("no usable rows in the fit range")


def numeric_columns(df: DataFrame, skip: Sequence[str] = KEYS) -> list[str]:
    numeric = ("double", "float", "bigint", "int", "smallint")
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in numeric and f.name not in skip]


class Step:
    """A preprocessing step; subclasses provide ``fit`` and ``transform``."""

    start: str | None = None
    end: str | None = None

    def fit(self, df: DataFrame) -> Step:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


@dataclass
class Standardise(Step):
    """Zero mean, unit population deviation; a constant column keeps scale 1."""

    columns: Sequence[str] | None = None
    with_mean: bool = True
    with_std: bool = True
    start: str | None = None
    end: str | None = None
    stats: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Standardise:
        cols = list(self.columns or numeric_columns(df))
        row = fit_range(df, self.start, self.end).agg(
            F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
        require_rows(row["_n"])
        self.stats = {c: (row[f"m_{c}"] if self.with_mean else 0.0, (row[f"s_{c}"] or 1.0) if self.with_std else 1.0) for c in cols}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.stats.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + m for c, (m, s) in self.stats.items()})


@dataclass
class Pca(Step):
    """Principal components of numeric columns: scores, reconstruction or residuals."""

    n_components: int
    mode: str = "residuals"
    columns: Sequence[str] | None = None
    start: str | None = None
    end: str | None = None
    mean: np.ndarray | None = None
    fill: np.ndarray | None = None
    axes: np.ndarray | None = None
    ratios: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("components", "residuals", "transform"):
            raise ValueError("mode must be 'components', 'residuals' or 'transform'")

    def fit(self, df: DataFrame) -> Pca:
        cols = list(self.columns or numeric_columns(df))
        self.columns = cols
        rows = fit_range(df, self.start, self.end)
        fill = rows.agg(*[F.avg(c).alias(c) for c in cols]).first()
        self.fill = np.array([fill[c] if fill[c] is not None else 0.0 for c in cols])
        complete = rows.dropna(subset=cols).select(L.column_array(cols).alias("_x"))
        L.check_dim(len(cols))
        n, self.mean, scatter = L.moments(complete, "_x", self.fill)
        require_rows(n)
        values, self.axes = L.principal_axes(scatter, min(self.n_components, len(cols), int(n)))
        total = values.sum()
        self.ratios = (values / total if total else values)[: len(self.axes)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        cols = list(self.columns)
        centred = {c: F.coalesce(F.col(c), F.lit(float(f))) - float(m) for c, f, m in zip(cols, self.fill, self.mean, strict=True)}
        scores = [sum((centred[c] * float(v) for c, v in zip(cols, axis, strict=True)), F.lit(0.0)) for axis in self.axes]
        keep = [c for c in df.columns if c not in cols]
        if self.mode == "transform":
            return df.select(*keep, *[s.alias(f"PC{i + 1}") for i, s in enumerate(scores)])
        named = df.select("*", *[s.alias(f"_s{i}") for i, s in enumerate(scores)])
        out = []
        for j, c in enumerate(cols):
            fitted = sum((F.col(f"_s{i}") * float(axis[j]) for i, axis in enumerate(self.axes)), F.lit(0.0))
            out.append((fitted + float(self.mean[j]) if self.mode == "components" else centred[c] - fitted).alias(c))
        return named.select(*keep, *out)

    def component_table(self, df: DataFrame) -> DataFrame:
        rows = [(f"PC_{i + 1:02d}", c, float(v)) for i, axis in enumerate(self.axes) for c, v in zip(self.columns, axis, strict=True)]
        return df.sparkSession.createDataFrame(rows, "Component string, Name string, Loading double")

    def variance_table(self, df: DataFrame) -> DataFrame:
        rows = [(f"PC_{i + 1:02d}", float(r), float(c)) for i, (r, c) in enumerate(zip(self.ratios, np.cumsum(self.ratios), strict=True))]
        return df.sparkSession.createDataFrame(rows, "Component string, Ratio double, CumulativeRatio double")


def dense_matrix(df: DataFrame, value: str = "Target", item: str = "Sector") -> DataFrame:
    """Date x item grid in long form, holes filled forward then backward per item.

    The grid is bounded by days times sectors, the size of the matrix it stands for.
    """
    days = df.select("Date").distinct()
    items = df.select(item).distinct()
    names = items.agg(F.collect_list(item).alias("_items"))
    grid = days.withColumn("_items", names.scalar()).select("Date", F.explode("_items").alias(item))
    filled = grid.join(df.select("Date", item, value), ["Date", item], "left")
    return filled.withColumn(value, P.fill_both(value, item))


def unstack(df: DataFrame, names: Sequence[str], value: str = "Target", item: str = "Sector") -> DataFrame:
    return df.groupBy("Date").pivot(item, list(names)).agg(F.first(value, ignorenulls=True))


def stack(wide: DataFrame, names: Sequence[str], value: str = "Target", item: str = "Sector") -> DataFrame:
    return wide.unpivot(["Date"], list(names), item, value).filter(F.col(value).isNotNull())


@dataclass
class PanelPca:
    """PCA across the sectors of a long (Date, Sector, value) panel, without widening it.

    The fit collects the sector names with their means and one scatter matrix, two
    jobs; the transform adds the loadings per sector and sums scores inside each day,
    one exchange on Date.
    """

    n_components: int
    value: str = "Target"
    item: str = "Sector"
    start: str | None = None
    end: str | None = None
    names: list[str] = field(default_factory=list)
    mean: np.ndarray | None = None
    axes: np.ndarray | None = None
    ratios: np.ndarray | None = None

    def fit(self, dense: DataFrame) -> PanelPca:
        rows = fit_range(dense, self.start, self.end)
        levels = rows.groupBy(self.item).agg(F.avg(self.value).alias("m")).orderBy(self.item).limit(L.MAX_DIM + 1).collect()
        self.names = [r[0] for r in levels]
        k = L.check_dim(len(self.names))
        require_rows(k)
        per_day = rows.groupBy("Date").agg(
            F.transform(F.sort_array(F.collect_list(F.struct(self.item, self.value))), lambda s: s[self.value]).alias("_x"),
            F.count(self.value).alias("_n"),
        ).filter(F.col("_n") == k)
        n, self.mean, scatter = L.moments(per_day, "_x", [r["m"] or 0.0 for r in levels])
        require_rows(n)
        values, self.axes = L.principal_axes(scatter, min(self.n_components, k))
        total = values.sum()
        self.ratios = (values / total if total else values)[: len(self.axes)]
        return self

    def _loadings(self, df: DataFrame) -> DataFrame:
        rows = [(n, float(m), [float(a) for a in self.axes[:, j]]) for j, (n, m) in enumerate(zip(self.names, self.mean, strict=True))]
        return df.sparkSession.createDataFrame(rows, f"{self.item} string, _mean double, _load array<double>")

    def _scored(self, dense: DataFrame) -> DataFrame:
        rows = dense.join(self._loadings(dense), self.item)
        rows = rows.withColumn("_c", F.coalesce(F.col(self.value) - F.col("_mean"), F.lit(0.0)))
        w = Window.partitionBy("Date")
        fitted = sum((F.col("_load")[i] * F.sum(F.col("_c") * F.col("_load")[i]).over(w) for i in range(len(self.axes))), F.lit(0.0))
        return rows.withColumn("_fit", fitted)

    def residuals(self, dense: DataFrame) -> DataFrame:
        return self._scored(dense).select("Date", self.item, (F.col("_c") - F.col("_fit")).alias(self.value))

    def reconstruct(self, dense: DataFrame) -> DataFrame:
        return self._scored(dense).select("Date", self.item, (F.col("_fit") + F.col("_mean")).alias(self.value))

    def scores(self, dense: DataFrame) -> DataFrame:
        rows = dense.join(self._loadings(dense), self.item)
        centred = F.coalesce(F.col(self.value) - F.col("_mean"), F.lit(0.0))
        return rows.groupBy("Date").agg(*[F.sum(centred * F.col("_load")[i]).alias(f"PC{i + 1}") for i in range(len(self.axes))])

    def variance_table(self, df: DataFrame) -> DataFrame:
        rows = [(f"PC_{i + 1:02d}", float(r), float(c)) for i, (r, c) in enumerate(zip(self.ratios, np.cumsum(self.ratios), strict=True))]
        return df.sparkSession.createDataFrame(rows, "Component string, Ratio double, CumulativeRatio double")

    def component_table(self, df: DataFrame) -> DataFrame:
        rows = [(f"PC_{i + 1:02d}", n, float(v)) for i, axis in enumerate(self.axes) for n, v in zip(self.names, axis, strict=True)]
        return df.sparkSession.createDataFrame(rows, f"Component string, {self.item} string, Loading double")


def _fit_each(rows: DataFrame, specs: Sequence[tuple[str, Sequence[str]]], fit_intercept: bool) -> list[tuple[list[str], np.ndarray, float] | None]:
    """Least squares of each target on its columns over the rows that have them all, in one pass; none where there is no such row."""
    known = [[c for c in on if c in rows.columns and c != t] if t in rows.columns else [] for t, on in specs]
    columns = sorted({c for xs in known for c in xs} | {t for (t, _), xs in zip(specs, known, strict=True) if xs})
    if not columns:
        return [None] * len(specs)
    means = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first() if fit_intercept else None
    shift = [float(means[i] or 0.0) if means else 0.0 for i in range(len(columns))]
    at = {c: i for i, c in enumerate(columns)}
    grams = L.masked_grams(rows, columns, [[at[c] for c in (*xs, t)] if xs else [] for (t, _), xs in zip(specs, known, strict=True)], shift)
    out: list[tuple[list[str], np.ndarray, float] | None] = []
    for (t, _), xs, m in zip(specs, known, grams, strict=True):
        if not xs or m[0, 0] == 0:
            out.append(None)
            continue
        mean = m[0, 1:] / m[0, 0] if fit_intercept else np.zeros(len(xs) + 1)
        inner = m[1:, 1:] - m[0, 0] * np.outer(mean, mean)
        coef = np.linalg.lstsq(inner[:-1, :-1], inner[:-1, -1], rcond=None)[0]
        level = mean + np.array([shift[at[c]] for c in (*xs, t)])
        out.append((xs, coef, float(level[-1] - coef @ level[:-1]) if fit_intercept else 0.0))
    return out


@dataclass
class NeutraliseOn(Step):
    """Least-squares residual of each target on the given columns; one pass over the rows fits all targets."""

    targets: Sequence[str]
    on: Sequence[str]
    fit_intercept: bool = False
    start: str | None = None
    end: str | None = None
    models: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> NeutraliseOn:
        found = _fit_each(fit_range(df, self.start, self.end), [(t, self.on) for t in self.targets], self.fit_intercept)
        self.models = {t: model for t, model in zip(self.targets, found, strict=True) if model}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for t, (xs, coef, intercept) in self.models.items():
            df = df.withColumn(t, _residual(t, xs, coef, intercept))
        return df


def _residual(target: str, xs: Sequence[str], coef: np.ndarray, intercept: float):
    fitted = sum((F.col(c) * float(b) for c, b in zip(xs, coef, strict=True)), F.lit(float(intercept)))
    return F.when(fitted.isNotNull(), F.col(target) - fitted).otherwise(F.col(target))


@dataclass
class NeutraliseEach(Step):
    """Several targets, each on columns of its own and into a column of its own, fitted in one pass."""

    specs: Sequence[tuple[str, Sequence[str], str]]
    fit_intercept: bool = False
    start: str | None = None
    end: str | None = None
    models: list = field(default_factory=list)

    def fit(self, df: DataFrame) -> NeutraliseEach:
        self.models = _fit_each(fit_range(df, self.start, self.end), [(t, on) for t, on, _ in self.specs], self.fit_intercept)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({out: _residual(t, *model) if model else F.col(t) for (t, _, out), model in zip(self.specs, self.models, strict=True)})


@dataclass
class NeutraliseMutually(Step):
    """Subtract, in column order, correlation times every earlier already-treated column."""

    columns: Sequence[str] | None = None
    start: str | None = None
    end: str | None = None
    correlations: dict = field(default_factory=dict)

    def fit(self, df: DataFrame) -> NeutraliseMutually:
        cols = list(self.columns or numeric_columns(df))
        self.columns = cols
        if len(cols) > 1:
            rho = L.pairwise_correlations(fit_range(df, self.start, self.end), cols)
            self.correlations = {(b, a): float(rho[i, j]) for i, b in enumerate(cols) for j, a in enumerate(cols[:i]) if np.isfinite(rho[i, j])}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for i, c in enumerate(self.columns):
            out = F.col(c)
            for earlier in self.columns[:i]:
                rho = self.correlations.get((c, earlier))
                if rho is not None:
                    out = out - F.col(earlier) * rho
            df = df.withColumn(c, out)
        return df


@dataclass
class Chain(Step):
    """Steps fitted and applied in order."""

    steps: Sequence[tuple[str, Step]]
    fitted: bool = False

    def fit(self, df: DataFrame) -> Chain:
        for _, step in self.steps:
            df = step.fit(df).transform(df)
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise ValueError("fit the chain first")
        for _, step in self.steps:
            df = step.transform(df)
        return df


def apply_function(fn: Callable[[DataFrame], DataFrame]) -> Step:
    """Wrap a plain DataFrame function as a step without a fit."""
    class _Function(Step):
        def fit(self, df: DataFrame) -> Step:
            return self

        def transform(self, df: DataFrame) -> DataFrame:
            return df.transform(fn)
    return _Function()


def neutralisation_steps(spec: DataFrame | Sequence[tuple[str, str, str]], fit_intercept: bool = False) -> Chain:
    """Steps from ``(to_neutralize, by, neutralized)`` rows; the result lands in ``neutralized``.

    Rows that use no result of an earlier row are one step, so they are fitted in one pass.
    """
    rows = [tuple(r) for r in spec.collect()] if isinstance(spec, DataFrame) else list(spec)
    steps: list[tuple[str, Step]] = []
    wave: list[tuple[str, list[str], str]] = []
    for target, by, out in rows:
        on = [c.strip() for c in by.split(",")]
        if {target, *on, out} & {o for _, _, o in wave}:
            steps.append((f"neutralise {len(steps)}", NeutraliseEach(wave, fit_intercept)))
            wave = []
        wave.append((target, on, out))
    if wave:
        steps.append((f"neutralise {len(steps)}", NeutraliseEach(wave, fit_intercept)))
    return Chain(steps)


def daytime_target(index: DataFrame) -> DataFrame:
    """Sector return from open to close."""
    return index.select("Date", "Sector", (F.try_divide(F.col("Close"), F.col("Open")) - 1).alias("Target"))


def pca_residual_target(index: DataFrame, n_components: int, start: str | None = None, end: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Daytime return with the common factors removed, and the raw daytime return."""
    raw = daytime_target(index)
    dense = reuse(dense_matrix(raw))
    return PanelPca(n_components, start=start, end=end).fit(dense).residuals(dense), raw
