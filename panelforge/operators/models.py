"""Per-sector sparse linear models from distributed sufficient statistics, and a pooled boosted-tree model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import linalg as L
from panelforge.session import reuse

KEYS = ["Date", "Sector"]
ALPHA_RANGE = (5e-6, 5e-3)


def lasso_path_point(gram: np.ndarray, xy: np.ndarray, alpha: float, start: np.ndarray, tol: float = 1e-9, max_iter: int = 5000) -> np.ndarray:
    """Minimise w'Gw/2 - w'c + alpha |w| by coordinate descent."""
    w, grad = start.copy(), gram @ start
    diag = np.where(np.diag(gram) > 0, np.diag(gram), 1.0)
    for _ in range(max_iter):
        worst = 0.0
        for j in range(len(w)):
            rho = xy[j] - grad[j] + diag[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha, 0.0) / diag[j]
            step = new - w[j]
            if step:
                grad += gram[:, j] * step
                w[j] = new
                worst = max(worst, abs(step))
        if worst < tol:
            break
    return w


def search_alpha(gram: np.ndarray, xy: np.ndarray, low: int, high: int, bounds: tuple[float, float] = ALPHA_RANGE) -> tuple[float, np.ndarray]:
    """Halve the (log) penalty range until ``low``..``high`` coefficients remain."""
    lo, hi = bounds
    w = np.zeros(len(xy))
    alpha = hi
    for _ in range(40):
        alpha = float(np.sqrt(lo * hi))
        w = lasso_path_point(gram, xy, alpha, w)
        kept = int((w != 0).sum())
        if kept < low:
            hi = alpha
        elif kept > high:
            lo = alpha
        else:
            break
    return alpha, w


def fit_lasso(
    target: DataFrame, features: DataFrame, columns: Sequence[str], by: str | None = "Sector",
    min_features: int = 3, max_features: int = 5, alpha: float | None = None,
) -> DataFrame:
    """One model per sector (or one for all) as rows ``(Sector, Intercept, Alpha, Coef, Mean, Scale)``.

    ``Status`` is ``ok``, or says that the optimality conditions are not met to 1e-7 or that no penalty in the range leaves the
    wanted number of features.

    A single pass gives every sector's cross-products of (1, x, y); the solve then
    sees k*k numbers per sector instead of its rows.
    """
    cols = list(columns)
    k = L.check_dim(len(cols) + 2)
    rows = features.join(target.select(*KEYS, "Target").filter(F.col("Target").isNotNull()), KEYS).dropna(subset=cols)
    rows = reuse(rows.select(*KEYS, "Target", *cols))
    group = F.col(by) if by else F.lit("*")
    # A common shift and scale keeps the cross-products well conditioned.
    pre = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    shift = [float(pre[f"m_{c}"] or 0.0) for c in cols]
    scale = [float(pre[f"s_{c}"] or 1.0) for c in cols]
    terms = [(F.col(c) - m) / s for c, m, s in zip(cols, shift, scale, strict=True)]
    vectors = rows.select(group.alias("Sector"), F.array(F.lit(1.0), *terms, F.col("Target")).alias("_x"))
    stats = L.gram(vectors, "_x", k, by=["Sector"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = L.to_matrix(pdf, k)
        n = m[0, 0]
        mean = m[0] / n
        cov = m / n - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cov)[1:-1], 0, None))
        sd = np.where(sd > 1e-12, sd, 1.0)
        gram = cov[1:-1, 1:-1] / np.outer(sd, sd)
        xy = cov[1:-1, -1] / sd
        if alpha is None:
            used, w = search_alpha(gram, xy, min(min_features, len(cols)), max_features)
        else:
            used, w = alpha, lasso_path_point(gram, xy, alpha, np.zeros(len(cols)))
        rest = float(np.max(np.abs(xy - gram @ w) - used, initial=0.0))
        kept, wanted = int((w != 0).sum()), (min(min_features, len(cols)), max_features)
        status = "not converged" if rest > 1e-7 else "ok" if alpha is not None or wanted[0] <= kept <= wanted[1] else "features out of range"
        return pd.DataFrame([{
            "Sector": pdf["Sector"].iloc[0], "Status": status, "Features": kept, "Rows": int(round(n)), "Intercept": float(mean[-1]), "Alpha": float(used),
            "Coef": [float(v) for v in w],
            "Mean": [float(a + b * c) for a, b, c in zip(shift, mean[1:-1], scale, strict=True)],
            "Scale": [float(a * b) for a, b in zip(sd, scale, strict=True)]}])

    return stats.groupBy("Sector").applyInPandas(
        solve, "Sector string, Status string, Features long, Rows long, Intercept double, Alpha double, Coef array<double>, Mean array<double>, Scale array<double>")


def _standardised(m: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Cross-products of (1, x, y) after x has been moved by ``mean`` and divided by ``sd``."""
    k = len(mean)
    t = np.eye(k + 2)
    t[1:-1, 0], t[1:-1, 1:-1] = -mean / sd, np.diag(1 / sd)
    return t @ m @ t.T


def _centred(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of (x, y), and their covariances, from cross-products of (1, x, y)."""
    mean = m[0, 1:] / m[0, 0]
    return mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean)


def lasso_path(m: np.ndarray, penalties: Sequence[float]) -> list[tuple[float, np.ndarray]]:
    """Intercept and coefficients for each penalty, largest first, each started from the one before."""
    mean, cov = _centred(m)
    w, out = np.zeros(len(mean) - 1), []
    for alpha in penalties:
        w = lasso_path_point(cov[:-1, :-1], cov[:-1, -1], alpha, w, tol=1e-13)
        out.append((float(mean[-1] - mean[:-1] @ w), w.copy()))
    return out


def unexplained(m: np.ndarray, intercept: float, w: np.ndarray) -> float:
    """Squared error of a model over the rows behind a matrix, as a share of their spread around their mean."""
    q = np.concatenate([[-intercept], -w, [1.0]])
    spread = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
    return float(q @ m @ q / spread) if spread > 0 else float("nan")


def penalty_grid(n: int = 12, bounds: tuple[float, float] = ALPHA_RANGE) -> list[float]:
    """Penalties in equal ratios, largest first."""
    low, high = bounds
    return [high * (low / high) ** (i / (n - 1)) for i in range(n)]


def fit_lasso_validated(
    target: DataFrame, features: DataFrame, columns: Sequence[str], by: str | None = "Sector", penalties: Sequence[float] | None = None,
    folds: int = 5, min_features: int = 3, max_features: int = 5,
) -> DataFrame:
    """One model per sector (or one for all), with the penalty that predicts held-out days best.

    Of the penalties that leave ``min_features`` to ``max_features`` coefficients in the model of all days, the one with the least
    ``Loss`` is taken: the mean over the folds of the squared error there as a share of the fold's spread. Folds are runs of days. If no
    penalty leaves that many, the nearest number counts and ``Status`` says so. Ties go to the larger penalty.

    One pass sums cross-products by sector and fold. A fold's training matrix is the total less the fold's, and the error on a fold is a
    quadratic form of its matrix, so neither folds nor penalties read a row again.
    """
    cols, grid = list(columns), sorted(penalties or penalty_grid(), reverse=True)
    k = L.check_dim(len(cols) + 2)
    rows = features.select(*KEYS, *cols).join(target.select(*KEYS, "Target").filter(F.col("Target").isNotNull()), KEYS).dropna(subset=cols)
    group = F.col(by) if by else F.lit("*")
    if by:
        rows = rows.withColumn("_fold", F.ntile(folds).over(Window.partitionBy(by).orderBy("Date")))
    else:  # a row a day
        days = rows.select("Date").distinct().withColumn("_fold", F.ntile(folds).over(Window.orderBy("Date")))
        rows = rows.join(days, "Date")
    vectors = rows.select(group.alias("Sector"), "_fold", F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols], F.col("Target")).alias("_x"))
    stats = L.gram(vectors, "_x", k, by=["Sector", "_fold"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = {f: L.to_matrix(part, k) for f, part in pdf.groupby("_fold")}
        total = sum(raw.values())
        mean, cov = _centred(total)
        sd = np.sqrt(np.clip(np.diag(cov)[:-1], 0, None))
        sd = np.where(sd > 1e-12 * np.maximum(np.abs(mean[:-1]), 1e-300), sd, 1.0)
        parts = {f: _standardised(m, mean[:-1], sd) for f, m in raw.items()}
        whole = sum(parts.values())
        models = lasso_path(whole, grid)
        losses = np.mean([[unexplained(m, b, w) for b, w in lasso_path(whole - m, grid)] for m in parts.values()], axis=0) if len(parts) > 1 else np.full(len(grid), np.nan)
        kept = np.array([int((w != 0).sum()) for _, w in models])
        low, high = min(min_features, len(cols)), max_features
        miss = np.maximum(np.maximum(low - kept, kept - high), 0)
        best = min(range(len(grid)), key=lambda i: (miss[i], np.inf if np.isnan(losses[i]) else losses[i], i))
        intercept, w = models[best]
        _, c = _centred(whole)
        rest = float(np.max(np.abs(c[:-1, -1] - c[:-1, :-1] @ w) - grid[best], initial=0.0))
        status = "not converged" if rest > 1e-7 else "features out of range" if miss[best] else "ok"
        return pd.DataFrame([{
            "Sector": pdf["Sector"].iloc[0], "Status": status, "Features": int(kept[best]), "Rows": int(round(total[0, 0])), "Intercept": float(intercept),
            "Alpha": float(grid[best]), "Loss": float(losses[best]), "Coef": [float(v) for v in w], "Mean": [float(v) for v in mean[:-1]], "Scale": [float(v) for v in sd]}])

    return stats.groupBy("Sector").applyInPandas(
        solve, "Sector string, Status string, Features long, Rows long, Intercept double, Alpha double, Loss double, Coef array<double>, Mean array<double>, Scale array<double>")


def feature_importances(models: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-zero coefficients, largest first within each sector."""
    names = F.array(*[F.lit(c) for c in columns])
    rows = models.select("Sector", F.explode(F.arrays_zip(names.alias("Feature"), F.col("Coef").alias("FI"))).alias("z"))
    return rows.select("Sector", "z.Feature", "z.FI").filter("FI <> 0").orderBy("Sector", F.abs("FI").desc(), "Feature")


def predict_lasso(models: DataFrame, features: DataFrame, columns: Sequence[str], target: DataFrame | None = None, pooled: bool = False, usable: Sequence[str] | None = None) -> DataFrame:
    """Scale, weigh and sum inside the projection: a row for every row of ``features``.

    The prediction is null where a feature is, where the sector has no model, and where the model's ``Status`` is none of ``usable``.
    A pooled model is one row and enters as literals.
    """
    small = models.filter(F.col("Status").isin(*usable)) if usable else models
    small = small.select("Sector", "Intercept", "Coef", "Mean", "Scale")
    rows = features.select(*KEYS, *columns)
    if pooled:
        only = small.first()
        names = ("Intercept", "Coef", "Mean", "Scale")
        rows = rows.withColumns({c: F.lit(only[c] if only else None).cast("double" if c == "Intercept" else "array<double>") for c in names})
    else:
        rows = rows.join(small, "Sector", "left")
    total = F.col("Intercept")
    for i, c in enumerate(columns):
        total = total + (F.col(c) - F.get("Mean", i)) / F.get("Scale", i) * F.get("Coef", i)
    out = rows.select(*KEYS, total.alias("Pred"))
    return out.join(target.select(*KEYS, "Target"), KEYS, "left") if target is not None else out


def _complete(rows: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Every feature with 0 for null, and next to it whether it was null, so that no row is lost."""
    out = rows.withColumns({f"_f{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(columns)} | {
        f"_m{i}": F.col(c).isNull().cast("double") for i, c in enumerate(columns)})
    return out, [f"_{k}{i}" for i in range(len(columns)) for k in "fm"]


def fit_boosted(
    target: DataFrame, features: DataFrame, columns: Sequence[str], rounds: int = 20, depth: int = 3,
    learning_rate: float = 0.1, seed: int = 42, row_share: float = 1.0,
) -> PipelineModel:
    """Pooled gradient-boosted trees over all sectors; null features are a value of their own, ``row_share`` of the rows feed a tree."""
    rows, inputs = _complete(features.join(target.select(*KEYS, "Target").filter(F.col("Target").isNotNull()), KEYS), columns)
    rows = reuse(rows.select("Target", *inputs))
    assemble = VectorAssembler(inputCols=inputs, outputCol="_features")
    trees = GBTRegressor(featuresCol="_features", labelCol="Target", predictionCol="Pred", maxIter=rounds,
                         maxDepth=depth, stepSize=learning_rate, seed=seed, subsamplingRate=row_share)
    try:
        return Pipeline(stages=[assemble, trees]).fit(rows)
    finally:
        rows.unpersist()


def predict_boosted(model: PipelineModel, features: DataFrame, columns: Sequence[str], target: DataFrame | None = None) -> DataFrame:
    """A prediction for every row of ``features``."""
    out = model.transform(_complete(features, columns)[0]).select(*KEYS, "Pred")
    return out.join(target.select(*KEYS, "Target"), KEYS, "left") if target is not None else out
