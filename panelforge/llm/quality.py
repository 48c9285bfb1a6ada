"""Quality scores by naive Bayes support vectors: a linear hinge-loss model on n-gram indicators scaled by log-count ratios.

The grams are bytes (one to four), so case, punctuation, tables and broken text show whatever the language.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.grams import mix, rolled
from panelforge.llm.linear import feature_rows, fit_in_one_task, fold, labelled_sample, score_documents

#: Number of weights.
DIMENSIONS = 1 << 20
#: Labelled documents used for training, at most.
SAMPLE = 6000
GRAMS = (1, 2, 3, 4)


def byte_grams(raw: bytes) -> np.ndarray:
    """The distinct numbers of the byte n-grams of a text."""
    symbols = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    seen = np.zeros(DIMENSIONS, dtype=bool) if len(raw) > 200_000 else None
    parts = [(mix(rolled(symbols, k) + np.uint64(k)) >> np.uint64(44)).astype(np.int32) for k in GRAMS]
    if seen is None:
        return np.unique(np.concatenate(parts))
    for part in parts:
        seen[part] = True
    return np.flatnonzero(seen).astype(np.int32)


def nb_svm(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, epochs: int = 12) -> dict[str, np.ndarray]:
    """Dual coordinate descent for the hinge loss; a fifth of the sample calibrates the margins to probabilities."""
    rng = np.random.default_rng(0)
    order = rng.permutation(len(rows))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    counts = {c: np.ones(DIMENSIONS) for c in (0, 1)}
    for i in train:
        counts[int(y[i] > 0)][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sign = np.where(y > 0, 1.0, -1.0)
    n_one = max(1, int((y[train] > 0).sum()))
    n_zero = max(1, len(train) - n_one)
    upper = np.where(y > 0, cost * len(train) / (2 * n_one), cost * len(train) / (2 * n_zero))
    values = {i: _scaled(ratio, rows[i]) for i in train}
    w, dual, bias = np.zeros(DIMENSIONS), np.zeros(len(rows)), 0.0
    for _ in range(epochs):
        for i in rng.permutation(train):
            x = values[i]
            slope = sign[i] * (w[rows[i]] @ x + bias) - 1
            new = min(max(dual[i] - slope / 2.0, 0.0), upper[i])  # x has length 1, and the bias is one more feature
            if new != dual[i]:
                change = (new - dual[i]) * sign[i]
                w[rows[i]] += change * x
                bias += change
                dual[i] = new
    margins = np.array([w[rows[i]] @ _scaled(ratio, rows[i]) + bias for i in held])
    slope, shift = _calibrate(margins, y[held] > 0)
    kept = (w * ratio).astype(np.float64)
    return {"weight": kept, "ratio": ratio, "tail": np.array([bias, slope, shift])}


def _scaled(ratio: np.ndarray, row: np.ndarray) -> np.ndarray:
    x = ratio[row]
    length = np.sqrt(x @ x)
    return x / length if length else x


def _calibrate(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the margins of held documents, by Newton steps with a small ridge."""
    if not len(margins) or positive.all() or not positive.any():
        return 2.0, 0.0
    a, b, t = 2.0, 0.0, positive.astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([((p - t) * margins).sum() + 1e-2 * (a - 2), (p - t).sum() + 1e-2 * b])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margins**2).sum() + 1e-2, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Learns from labels whose doc_id's checksum leaves another remainder than 1 by three; at most ``sample`` documents.

    Without a labelled document every text gets the score 0.5.
    """
    chosen = labelled_sample(docs, labels, "quality", fold("doc_id", 3) != 1, sample)
    return fit_in_one_task(feature_rows(chosen, byte_grams), nb_svm)


def quality_scores(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Adds ``score``, the probability of good quality, to any table with a ``text``; only the text decides.

    Null and empty texts have no gram and get the score of the bias; equal texts get equal scores; other columns stay.
    """
    if not model:
        return score_documents(docs, lambda raw: 0.5)
    weight, square = model["weight"].astype(np.float32), (model["ratio"] ** 2).astype(np.float32)
    bias, slope, shift = map(float, model["tail"])

    def score(raw: bytes) -> float:
        at = byte_grams(raw)
        length = float(np.sqrt(square[at].sum())) if len(at) else 0.0
        margin = (float(weight[at].sum()) / length if length else 0.0) + bias
        return float(1 / (1 + np.exp(-np.clip(slope * margin + shift, -700, 700))))
    return score_documents(docs, score)


def op4_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; fold 1 of three is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_scores(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
