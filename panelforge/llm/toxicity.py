"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and the L1 term leaves few weights other than zero, which are sent to all tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.grams import BASE, mix, plain_words
from panelforge.llm.linear import feature_rows, fit_in_one_task, fold, labelled_sample, score_documents

#: Number of weights.
DIMENSIONS = 1 << 22
#: Labelled documents used for training, at most.
SAMPLE = 10240
#: Words between the two of a skip-gram, at most.
SKIP = 2


def gram_features(raw: bytes) -> np.ndarray:
    """The distinct feature numbers of a text: words, pairs of neighbours, and pairs with one or two words between.

    Words are runs of letters and digits, with A-Z lower-cased; any other byte of ASCII separates.
    """
    words = plain_words(raw)
    grams = [words]
    for gap in range(1, SKIP + 2):
        if len(words) > gap:
            grams.append(mix((words[:-gap] + np.uint64(min(gap, 2))) * BASE + words[gap:]))
    return np.unique((np.concatenate(grams) >> np.uint64(42)).astype(np.int32))


def packed(features: np.ndarray) -> bytes:
    """Feature numbers in three bytes each."""
    return features.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(raw: np.ndarray) -> np.ndarray:
    """Feature numbers from the bytes of ``packed``."""
    wide = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
    wide[:, :3] = raw.reshape(-1, 3)
    return wide.view("<i4").ravel()


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0,
         epochs: int = 5) -> dict[str, np.ndarray]:
    """FTRL-proximal on presence features, one document at a time; returns the weights other than zero and the intercept.

    The rows are as ``packed`` makes them, as the sample is held whole.
    """
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    bias, order = 0.0, np.random.default_rng(0)
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = unpacked(rows[i])
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(base + bias + w.sum(), -35, 35)))
            g = p - y[i]
            bias -= 0.01 * g
            n[at] = ni + g * g
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = np.flatnonzero(w)
    return {"index": kept.astype(np.int32), "weight": w[kept], "bias": np.array([base + bias])}


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Learns from labels whose doc_id's checksum is not a multiple of five; at most ``sample`` documents.

    Without a labelled document every text gets the score 0.5.
    """
    chosen = labelled_sample(docs, labels, "toxic", fold("doc_id", 5) != 0, sample)
    return fit_in_one_task(feature_rows(chosen, gram_features, packed, slice_rows=64), ftrl, np.uint8)


def toxicity_scores(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Adds ``score``, the probability of being toxic, to any table with a ``text``; only the text decides.

    Null and empty texts get the share of toxic documents, the intercept; equal texts get equal scores; other columns stay.
    """
    index, weight = model.get("index", np.zeros(0, np.int32)), model.get("weight", np.zeros(0))
    bias = float(model["bias"][0]) if "bias" in model else 0.0

    def score(raw: bytes) -> float:
        found = gram_features(raw)
        total = bias
        if len(index):
            at = np.searchsorted(found, index)
            total += float(weight[(at < len(found)) & (found[np.minimum(at, len(found) - 1)] == index)].sum()) if len(found) else 0.0
        return float(1 / (1 + np.exp(-np.clip(total, -700, 700))))
    return score_documents(docs, score)


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; fold 0 of five is held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity_scores(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
