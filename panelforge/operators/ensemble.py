"""Combining predictions of several models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import windows as P

KEYS = ["Date", "Sector"]
Weighted = Sequence[tuple[DataFrame, float]]


def normalise_weights(inputs: Weighted) -> list[tuple[DataFrame, float]]:
    if not inputs:
        raise ValueError("at least one prediction is needed")
    total = sum(w for _, w in inputs)
    if total <= 0:
        raise ValueError("the weights must sum to more than 0")
    return [(df, w / total) for df, w in inputs]


def unmatched_keys(inputs: Weighted) -> DataFrame:
    """Keys that some model lacks; empty when the predictions line up."""
    marks = [df.select(*KEYS, F.lit(1).alias("_one")) for df, _ in inputs]
    counted = reduce(DataFrame.unionByName, marks).groupBy(*KEYS).agg(F.count("_one").alias("Models"))
    return counted.filter(F.col("Models") != len(inputs))


def check_keys(inputs: Weighted) -> None:
    """One job up front, for callers that want the strict check before combining."""
    if not unmatched_keys(inputs).isEmpty():
        raise ValueError("all predictions must share the same (Date, Sector) keys")


def _weighted_sum(parts: Sequence[DataFrame]) -> DataFrame:
    """Sum of ``_v`` over the models in one aggregate, no chain of joins.

    A key that a model lacks, or has twice, fails the query: a mix of fewer models is not the mix asked for.
    """
    both = reduce(DataFrame.unionByName, [p.withColumn("_model", F.lit(1 << i)) for i, p in enumerate(parts)])
    total = both.groupBy(*KEYS).agg(F.sum("_v").alias("_sum"), F.count(F.lit(1)).alias("_n"), F.bit_or("_model").alias("_models"))
    whole = (F.col("_n") == len(parts)) & (F.col("_models") == (1 << len(parts)) - 1)
    refused = F.raise_error(F.lit("all predictions must share the same (Date, Sector) keys")).cast("double")
    return total.select(*KEYS, F.when(whole, F.col("_sum")).otherwise(refused).alias("Pred"))


def by_value(inputs: Weighted) -> DataFrame:
    """Weighted mean of the predictions."""
    return _weighted_sum([df.select(*KEYS, (F.col("Pred") * w).alias("_v")) for df, w in normalise_weights(inputs)])


def by_rank(inputs: Weighted) -> DataFrame:
    """Weighted mean of descending ranks, ranked descending again (larger is better)."""
    parts = [df.select(*KEYS, (P.rank_avg("Pred", "Date", ascending=False) * w).alias("_v")) for df, w in normalise_weights(inputs)]
    return _weighted_sum(parts).withColumn("Pred", P.rank_avg("Pred", "Date", ascending=False))


def by_vote(inputs: Weighted, top_n: int = 5) -> DataFrame:
    """Points for each model's best ``top_n``, the first place worth ``top_n``."""
    parts = []
    for df, w in normalise_weights(inputs):
        rank = P.rank_avg("Pred", "Date", ascending=False)
        points = F.when(rank <= top_n, (F.lit(top_n + 1) - rank) * w).otherwise(0.0)
        parts.append(df.select(*KEYS, points.alias("_v")))
    return _weighted_sum(parts)


METHODS: dict[str, Callable[..., DataFrame]] = {"by_rank": by_rank, "by_predict_value": by_value, "by_voting": by_vote}


def ensemble(method: str, inputs: Weighted, **params) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; available: {sorted(METHODS)}")
    return METHODS[method](inputs, **params)


def register_method(name: str, fn: Callable[..., DataFrame]) -> None:
    METHODS[name] = fn


def rank_ensemble_dataset(inputs: Weighted) -> DataFrame:
    """Ensembled ranks next to the first model's target, both oriented larger-is-better."""
    target = inputs[0][0].select(*KEYS, P.rank_avg("Target", "Date", ascending=True).alias("Target"))
    return by_rank(inputs).join(target, KEYS)
