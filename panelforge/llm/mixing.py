"""Mixing of sources to target weights by temperature, from DataFrame expressions only.

The weight of a source is its share of all tokens to the power ``alpha``, normalised. ``alpha`` is found by repeated section of an
interval: every pass tries 15 exponents in one aggregate over the table of sources, so the table never leaves the cluster.
The weights are then realised document by document: each source is cut into 1024 blocks, every epoch permutes the blocks anew, and
a source is given whole epochs and, of the last one, the first blocks up to its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.columns import put_back, set_aside
from panelforge.session import stage

BLOCKS = 1024
_TRIALS = 15
_PASSES = 9
#: Words are runs of characters outside these.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_shares(docs: DataFrame) -> DataFrame:
    """One row a source (null is one) with ``tokens``, ``documents`` and its share of all tokens."""
    totals = stage(docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "mix-sources")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    return totals.withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1))))


def _entropy(alpha: float) -> Column:
    power = F.pow("share", F.lit(alpha))
    total = F.sum(power)
    return F.log(total) - F.lit(alpha) * F.sum(power * F.log("share")) / total


def _repetition(alpha: float, budget: float | None, tokens: int) -> Column:
    """Most passes over a source, against one pass over the least repeated one, or within a given budget."""
    passes = F.pow("share", F.lit(alpha - 1.0))
    if budget is None:
        return F.max(passes) / F.min(passes)
    return F.max(passes) * F.lit(budget / max(tokens, 1)) / F.sum(F.pow("share", F.lit(alpha)))


def find_exponent(shares: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None,
                  budget: float | None = None, tokens: int = 0) -> float:
    """The exponent that meets the target: the largest in 0 .. 16 with at least that entropy (in nats), or the smallest in 0 .. 1
    (the flattest mix) in which no source is passed over more often than ``max_repetition``.

    A target out of reach gives the nearest end. With one source or none the exponent is 1.
    """
    if (target_entropy is None) == (max_repetition is None):
        raise ValueError("give one target")
    live = shares.filter(F.col("share") > 0)
    low, high = (0.0, 16.0) if target_entropy is not None else (0.0, 1.0)
    if live.limit(2).count() < 2:
        return 1.0
    for _ in range(_PASSES):
        tries = [low + (high - low) * i / (_TRIALS + 1) for i in range(_TRIALS + 2)]
        found = live.agg(*[
            (_entropy(a) if target_entropy is not None else _repetition(a, budget, tokens)).alias(f"t{i}")
            for i, a in enumerate(tries)]).first()
        if target_entropy is not None:
            fits = [i for i in range(len(tries)) if found[i] >= target_entropy - 1e-12]
            at = max(fits, default=0)
            low, high = tries[at], tries[min(at + 1, len(tries) - 1)]
        else:
            fits = [i for i in range(len(tries)) if found[i] <= max_repetition + 1e-12]
            at = min(fits, default=len(tries) - 1)
            low, high = tries[max(at - 1, 0)], tries[at]
    return low if target_entropy is not None else high


def temperature_mix(docs: DataFrame, target_entropy: float | None = None, max_repetition: float | None = None,
                    budget: int | None = None, seed: int = 0) -> DataFrame:
    """One row for every copy of a document in the mix, with all its columns and ``weight``, ``epoch``, ``block_rank``.

    ``docs`` has ``doc_id``, ``source`` and ``tokens``. Without a ``budget`` in tokens the smallest one is taken that shows every
    document at least once. Blocks are dealt by the hash of doc_id, so a source's realised tokens are within one block of its
    budget. ``block_rank`` is the block's place in its epoch's permutation. A null source is a source. Documents of sources without
    tokens weigh nothing and are shown once, with weight 0. Equal rows are dealt alike. An empty table gives an empty mix. Other
    columns stay, whatever their names; one that has the name of an output is replaced.
    """
    columns, used = docs.columns, ["doc_id", "source", "tokens"]
    docs = set_aside(docs, used)
    shares = source_shares(docs)
    totals = shares.agg(F.sum("tokens").alias("t")).first()
    tokens = totals["t"] or 0
    alpha = find_exponent(shares, target_entropy, max_repetition, budget, tokens)
    live = F.col("share") > 0
    scaled = shares.withColumn("_power", F.when(live, F.pow("share", F.lit(alpha))))
    norm = scaled.agg(F.sum("_power").alias("z"), F.max(F.col("tokens") / F.col("_power")).alias("b")).first()
    z = norm["z"] or 1.0
    whole = float(budget) if budget is not None else (norm["b"] or 0.0) * z
    weighted = scaled.select(
        "source", F.coalesce(F.col("_power") / F.lit(z), F.lit(0.0)).alias("weight"),
        F.when(live, F.col("_power") / F.lit(z) * F.lit(whole) / F.col("tokens")).otherwise(1.0).alias("_passes"))
    weighted = weighted.withColumn("_full", F.floor(F.col("_passes") + 1e-9))
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BLOCKS))
    dealt = docs.withColumn("_block", block)
    blocks = dealt.groupBy("source", "_block").agg(F.sum("tokens").alias("_tokens"))
    epochs = _null_safe(blocks, weighted).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_full")))).withColumn(
        "_order", F.xxhash64(F.lit(seed), "source", "epoch", "_block"))
    # 1024 rows at most in each window.
    turn = Window.partitionBy("source", "epoch").orderBy("_order", "_block")
    every = Window.partitionBy("source", "epoch")
    plan = epochs.withColumns({
        "block_rank": F.row_number().over(turn), "_before": F.sum("_tokens").over(turn) - F.col("_tokens"),
        "_all": F.sum("_tokens").over(every)})
    rest = (F.col("_passes") - F.col("_full")) * F.col("_all")
    plan = plan.filter((F.col("epoch") < F.col("_full")) | (F.col("_before") < rest - 1e-6)).select(
        "source", "_block", "weight", "epoch", "block_rank")
    return put_back(_null_safe(dealt, plan, "_block"), columns, used, ["weight", "epoch", "block_rank"])


def _null_safe(left: DataFrame, right: DataFrame, *also: str) -> DataFrame:
    """Inner join on ``source``, where null meets null, and on further columns."""
    right = right.withColumnsRenamed({c: f"_{c}_right" for c in ("source", *also)})
    on = left["source"].eqNullSafe(right["_source_right"])
    for c in also:
        on = on & (left[c] == right[f"_{c}_right"])
    return left.join(right, on).drop("_source_right", *(f"_{c}_right" for c in also))


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattest mix of the documents' sources that repeats none more than four times; every document is shown."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.select("doc_id", "source", word_count(F.col("text")).alias("tokens"))
    return temperature_mix(docs, max_repetition=4.0)
