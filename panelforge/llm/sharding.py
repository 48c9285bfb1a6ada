"""Reproducible shuffle into shards: a keyed Feistel permutation of global row numbers.

Built from DataFrame expressions only. Given the number of rows, the seed and the number of shards, the place of any row number
can be computed without the data, and so can the row number of any place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Row numbers are handed out bucket by bucket.
BUCKETS = 4096
ROUNDS = 6


def number_rows(df: DataFrame, columns: list[str], buckets: Column | None = None) -> DataFrame:
    """Distinct numbers from 0 without gaps for all rows, in the column ``row``, which depend on the values only.

    Equal rows are counted before they are shuffled and numbered as one run, so a row that occurs very often costs one record a
    task. Nulls are values like others; an empty input gives an empty result. ``buckets`` replaces the hash that deals rows to
    buckets, which are numbered in turn.
    """
    bucket = (F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)) if buckets is None else buckets).alias("_bucket")
    counted = df.groupBy(bucket, *columns).agg(F.count(F.lit(1)).alias("_times"))
    before = F.sum("_times").over(Window.partitionBy("_bucket").orderBy(*columns)) - F.col("_times")
    sums = counted.groupBy("_bucket").agg(F.sum("_times").alias("_sum"))
    # One row a bucket: a bounded window.
    starts = sums.select("_bucket", (F.sum("_sum").over(Window.orderBy("_bucket")) - F.col("_sum")).alias("_start"))
    placed = counted.withColumn("_before", before).join(starts, "_bucket")
    return placed.select(*columns, F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("_copy"), "_start", "_before").select(
        *columns, (F.col("_start") + F.col("_before") + F.col("_copy")).alias("row"))


def _halves(n: int) -> tuple[int, int]:
    left = math.isqrt(max(n - 1, 0)) + 1
    return left, max(1, -(-n // left))


def _step(value: Column, number: int, seed: int, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(number), value), F.lit(modulus))


def _permute(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """One pass through the network over the smallest rectangle of at least ``n`` cells."""
    left, right = _halves(n)
    df = df.withColumns({"_l": F.col(column).cast("long") / F.lit(right), "_r": F.pmod(F.col(column), F.lit(right))})
    df = df.withColumn("_l", F.floor("_l"))
    for i in range(ROUNDS):
        if i % 2:
            df = df.withColumn("_r", F.pmod(F.col("_r") + _step(F.col("_l"), i, seed, right), F.lit(right)))
        else:
            df = df.withColumn("_l", F.pmod(F.col("_l") + _step(F.col("_r"), i, seed, left), F.lit(left)))
    return df.withColumn("_next", F.col("_l") * F.lit(right) + F.col("_r")).drop("_l", "_r")


def _walks(spark: SparkSession, n: int, seed: int) -> int:
    """Passes after the first that bring every row below ``n``: the longest walk through the surplus cells of the rectangle.

    Each pass takes one more cell out of every path that leads back; once none leaves, only closed loops remain, which no row enters.
    """
    left, right = _halves(n)
    cells, steps, held = spark.range(n, left * right).withColumnRenamed("id", "_at"), 0, left * right - n
    while held:
        cells = _permute(cells, "_at", n, seed).filter(F.col("_next") >= n).select(F.col("_next").alias("_at"))
        before, held = held, cells.count()
        if held == before:
            break
        steps += 1
    return steps


def permute_rows(df: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """Adds ``position``, a permutation of 0 .. n - 1, for the row number in ``column``; cells beyond n - 1 walk on."""
    df = _permute(df, column, n, seed).withColumnRenamed("_next", "position")
    for _ in range(_walks(df.sparkSession, n, seed)):
        df = _permute(df, "position", n, seed).withColumn(
            "position", F.when(F.col("position") >= n, F.col("_next")).otherwise(F.col("position"))).drop("_next")
    return df


def feistel_shards(df: DataFrame, columns: list[str], shards: int, seed: int = 0) -> DataFrame:
    """All rows, reduced to ``columns``, with ``row``, ``position``, ``shard`` and ``slot``.

    Rows are numbered, the numbers permuted, and position p goes to shard p mod ``shards``, slot p div ``shards``: sizes differ by
    one row at most and slots have no gaps. Equal rows share a run of numbers; null columns count as values.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    n = df.count()
    numbered = permute_rows(number_rows(df, columns), "row", max(n, 1), seed)
    return numbered.withColumns({
        "shard": F.pmod(F.col("position"), F.lit(shards)).cast("int"), "slot": F.floor(F.col("position") / F.lit(shards)).cast("long")})


def op9_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shards under the law ``rows``; a null text has size 1 and the checksum of the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = feistel_shards(docs, ["doc_id", "size", "text_crc32"], 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
