"""Joins and components that stay spread over the tasks when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.session import ensure_checkpoint_dir

#: A key is heavy from this share of all rows on, so there are at most 2**12 of them, and from so many rows on.
HEAVY_SHARE, HEAVY_ROWS = 2.0**-12, 256


def heavy_limit(total: int) -> int:
    """Rows up to which a key is not heavy."""
    return max(HEAVY_ROWS, int(total * HEAVY_SHARE))


def join_spread(rows: DataFrame, side: DataFrame, keys: Sequence[str], total: int, how: str = "inner") -> DataFrame:
    """Join of ``rows`` with a side that has one row a key and in ``_n`` the number of ``rows`` with that key.

    ``total`` is the number of ``rows``. The side's rows for heavy keys, 2**12 at most, go to every task; all others meet by a shuffle
    in which no key has more than its limit. Null keys meet nothing; with ``how`` "left" they stay where they are.
    """
    keys, limit = list(keys), heavy_limit(total)
    heavy, light = side.filter(F.col("_n") > limit).drop("_n"), side.filter(F.col("_n") <= limit).drop("_n")
    many = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    if how == "inner":
        return many.unionByName(rest.join(light, keys))
    null = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    return many.unionByName(rest.filter(~null).join(light, keys, "left")).unionByName(rest.filter(null), allowMissingColumns=True)


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``id, component`` (the smallest id that links reach) for every row of ``nodes`` (``id``), from links ``a, b``.

    Large-star and small-star steps in turn (Kiveris et al., 2014) move links to the smallest neighbour. A round's links are kept by
    ``checkpoint()``; hubs are joined by ``join_spread``. Raises if ``most_rounds`` do not settle them, instead of a partial result.
    """
    ensure_checkpoint_dir(nodes.sparkSession)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()
    before = state(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = join_spread(both, low, ["u"], 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        kept = join_spread(down, low, ["u"], before[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        e = kept.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).filter("u <> v").distinct().checkpoint()
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("_root"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("_root", "id").alias("component"))
