"""Incremental maintenance of stored tables.

Every "keep one row per key" step is ``row_number() = 1``: Spark trims each key
to one row per map task before the shuffle, so a key holding a large share of
the rows never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def total_order(df: DataFrame, skip: Sequence[str] = ()) -> list[Column]:
    """Every column ascending, a tie-break that leaves only identical rows undecided."""
    return [F.col(c).asc_nulls_last() for c in df.columns if c not in skip]


def upsert_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Concatenate, drop rows without a code, keep the stored row of a (Date, Code)."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    both = both.filter(F.col("Code").isNotNull())
    ties = total_order(both, skip=("_src", "Date", "Code"))
    return keep_one(both, ["Date", "Code"], [F.col("_src"), *ties]).drop("_src")


def upsert_disclosures(old: DataFrame, new: DataFrame, key: str = "DisclosureNumber") -> DataFrame:
    """New disclosures replace stored ones; everything is kept as text."""
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    old, new = text(old), text(new)
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_listing(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched codes are listed, codes that vanished stay with ``Listing`` 0."""
    gone = stored.drop("Listing").join(fetched.select("Code").distinct(), "Code", "left_anti")
    return fetched.drop("Listing").withColumn("Listing", F.lit(1).cast("long")).unionByName(
        gone.withColumn("Listing", F.lit(0).cast("long")), allowMissingColumns=True
    )


PRICE_COLUMNS = ("Open", "Close", "High", "Low")


def upsert_series(
    old: DataFrame, new: DataFrame, keys: Sequence[str] = ("Name", "Date"), numeric: Sequence[str] = PRICE_COLUMNS,
) -> DataFrame:
    """Dates present in the new extract replace stored ones; text numbers are coerced; columns left without a value go.

    A new row without a value replaces nothing. Within the new extract the row with the largest ``_seq`` wins; without
    ``_seq`` rows have no order and the first in total order is taken.
    """
    keys = list(keys)
    new = new.dropna(how="all", subset=[c for c in new.columns if c not in keys and c != "_seq"])
    both = old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
    values = [c for c in both.columns if c not in keys and c != "_seq"]
    both = both.dropna(how="all", subset=values)
    for c in numeric:
        if c in both.columns:
            both = both.withColumn(c, F.regexp_replace(F.col(c).cast("string"), ",", "").try_cast("double"))
    order = [F.col("_seq").desc_nulls_last()] if "_seq" in both.columns else []
    return drop_empty_columns(keep_one(both, keys, order + total_order(both, skip=(*keys, "_seq"))), (*keys, "_seq"))


def append_latest(history: DataFrame, latest: DataFrame, keys: Sequence[str] = ("Name", "Date")) -> DataFrame:
    """Downloaded history plus the page's latest quote, the latter wins on its date."""
    both = history.withColumn("_src", F.lit(0)).unionByName(latest.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, list(keys), [F.col("_src").desc(), *total_order(both, skip=("_src", *keys))]).drop("_src")


def upsert_daily_ledger(ledger: DataFrame, today: DataFrame, trade_dates: DataFrame) -> DataFrame:
    """Set today's row, then keep only the days something was traded."""
    kept = ledger.join(today.select("Date").distinct(), "Date", "left_anti").unionByName(today)
    return kept.join(trade_dates.select("Date").distinct(), "Date", "left_semi")


def append_trades(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append fills and drop full-row repeats."""
    return history.unionByName(fresh).dropDuplicates()


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ("Name", "Date")) -> DataFrame:
    """Drop value columns without a single value: one counting pass, one row to the driver."""
    candidates = [c for c in df.columns if c not in keep]
    counts = df.agg(*[F.count(c).alias(c) for c in candidates]).first().asDict()
    return df.select(*[c for c in df.columns if c in keep or counts[c] > 0])
