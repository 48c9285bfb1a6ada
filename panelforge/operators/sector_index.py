"""Capitalisation-weighted sector indices and sector fundamentals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import windows as P
from panelforge.operators.marketcap import market_caps
from panelforge.session import dealt

SUMMED = ("MarketCapOpen", "MarketCapClose", "MarketCapHigh", "MarketCapLow", "OutstandingShares", "CorrectionValue")
ORDER_PRICE = ("Date", "Code", "MarketCapClose", "Close", "Volume")


def attach_sector(panel: DataFrame, definition: DataFrame) -> DataFrame:
    """Every stock row keeps its place; unmapped stocks get a null sector. The definition is hashed, so the panel is not sorted for it."""
    return panel.join(definition.select(F.col("Code").cast("string").alias("Code"), "Sector").hint("shuffle_hash"), "Code", "left")


def attach_sector_groups(panel: DataFrame, groups: Mapping[str, Sequence[str]] | DataFrame) -> DataFrame:
    """Ad-hoc groups, as lists of codes or a table ``Code, Sector``; a code may sit in several of them, ungrouped codes drop out."""
    if not isinstance(groups, DataFrame):
        rows = [(code, sector) for sector, codes in groups.items() for code in codes]
        groups = panel.sparkSession.createDataFrame(rows, "Code string, Sector string")
    return panel.join(groups.select("Code", "Sector"), "Code")


def aggregate_index(sector_panel: DataFrame, *also: Column) -> DataFrame:
    """Index level and OHLC per (Date, Sector), with further aggregates of the members on demand.

    The stock rows collapse in a map-side partial sum; the windows see one row per
    sector and day.
    """
    base = sector_panel.filter(F.col("Sector").isNotNull()).groupBy("Date", "Sector").agg(
        *[F.sum(c).alias(c) for c in SUMMED], *also)
    return index_from_base(base)


def index_from_base(base: DataFrame) -> DataFrame:
    previous = P.shift("MarketCapClose", 1, "Sector")
    out = base.withColumn("1d_return", F.try_divide(F.col("MarketCapClose"), previous + F.col("CorrectionValue")) - 1)
    out = out.withColumn("1d_rate", F.col("1d_return") + 1)
    out = out.withColumn("Close", P.cumprod("1d_rate", "Sector"))
    scaled = {
        x: F.coalesce(F.try_divide(F.col("Close") * F.col(f"MarketCap{x}"), F.col("MarketCapClose")), F.lit(1.0))
        for x in ("Open", "High", "Low")
    }
    return out.withColumns(scaled)


def order_prices(caps: DataFrame) -> DataFrame:
    return caps.select(*ORDER_PRICE)


def sector_index(
    price: DataFrame, fin: DataFrame, definition: DataFrame, days: DataFrame | None = None, parts: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Sector index and the per-stock table used for order sizing, from one capitalisation plan."""
    caps = market_caps(price, fin, days, parts=parts)
    return aggregate_index(attach_sector(caps, definition)), order_prices(caps)


def sector_index_by_groups(caps: DataFrame, groups: Mapping[str, Sequence[str]] | DataFrame) -> DataFrame:
    return aggregate_index(attach_sector_groups(caps, groups))


def size_factor(caps: DataFrame, definition: DataFrame) -> DataFrame:
    """Mean member capitalisation of each sector and day."""
    members = caps.join(definition.select("Code", "Sector"), "Code")
    return members.groupBy("Date", "Sector").agg(F.avg("MarketCapClose").alias("MarketCapAtClose"))


def fundamentals_as_of(price: DataFrame, fin: DataFrame, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """Backward as-of: price days and disclosure days of a code, carried forward.

    A union with a row kind and one window per code; disclosure-only days stay in
    the result, as in a full outer join.
    """
    values = [c for c in price.columns if c not in ("Date", "Code")]
    tagged = price.unionByName(fin.select("Date", "Code", *columns), allowMissingColumns=True)
    per_day = dealt(tagged, parts, "Code").groupBy("Date", "Code").agg(*[F.max(c).alias(c) for c in (*values, *columns)])
    return per_day.withColumns({c: P.ffill(c, "Code") for c in columns})


def sector_fundamentals(price: DataFrame, fin: DataFrame, definition: DataFrame) -> DataFrame:
    """Mean capitalisation and capitalisation-weighted forecast EPS per (Date, Sector).

    The weight sum also covers stocks without a forecast.
    """
    as_of = fundamentals_as_of(price.select("Date", "Code", "Close"), fin, ["OutstandingShares", "ForecastEPS"])
    rows = attach_sector(as_of, definition).filter(F.col("Sector").isNotNull())
    rows = rows.withColumn("MarketCap", F.col("Close") * F.col("OutstandingShares"))
    weighted = F.try_divide(F.sum(F.col("ForecastEPS") * F.col("MarketCap")), F.sum("MarketCap"))
    return rows.groupBy("Date", "Sector").agg(
        F.avg("MarketCap").alias("MarketCap"), F.coalesce(weighted, F.lit(0.0)).alias("ForecastEPS"))


def eps_factor(price: DataFrame, fin: DataFrame, definition: DataFrame, parts: int | None = None) -> DataFrame:
    """Mean forecast EPS per sector on trading days, each code filled forward then backward."""
    marks = price.select("Date", "Code", F.lit(1).alias("_traded"))
    as_of = fundamentals_as_of(marks, fin, ["ForecastEPS"], parts)
    as_of = as_of.withColumn("ForecastEPS", P.bfill("ForecastEPS", "Code")).filter(F.col("_traded") == 1)
    joined = as_of.join(definition.select("Code", "Sector"), "Code")
    return joined.groupBy("Date", "Sector").agg(F.avg("ForecastEPS").alias("ForecastEPS"))
