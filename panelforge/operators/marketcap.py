"""Market capitalisation of each stock: shares as of period ends, corporate actions, index correction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import windows as P
from panelforge.session import dealt
from panelforge.sources.upserts import keep_one, total_order

# Codes whose share count needs no rescaling up to a day.
SHARE_RATE_OVERRIDES = (("3064", "2013-07-25"), ("6920", "2013-08-09"))


def business_day_map(days: DataFrame) -> DataFrame:
    """Every natural day up to the last business day, with the first business day on or after it.

    One row per calendar day: the window runs over the calendar, whose length does
    not depend on the number of stocks.
    """
    w = Window.orderBy("Date")
    ordered = days.select("Date").distinct().withColumn("_prev", F.lag("Date").over(w))
    start = F.coalesce(F.date_add("_prev", 1), F.date_sub("Date", 31))
    return ordered.select(F.explode(F.sequence(start, F.col("Date"))).alias("Day"), F.col("Date").alias("OpenDay"))


def shares_at_period_end(fin: DataFrame) -> DataFrame:
    """Last disclosure of each (period end, code), dated the day after the period."""
    rows = fin.select("Code", "Date", "OutstandingShares", "CurrentPeriodEndDate").filter(
        F.col("CurrentPeriodEndDate").isNotNull())
    order = [F.col("Date").desc_nulls_last(), *total_order(rows, skip=("Code", "Date", "CurrentPeriodEndDate"))]
    latest = keep_one(rows, ["CurrentPeriodEndDate", "Code"], order)
    return latest.select("Code", "OutstandingShares", F.date_add("CurrentPeriodEndDate", 1).alias("Day"))


def snap_to_business_day(shares: DataFrame, days: DataFrame) -> DataFrame:
    """Forward as-of: null when the calendar has no later business day."""
    return shares.join(business_day_map(days), "Day", "left").select(
        F.col("OpenDay").alias("Date"), "Code", "OutstandingShares", "Day")


def attach_shares(price: DataFrame, fin: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Share counts on the first business day after each period end.

    ``days`` is the trading calendar; without it the dates of ``price`` serve.
    """
    shares = snap_to_business_day(shares_at_period_end(fin), days if days is not None else price.select("Date"))
    shares = shares.filter(F.col("Date").isNotNull())
    # Two period ends can snap to the same business day: the later one with a share count holds.
    shares = shares.groupBy("Date", "Code").agg(
        F.max_by("OutstandingShares", F.when(F.col("OutstandingShares").isNotNull(), F.col("Day"))).alias("OutstandingShares"))
    # Code first: the merge order of the join is the order of every later window.
    return price.join(shares.withColumn("isSettlementDay", F.lit(True)), ["Code", "Date"], "left").withColumn(
        "isSettlementDay", F.coalesce("isSettlementDay", F.lit(False)))


def _nth_event(value: str, n: int) -> Column:
    """``value`` of the n-th marked row before (or, negative, after) this one; unmarked rows hold null."""
    side = "lag" if n > 0 else "lead"
    return F.expr(f"{side}({value}, {abs(n)}) IGNORE NULLS OVER (PARTITION BY Code ORDER BY Date)")


def add_share_rates(
    with_shares: DataFrame, settlement_only: bool = True, overrides: Sequence[tuple[str, str]] = SHARE_RATE_OVERRIDES,
) -> DataFrame:
    """Share-count ratios at settlement days, kept only where a split factor lies next to them.

    Events are the rows with a share count or a split.  An event's ratio is the next
    event's count over its own, set to 1 when none of the two events on either side
    is a split; it takes effect on the row before the following settlement day.
    Everything is a null-skipping offset on the one (Code, Date) order, so the panel
    is neither filtered into a second branch nor joined back.
    ``settlement_only=False`` lets split days carry ratios too.
    """
    shares, factor = F.col("OutstandingShares"), F.col("AdjustmentFactor")
    event = shares.isNotNull() | (factor != 1)
    out = with_shares.withColumn("_count", P.bfill("OutstandingShares", "Code"))
    # Structs keep an event apart from a row without one even when its value is missing.
    out = out.withColumns({"_c": F.when(event, F.struct(F.col("_count").alias("v"))), "_f": F.when(event, factor)})
    out = out.withColumns({f"_f{n}": _nth_event("_f", n) for n in (1, 2, -1, -2)} | {"_next": _nth_event("_c", -1)})
    quiet = F.lit(True)
    for n in (1, 2, -1, -2):
        quiet = quiet & (F.coalesce(F.col(f"_f{n}"), F.lit(1.0)) == 1)
    ratio = F.when(quiet, 1.0).otherwise(F.bround(F.try_divide(F.col("_next.v"), F.col("_count")), 1))
    carrier = F.col("isSettlementDay") if settlement_only else event
    out = out.withColumn("EventRate", F.when(event, ratio)).withColumn("_r", F.when(carrier, F.struct(F.col("EventRate").alias("v"))))
    out = out.withColumn("_before", F.when(carrier, _nth_event("_r", 1)))
    rate = F.coalesce(P.shift(F.col("_before.v"), -1, "Code"), F.lit(1.0))
    out = out.withColumn("SharesRate", rate)
    for code, last_day in overrides:
        hit = (F.col("Code") == code) & (F.col("Date") <= F.lit(last_day).cast("date"))
        out = out.withColumn("SharesRate", F.when(hit, 1.0).otherwise(F.col("SharesRate")))
    counts = shares if settlement_only else F.when(event, F.col("_count"))
    temporary = [c for c in out.columns if c.startswith("_")]
    return out.withColumn("OutstandingShares", counts).drop(*temporary)


def adjust_shares(df: DataFrame) -> DataFrame:
    """Fill share counts both ways and scale them by the ratios still ahead."""
    filled = df.withColumn("OutstandingShares", P.fill_both("OutstandingShares", "Code"))
    return filled.withColumn("CumulativeSharesRate", P.product_from_here("SharesRate", "Code")).withColumn("OutstandingShares", F.col("OutstandingShares") * F.col("CumulativeSharesRate")).drop(
        "SharesRate", "CumulativeSharesRate")


def add_market_caps(df: DataFrame) -> DataFrame:
    return df.withColumns({f"MarketCap{x}": F.col(x) * F.col("OutstandingShares") for x in ("Open", "Close", "High", "Low")})


def add_correction(df: DataFrame) -> DataFrame:
    """Part of today's cap that comes from a changed share count (the whole cap on the first row)."""
    before = F.coalesce(P.previous("OutstandingShares", "Code"), F.lit(0.0))
    return df.withColumn("CorrectionValue", F.col("MarketCapClose") - F.col("Close") * before)


def market_caps(
    price: DataFrame, fin: DataFrame, days: DataFrame | None = None, settlement_only: bool = True,
    overrides: Sequence[tuple[str, str]] = SHARE_RATE_OVERRIDES, parts: int | None = None,
) -> DataFrame:
    """Daily capitalisation of every stock.

    All windows run on (Code, Date); with the panel partitioned by Code once, the
    chain needs no further exchange of the price rows, and two sorts: the order of
    the join serves everything up to the share counts, one turn to the descending
    order serves the cumulative ratio and the correction. ``parts`` is the number of
    partitions by Code; a task holds the rows of one.
    """
    rates = add_share_rates(attach_shares(dealt(price, parts, "Code"), fin, days), settlement_only, overrides)
    return add_correction(add_market_caps(adjust_shares(rates))).drop("isSettlementDay", "EventRate")


PANEL = ("Date", "Code", "Open", "High", "Low", "Close", "Volume", "TurnoverValue", "AdjustmentFactor", "OutstandingShares",
         "MarketCapOpen", "MarketCapClose", "MarketCapHigh", "MarketCapLow", "CorrectionValue")


def _quiet_correction() -> Column:
    """``CorrectionValue`` of a day whose share count is that of the day before, as ``add_correction`` computes it."""
    return F.col("Close") * F.col("OutstandingShares") - F.col("Close") * F.coalesce(F.col("OutstandingShares"), F.lit(0.0))


def fold_quiet_days(caps: DataFrame, day: str) -> DataFrame:
    """Rows of ``market_caps`` without the days that follow from the day before, and without capitalisations.

    ``day`` numbers the business days. A day is left out when it is next to the day before, repeats its close and share count, and has
    neither volume nor split; ``_n`` of a row counts itself and the days left out after it. ``unfold_quiet_days`` restores all rows.
    """
    w = P.backwards("Code", day)
    before = lambda c: F.lead(c, 1).over(w)
    quiet = before(day) == F.col(day) - 1
    for c in ("Open", "High", "Low", "Close"):
        quiet = quiet & F.col(c).eqNullSafe(before("Close"))
    quiet = quiet & (F.col("Volume") == 0) & (F.col("TurnoverValue") == 0) & (F.col("AdjustmentFactor") == 1)
    quiet = quiet & F.col("OutstandingShares").eqNullSafe(before("OutstandingShares")) & F.col("CorrectionValue").eqNullSafe(_quiet_correction())
    rows = caps.withColumns({"_kept": ~F.coalesce(quiet, F.lit(False)), "_row": F.row_number().over(w)})
    later = F.last(F.when(F.col("_kept"), F.col("_row")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_n", F.col("_row") - F.coalesce(later, F.lit(0))).filter("_kept")
    return rows.drop("Date", "_kept", "_row", *[c for c in PANEL if c.startswith("MarketCap")])


def unfold_quiet_days(folded: DataFrame, day: str, days: Column) -> DataFrame:
    """All rows of the panel; ``days`` is the array of the business days that ``day`` numbers from 0."""
    rows = folded.select("*", F.posexplode(F.slice(days, F.col(day) + 1, F.col("_n"))).alias("_pos", "Date"))
    first = F.col("_pos") == 0
    rest = {c: F.col("Close") for c in ("Open", "High", "Low")} | {"Volume": F.lit(0.0), "TurnoverValue": F.lit(0.0), "AdjustmentFactor": F.lit(1.0),
                                                                   "CorrectionValue": _quiet_correction()}
    rows = rows.withColumns({c: F.when(first, F.col(c)).otherwise(x) for c, x in rest.items()})
    return add_market_caps(rows).select(*PANEL)
