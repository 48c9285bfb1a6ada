"""Realised trades: fills to ledger, daily to total profit, tax, leverage, deposits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.functions import windows as P
from panelforge.operators import metrics as M

# Fill types of the brokerage export.
OPEN_BUY, OPEN_SELL, CLOSE_BUY, CLOSE_SELL = "信用新規買", "信用新規売", "信用返済買", "信用返済売"
LONG, SHORT = "買", "売"


def fill_vwap(fills: DataFrame) -> DataFrame:
    """Shares and volume-weighted price per day, side and code."""
    return fills.groupBy("Date", "Type", "Code", "CompanyName").agg(
        F.sum("Shares").alias("Shares"), F.try_divide(F.sum(F.col("Price") * F.col("Shares")), F.sum("Shares")).alias("Price"))


def fill_totals(fills: DataFrame) -> DataFrame:
    """Totals per trade day, symbol, market and type."""
    return fills.groupBy("Date", "CompanyName", "Code", "Market", "Type").agg(
        F.sum("Shares").alias("Shares"), F.sum("Price").alias("Price"), F.sum("Fee").alias("Fee"), F.sum("Tax").alias("Tax"))


def pair_fills(priced: DataFrame) -> DataFrame:
    """Opening and closing fills (see ``fill_vwap``) of a code, day and side next to each other, a missing one counts 0.

    A short is closed by buying back, so its closing fills never meet the same day's long.
    """
    opening = priced.filter(F.col("Type").isin(OPEN_BUY, OPEN_SELL)).select(
        "Date", "Code", F.when(F.col("Type") == OPEN_SELL, SHORT).otherwise(LONG).alias("Side"), "CompanyName",
        "Shares", F.col("Price").alias("AcqPrice"))
    closing = priced.filter(F.col("Type").isin(CLOSE_BUY, CLOSE_SELL)).select(
        "Date", "Code", F.when(F.col("Type") == CLOSE_BUY, SHORT).otherwise(LONG).alias("Side"), "CompanyName",
        F.col("Price").alias("SettlePrice"))
    return opening.join(closing, ["Date", "Code", "Side", "CompanyName"], "full").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast(t)) for c, t in (("Shares", "long"), ("AcqPrice", "double"), ("SettlePrice", "double"))})


def trade_profit(pairs: DataFrame) -> DataFrame:
    """Amounts truncated to integers, profit signed by side, return on the acquired amount."""
    out = pairs.withColumns({
        "AcqAmount": S.truncate_long(F.col("AcqPrice") * F.col("Shares")),
        "SettleAmount": S.truncate_long(F.col("SettlePrice") * F.col("Shares")), "Fee": F.lit(0).cast("long")})
    gross = F.when(F.col("Side") == LONG, F.col("SettleAmount") - F.col("AcqAmount")).when(
        F.col("Side") == SHORT, F.col("AcqAmount") - F.col("SettleAmount"))
    out = out.withColumn("Profit", F.coalesce(gross - F.col("Fee"), F.lit(0).cast("long")))
    return out.withColumn("Rate", F.try_divide(F.col("Profit").cast("double"), F.col("AcqAmount").cast("double")))


def attach_order_sector(trades: DataFrame, orders: DataFrame) -> DataFrame:
    return trades.join(orders.select(F.col("Code").cast("string").alias("Code"), "Sector").distinct(), "Code", "left")


def normalise_cashflows(raw: DataFrame) -> DataFrame:
    """Dashes to 0, separators stripped, net amount; capital-gain tax movements left out."""
    def number(c: str) -> Column:
        text = F.when(F.col(c).cast("string") == "-", "0").otherwise(F.col(c).cast("string"))
        return F.regexp_replace(text, ",", "").cast("long")
    net = number("In") + number("TransferIn") - number("Out") - number("TransferOut")
    return raw.filter(~F.coalesce(F.col("Text").contains(S.CAPITAL_GAIN_TAX_TEXT), F.lit(False))).select(
        S.day(F.col("Date")).alias("Date"), "Text", net.alias("Amount"))


def signed_spot_delta(spots: DataFrame) -> DataFrame:
    """Buying-power change of spot trades, purchases negative."""
    return spots.withColumn("Delta", F.when(F.col("Side") == LONG, -F.col("Delta")).otherwise(F.col("Delta")))


def roll_deposits(opening: float, trade_days: DataFrame, cashflows: DataFrame, spots: DataFrame) -> DataFrame:
    """Deposit balance on every trade day: opening plus all flows since the first one.

    A flow counts on the first trade day on or after it; flows up to the first trade
    day belong to the opening balance.  The deltas are summed per day before the
    running sum, which then covers one row per day.
    """
    days = trade_days.select("Date").distinct().withColumn("_flow", F.lit(0).cast("long")).withColumn("_day", F.lit(True))
    flows = cashflows.select("Date", F.col("Amount").alias("_flow")).unionByName(spots.select("Date", F.col("Delta").alias("_flow")))
    daily = flows.withColumn("_day", F.lit(False)).unionByName(days).groupBy("Date").agg(
        F.sum("_flow").alias("_flow"), F.max("_day").alias("_day"))
    first = F.min(F.when(F.col("_day"), F.col("Date"))).over(Window.partitionBy())
    running = daily.withColumn("_first", first).filter(F.col("Date") >= F.col("_first"))
    running = running.withColumn("_flow", F.when(F.col("Date") == F.col("_first"), F.lit(0)).otherwise(F.col("_flow")))
    total = F.sum("_flow").over(P.ordered([]).rowsBetween(Window.unboundedPreceding, 0))
    return running.withColumn("Deposit", (F.lit(opening) + total).cast("long")).filter("_day").select("Date", "Deposit")


def daily_profit(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cost, profit and tax per day; tax follows the year-to-date profit and never goes below zero in total."""
    by = list(by)
    day = ledger.groupBy(*by, "Date").agg(F.sum("AcqAmount").alias("AcqAmount"), F.sum("Profit").alias("Profit"))
    day = day.withColumn("_year", F.year("Date"))
    year = [*by, "_year"]
    ytd_tax = F.greatest(S.truncate_long(P.cumsum("Profit", year) * S.TAX_RATE), F.lit(0).cast("long"))
    day = day.withColumn("_ytd", ytd_tax)
    day = day.withColumn("DayTax", F.col("_ytd") - F.coalesce(P.shift("_ytd", 1, year), F.lit(0).cast("long")))
    day = day.withColumn("ProfitAfterTax", F.col("Profit") - F.col("DayTax"))
    ratio = lambda c: F.try_divide(F.col(c).cast("double"), F.col("AcqAmount").cast("double"))
    return day.select(*by, "Date", "AcqAmount", "Profit", ratio("Profit").alias("Rate"), "DayTax", "ProfitAfterTax",
                      ratio("ProfitAfterTax").alias("RateAfterTax"))


def daily_profit_by_sector(ledger: DataFrame) -> DataFrame:
    """Daily profit of each sector, repeated for the sides it was traded on."""
    sides = ledger.select("Date", "Side", "Sector").distinct()
    return sides.join(daily_profit(ledger, ["Sector"]), ["Date", "Sector"])


def expanding_mean_deposit(deposits: DataFrame) -> DataFrame:
    return deposits.withColumn("MeanDeposit", S.truncate_long(P.expanding(F.avg, "Deposit", [])))


def daily_leveraged(deposits: DataFrame, daily: DataFrame) -> DataFrame:
    """Profit over the deposited amount."""
    joined = deposits.select("Date", "Deposit").join(daily.select("Date", "Profit", "ProfitAfterTax"), "Date", "left")
    ratio = lambda c: F.try_divide(F.col(c).cast("double"), F.col("Deposit").cast("double"))
    return joined.withColumns({"Rate": ratio("Profit"), "RateAfterTax": ratio("ProfitAfterTax")})


def daily_cumulative(daily: DataFrame) -> DataFrame:
    return daily.select(
        "Date", P.expanding(F.avg, "AcqAmount", []).alias("MeanAcqAmount"), P.cumsum("Profit", []).alias("Profit"),
        (P.cumprod(F.col("Rate") + 1, []) - 1).alias("Rate"), P.cumsum("ProfitAfterTax", []).alias("ProfitAfterTax"),
        (P.cumprod(F.col("RateAfterTax") + 1, []) - 1).alias("RateAfterTax"))


def leveraged_cumulative(deposits: DataFrame, leveraged: DataFrame) -> DataFrame:
    return expanding_mean_deposit(deposits).select("Date", "MeanDeposit").join(leveraged, "Date", "left").select(
        "Date", "MeanDeposit", P.cumsum("Profit", []).alias("Profit"), (P.cumprod(F.col("Rate") + 1, []) - 1).alias("Rate"),
        P.cumsum("ProfitAfterTax", []).alias("ProfitAfterTax"), (P.cumprod(F.col("RateAfterTax") + 1, []) - 1).alias("RateAfterTax"))


def _rates(df: DataFrame, base: str, names: tuple[str, str] = ("Rate", "RateAfterTax")) -> DataFrame:
    ratio = lambda c: F.try_divide(F.col(c).cast("double"), F.col(base).cast("double"))
    return df.withColumns({names[0]: ratio("Profit"), names[1]: ratio("ProfitAfterTax")})


def monthly_profit(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean cost, days and profit per month; months without trades show 0 days and no mean."""
    by = list(by)
    per = daily.groupBy(*by, F.last_day("Date").alias("Date")).agg(
        F.avg("AcqAmount").alias("MeanAcqAmount"), F.count("AcqAmount").alias("Days"),
        F.sum("Profit").alias("Profit"), F.sum("ProfitAfterTax").alias("ProfitAfterTax"))
    out = M.periods(daily, by).join(per, [*by, "Date"], "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(F.col(c), zero) for c in ("Days", "Profit", "ProfitAfterTax")})
    return _rates(out, "MeanAcqAmount")


def monthly_leveraged(deposits: DataFrame, buying_power: DataFrame, leveraged: DataFrame) -> DataFrame:
    """Opening buying power plus the month's mean change of the deposits as the capital base; months without a deposit row show 0 days."""
    month = F.last_day("Date").alias("Date")
    power = buying_power.groupBy(month).agg(F.min_by("BuyingPower", F.col("Date")).alias("_power"))
    deposit = deposits.groupBy(month).agg(
        F.avg("Deposit").alias("_mean"), F.min_by("Deposit", F.col("Date")).alias("_first"), F.count("Deposit").alias("Days"))
    profit = leveraged.groupBy(month).agg(F.sum("Profit").alias("Profit"), F.sum("ProfitAfterTax").alias("ProfitAfterTax"))
    out = M.periods(deposits).join(deposit, "Date", "left").join(power, "Date", "left").join(profit, "Date", "left")
    zero = F.lit(0).cast("long")
    out = out.select("Date", (F.col("_power") + F.col("_mean") - F.col("_first")).alias("MeanDeposit"), F.coalesce("Days", zero).alias("Days"),
                     F.coalesce("Profit", zero).alias("Profit"), F.coalesce("ProfitAfterTax", zero).alias("ProfitAfterTax"))
    return _rates(out, "MeanDeposit")


def total_profit(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row over the whole period (per group); the mean of the ungrouped row is cut to an integer after the returns."""
    out = daily.groupBy(*by).agg(
        F.avg("AcqAmount").alias("MeanAcqAmount"), F.count("AcqAmount").alias("Days"),
        F.sum("Profit").alias("Profit"), F.sum("ProfitAfterTax").alias("ProfitAfterTax"))
    out = _rates(out, "MeanAcqAmount", ("MeanReturn", "MeanReturnAfterTax"))
    return out if by else out.withColumn("MeanAcqAmount", S.truncate_long(F.col("MeanAcqAmount")))


def total_leveraged(deposits: DataFrame, leveraged: DataFrame) -> DataFrame:
    base = deposits.agg(F.avg("Deposit").alias("MeanDeposit"), F.count("Deposit").alias("Days"))
    sums = leveraged.agg(F.sum("Profit").alias("Profit"), F.sum("ProfitAfterTax").alias("ProfitAfterTax"))
    out = base.withColumns({"Profit": sums.select("Profit").scalar(), "ProfitAfterTax": sums.select("ProfitAfterTax").scalar()})
    out = _rates(out, "MeanDeposit", ("TotalReturn", "TotalReturnAfterTax"))
    return out.withColumn("MeanDeposit", S.truncate_long(F.col("MeanDeposit")))


def latest_result(ledger: DataFrame) -> DataFrame:
    """Profit and rate of the last trade day."""
    last = ledger.agg(F.max("Date"))
    return ledger.filter(F.col("Date") == last.scalar()).groupBy("Date").agg(
        F.sum("Profit").alias("Profit"),
        F.try_divide(F.sum("Profit").cast("double"), F.sum("AcqAmount").cast("double")).alias("Rate"))


def report(ledger: DataFrame, deposits: DataFrame, buying_power: DataFrame) -> dict[str, DataFrame]:
    """Every table of the trade report, lazily."""
    daily, by_sector = daily_profit(ledger), daily_profit_by_sector(ledger)
    leveraged = daily_leveraged(deposits, daily)
    rates = ["Rate", "RateAfterTax"]
    return {
        "daily": daily, "daily_summary": M.describe(daily, rates, with_sharpe=True), "daily_by_sector": by_sector,
        "daily_leveraged": leveraged, "daily_leveraged_summary": M.describe(leveraged, rates, with_sharpe=True),
        "daily_cumulative": daily_cumulative(daily), "daily_leveraged_cumulative": leveraged_cumulative(deposits, leveraged),
        "monthly": monthly_profit(daily), "monthly_by_sector": monthly_profit(by_sector, ["Side", "Sector"]),
        "monthly_leveraged": monthly_leveraged(deposits, buying_power, leveraged),
        "total": total_profit(daily), "total_by_sector": total_profit(by_sector, ["Side", "Sector"]),
        "total_leveraged": total_leveraged(deposits, leveraged),
    }


def report_rollup(daily_by_sector: DataFrame) -> DataFrame:
    """The day, month and total levels of the per-sector report in one rollup."""
    rows = daily_by_sector.withColumn("Month", F.last_day("Date"))
    out = rows.rollup("Side", "Sector", "Month", "Date").agg(
        F.sum("AcqAmount").alias("AcqAmount"), F.sum("Profit").alias("Profit"), F.sum("ProfitAfterTax").alias("ProfitAfterTax"),
        F.grouping_id().alias("_g"))
    return out.filter(F.col("_g").isin(0, 1, 3)).withColumn(
        "Level", F.when(F.col("_g") == 0, "day").when(F.col("_g") == 1, "month").otherwise("total")).drop("_g")


def settle_list(held: DataFrame, settled: DataFrame) -> DataFrame:
    """Held codes without a settlement order."""
    return held.join(settled.select("Code").distinct(), "Code", "left_anti")


# States of the position file.
UNORDERED, ORDERED = "未発注", "発注済"


def pending_positions(positions: DataFrame) -> DataFrame:
    """Neither opened nor settled yet."""
    return positions.filter((F.col("OrderStatus") == UNORDERED) & (F.col("SettlementStatus") == UNORDERED))


def open_positions(positions: DataFrame) -> DataFrame:
    """Opened, settlement still to be ordered."""
    return positions.filter((F.col("OrderStatus") == ORDERED) & (F.col("SettlementStatus") == UNORDERED))
