"""From predictions to orders, for every day of a back-test at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.functions import windows as P
from panelforge.operators import prefix as X
from panelforge.session import small, stage, stage_tight

LENDING, STANDARD = "貸借銘柄", "制度信用銘柄"
NO_ORDERS = "受付不可"
LOT = 100
# Index funds that balance the book, (code, name, weight).
HEDGE_LONG = ("1308", "上場インデックスファンドTOPIX", 1.0)
HEDGE_SHORT = ("1356", "TOPIXベア2倍上場投信", 0.5)
HEDGE_LOT = 10
GROUP = ["Date", "Direction", "Sector"]


def normalise_margin_weights(configs: DataFrame) -> DataFrame:
    """Shares of the margin that sum to 1; equal ones when the given sum is not positive."""
    everything = Window.partitionBy()
    total, n = F.sum("margin_weight").over(everything), F.count(F.lit(1)).over(everything)
    return configs.withColumn("margin_weight", F.when(total <= 0, 1 / n).otherwise(F.col("margin_weight") / total))


def trade_limits(quotas: DataFrame, lending: DataFrame) -> DataFrame:
    """Per code: unit limit, whether it can be sold short, whether it is a lending stock."""
    joined = quotas.join(lending.select("Code", "CreditClass"), "Code")
    quota = F.when(F.col("MaxUnit").cast("string") == "-", S.UNLIMITED_QUOTA).otherwise(F.col("MaxUnit").try_cast("long"))
    sellable = ((F.col("CreditClass") == LENDING) | (F.col("SellQuota") != NO_ORDERS)) & (F.col("CreditClassHyper") == "")
    return joined.select("Code", quota.cast("long").alias("MaxUnit"), sellable.alias("Sellable"),
                         F.when(F.col("CreditClass") == LENDING, True).when(F.col("CreditClass") == STANDARD, False).alias("isBorrowingStock"))


def buyable_symbols(limits: DataFrame) -> DataFrame:
    return limits.select("Code", "MaxUnit")


def sellable_symbols(limits: DataFrame) -> DataFrame:
    return limits.filter("Sellable").select("Code", "MaxUnit", "isBorrowingStock")


def sector_tradability(definition: DataFrame, limits: DataFrame) -> DataFrame:
    """Members of each sector and how many of them can be bought and sold: one join, one aggregate."""
    marked = definition.select("Code", "Sector").join(limits, "Code", "left")
    return marked.groupBy("Sector").agg(
        F.count("MaxUnit").alias("Buy"), F.sum(F.coalesce(F.col("Sellable"), F.lit(False)).cast("long")).alias("Sell"),
        F.count("Code").alias("Total"))


def predictions_with_tradability(predictions: DataFrame, tradability: DataFrame) -> DataFrame:
    """A side is open when at least half of the sector's members are tradable on it."""
    out = predictions.join(tradability, "Sector", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumns({c: F.coalesce(F.col(c), zero) for c in ("Buy", "Sell")})
    flag = lambda c: (F.coalesce(F.try_divide(F.col(c), F.col("Total")), F.lit(0.0)) >= 0.5).cast("int")
    return out.withColumns({"Buyable": flag("Buy"), "Sellable": flag("Sell")})


def rank_predictions(predictions: DataFrame) -> DataFrame:
    """Descending rank per day, truncated to an integer."""
    return predictions.withColumn("Rank", P.rank_avg("Pred", "Date", ascending=False).cast("int"))


def select_sectors(predictions: DataFrame, n_sectors: int, n_candidates: int) -> DataFrame:
    """Best and worst candidates of each day, then the first tradable ones among them."""
    low = Window.partitionBy("Date").orderBy(F.col("Pred").asc_nulls_last(), "Sector")
    high = Window.partitionBy("Date").orderBy(F.col("Pred").desc_nulls_last(), F.col("Sector").desc())
    placed = predictions.withColumns({"_low": F.row_number().over(low), "_high": F.row_number().over(high)})
    legs = []
    for direction, place, flag in (("Short", "_low", "Sellable"), ("Long", "_high", "Buyable")):
        candidates = placed.filter((F.col(place) <= n_candidates) & (F.col(flag) == 1))
        w = Window.partitionBy("Date").orderBy(place)
        legs.append(candidates.withColumn("Order", F.row_number().over(w)).filter(F.col("Order") <= n_sectors)
                    .select("Date", F.lit(direction).alias("Direction"), "Order", "Sector"))
    return legs[0].unionByName(legs[1])


def latest_predictions(predictions: DataFrame) -> DataFrame:
    last = predictions.agg(F.max("Date"))
    return predictions.filter(F.col("Date") == last.scalar()).orderBy("Pred", "Sector")


def weight_components(order_price: DataFrame) -> DataFrame:
    """Lot cost and five-day mean volume on every day."""
    return order_price.select("Date", "Code", (F.col("Close") * LOT).alias("EstimatedCost"),
                              P.rolling_mean("Volume", 5, "Code").alias("Past5daysVolume"), "MarketCapClose")


def latest_weight_components(order_price: DataFrame) -> DataFrame:
    last = order_price.agg(F.max("Date"))
    return weight_components(order_price).filter(F.col("Date") == last.scalar())


def sector_weights(components: DataFrame, definition: DataFrame) -> DataFrame:
    """Capitalisation weight of each stock in its sector and day.

    The sector totals come from a pre-aggregated join, so one dominant sector does
    not pile up in a window partition. Components that are stored by code stay where
    they are: only the definition and the totals travel.
    """
    rows = components.join(definition.select("Code", "CompanyName", "Sector").hint("shuffle_hash"), "Code").filter(F.col("Sector").isNotNull())
    return _share(rows, "MarketCapClose", ["Date", "Sector"])


def _share(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    totals = small(stage_tight(rows.groupBy(*keys).agg(F.sum(value).alias("_total")), "totals"))
    return rows.join(totals, list(keys)).withColumn("Weight", F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def tradable_weights(weights: DataFrame, selected: DataFrame, limits: DataFrame) -> DataFrame:
    """Weights of the selected sectors' tradable members, renormalised to 1 per sector."""
    rows = weights.join(small(selected.select("Date", "Direction", "Sector")), ["Date", "Sector"])
    rows = rows.join(limits.hint("shuffle_hash"), "Code").filter((F.col("Direction") == "Long") | F.col("Sellable"))
    flag = F.when(F.col("Direction") == "Short", F.coalesce(F.col("isBorrowingStock"), F.lit(False))).otherwise(F.lit(False))
    rows = rows.withColumnRenamed("Weight", "_w").withColumn("isBorrowingStock", flag)
    return _share(rows, "_w", GROUP).drop("_w", "Sellable")


def hedge_rows(selected: DataFrame, etf_prices: DataFrame) -> DataFrame:
    """Index-fund positions that even out the number of long and short sectors of a day.

    Each missing sector becomes a row of its own with a sector of its own, weight 1
    on the long side and one half for the double-inverse fund on the short side. A day
    without a quote of the fund keeps its rows, with no cost.
    """
    counts = selected.groupBy("Date").agg(
        F.sum((F.col("Direction") == "Long").cast("int")).alias("_l"), F.sum((F.col("Direction") == "Short").cast("int")).alias("_s"))
    gap = F.col("_s") - F.col("_l")
    spec = lambda d, h: F.struct(F.lit(d).alias("Direction"), F.lit(h[0]).alias("Code"), F.lit(h[1]).alias("CompanyName"), F.lit(h[2]).alias("Weight"))
    rows = counts.filter(gap != 0).select(
        "Date", F.when(gap > 0, spec("Long", HEDGE_LONG)).otherwise(spec("Short", HEDGE_SHORT)).alias("_h"),
        F.explode(F.sequence(F.lit(0), F.abs(gap) - 1)).alias("_i"))
    rows = rows.select("Date", "_h.*", F.concat(F.lit("ETF"), F.col("_i")).alias("Sector"))
    return rows.join(etf_prices.select("Date", "Code", (F.col("Close") * HEDGE_LOT).alias("EstimatedCost")), ["Date", "Code"], "left")


def sector_budgets(selected: DataFrame, margin: float) -> DataFrame:
    """Equal part of half the margin for each selected sector of a side."""
    counts = selected.groupBy("Date", "Direction").agg(F.count(F.lit(1)).alias("_n"))
    return selected.select(*GROUP).join(counts, ["Date", "Direction"]).withColumn(
        "MaxCost", F.lit(float(margin)) / 2 / F.col("_n")).drop("_n")


def draft_units(weights: DataFrame, budgets: DataFrame) -> DataFrame:
    """Ideal cost, whole lots below it, and the nearer of the two neighbouring lot counts."""
    rows = weights.join(small(budgets), GROUP)
    cost, ideal = F.col("EstimatedCost"), F.col("IdealCost")
    rows = rows.withColumn("IdealCost", S.truncate_long(F.col("Weight") * F.col("MaxCost")).cast("double"))
    rows = rows.withColumn("_below", F.floor(F.try_divide(ideal, cost)) * cost)
    rows = rows.withColumn("ReductionRate", F.try_divide(F.abs(ideal - F.col("_below")), F.abs(ideal - F.col("_below") - cost)))
    total = F.when(F.col("ReductionRate") <= 1, F.col("_below")).otherwise(F.col("_below") + cost)
    return rows.withColumn("TotalCost", total).withColumn("Unit", F.try_divide(F.col("TotalCost"), cost)).drop("_below")


def cap_units(draft: DataFrame) -> DataFrame:
    """At most ``MaxUnit`` lots."""
    return draft.withColumn("isMaxUnit", F.col("Unit") >= F.col("MaxUnit")).withColumn(
        "Unit", F.least(F.col("Unit"), F.col("MaxUnit").cast("double"))).withColumn(
        "TotalCost", F.col("Unit") * F.col("EstimatedCost"))


def _numbered(units: DataFrame) -> DataFrame:
    """``_k`` tells rows of a group that share a code apart; rows stored by code stay where they are."""
    same = Window.partitionBy(*GROUP, "Code").orderBy(
        *[F.col(c).desc_nulls_last() for c in ("Weight", "EstimatedCost", "IdealCost", "Unit", "MaxUnit", "ReductionRate")])
    return units.withColumn("_k", F.row_number().over(same))


def _per_group(units: DataFrame, *sums: Column) -> DataFrame:
    """A row for each day, side and sector, with a number ``_g`` that later steps deal by."""
    return small(stage_tight(units.groupBy(*GROUP).agg(*sums).withColumn("_g", F.monotonically_increasing_id()), "groups"))


def reduce_to_budget(units: DataFrame) -> DataFrame:
    """Give up one lot of the most rounded-up stocks, in turn, until the budget holds.

    Each stock loses at most one lot, so the turn a stock is reached at is decided by
    the running cost of the stocks before it: a window, no loop. Only candidates of
    groups above their budget travel there, and what comes back are the rows to cut.
    """
    candidate = F.coalesce((F.col("ReductionRate") >= 1) & (F.col("Unit") > 0), F.lit(False))
    # Giving up a lot of negative cost raises what is spent.
    raised = F.sum(F.when(candidate, F.greatest(-F.col("EstimatedCost"), F.lit(0.0))))
    over = F.coalesce(F.sum("TotalCost") + F.coalesce(raised, F.lit(0.0)) > F.min("MaxCost"), F.lit(True)) | (F.count("MaxCost") < F.count(F.lit(1)))
    groups = _per_group(units, F.sum("TotalCost").alias("_spent"), over.alias("_over"))
    rows = _numbered(units).join(groups, GROUP)
    turns = rows.filter(F.col("_over") & candidate).select(
        "_g", "Code", "_k", "ReductionRate", "Weight", "EstimatedCost", "_spent", "MaxCost")
    order = [F.col("ReductionRate").desc(), F.col("Weight").desc(), F.col("Code")]
    w = Window.partitionBy("_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = turns.select("_g", "Code", "_k", (F.col("_spent") - F.coalesce(F.sum("EstimatedCost").over(w), F.lit(0.0)) > F.col("MaxCost")).alias("_cut"))
    cut = stage_tight(cut.filter("_cut"), "lots-given-up")
    rows = rows.join(cut.hint("shuffle_hash"), ["_g", "Code", "_k"], "left")
    unit = F.col("Unit") - F.coalesce(F.col("_cut"), F.lit(False)).cast("int")
    return rows.withColumn("Unit", unit).withColumn("TotalCost", F.col("Unit") * F.col("EstimatedCost")).select(*units.columns)


def _spread(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash the groups over all shuffle partitions; a small input is not folded into few Python workers."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _spend_rest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add lots one by one to the affordable stock with the smallest reduction rate; the rows that got some."""
    pdf = pdf.sort_values(["Weight", "Code"], ascending=[False, True]).reset_index(drop=True)
    cost, ideal, limit = pdf["EstimatedCost"].to_numpy(), pdf["IdealCost"].to_numpy(), pdf["MaxUnit"].to_numpy()
    unit, rate = pdf["Unit"].to_numpy(copy=True), pdf["ReductionRate"].to_numpy(copy=True)
    full = np.zeros(len(pdf), dtype=bool)
    free = float(pdf["_free"].iloc[0])
    while True:
        open_rows = (cost <= free) & ~full
        if not open_rows.any():
            break
        i = int(np.where(open_rows, rate, np.inf).argmin())
        unit[i] += 1
        free -= cost[i]
        rate[i] = abs(ideal[i] - unit[i] * cost[i]) / max(abs(ideal[i] - (unit[i] + 1) * cost[i]), 1e-12)
        full[i] = unit[i] >= limit[i]
    grown = unit != pdf["Unit"].to_numpy()
    return pdf[["_g", "Code", "_k"]].assign(_unit=unit, _rate=rate, _full=full)[grown]


def spend_budget(units: DataFrame) -> DataFrame:
    """Use what is left of the budget.

    The choice depends on every earlier one, so it runs per (day, side, sector); only
    stocks whose lot still fits the remaining budget are sent there, with what the
    choice depends on, and only those that got lots come back.
    """
    groups = _per_group(units, F.sum("TotalCost").alias("_spent"))
    rows = _numbered(units).join(groups, GROUP).withColumn("_free", F.col("MaxCost") - F.col("_spent"))
    fits = F.coalesce((F.col("EstimatedCost") <= F.col("_free")) & ~F.col("isMaxUnit") & F.col("ReductionRate").isNotNull(), F.lit(False))
    wanted = rows.filter(fits).select("_g", "Code", "_k", "Weight", "EstimatedCost", "IdealCost", "MaxUnit", "Unit", "ReductionRate", "_free")
    grown = _spread(wanted, ["_g"]).groupBy("_g").applyInPandas(_spend_rest, "_g long, Code string, _k int, _unit double, _rate double, _full boolean")
    grown = stage_tight(grown, "lots-added")
    rows = rows.withColumn("_fits", fits).join(grown.hint("shuffle_hash"), ["_g", "Code", "_k"], "left")
    rows = rows.withColumns({c: F.coalesce(x, c) for c, x in (("Unit", "_unit"), ("ReductionRate", "_rate"), ("isMaxUnit", "_full"))})
    cost = F.when(F.col("_fits"), F.col("Unit") * F.col("EstimatedCost")).otherwise(F.col("TotalCost"))
    return rows.withColumn("TotalCost", cost).select(*units.columns)


def add_price_limits(units: DataFrame) -> DataFrame:
    """Worst-case cost at the day's upper price limit."""
    upper = S.upper_limit(F.col("EstimatedCost") / LOT) * LOT
    return units.withColumn("UpperLimitCost", upper.cast("double")).withColumn("UpperLimitTotal", F.col("UpperLimitCost") * F.col("Unit"))


def size_orders(weights: DataFrame, budgets: DataFrame) -> DataFrame:
    """Draft, cap, reduce, spend, price limits; rows without a lot drop out."""
    units = spend_budget(reduce_to_budget(cap_units(draft_units(weights, budgets))))
    return add_price_limits(units).filter(F.col("Unit") > 0).select(
        "Date", "Code", "CompanyName", "Sector", F.col("Unit").cast("int").alias("Unit"), "EstimatedCost", "TotalCost",
        "UpperLimitCost", "UpperLimitTotal", "Direction", "isBorrowingStock")


def add_running_cost(orders: DataFrame) -> DataFrame:
    """Cumulative cost per day and side, whatever the number of a day's orders."""
    order = ["Sector", F.col("TotalCost").desc(), "Code"]
    rows = X.ranged(orders, ["Date", "Direction", *order], "orders-by-cost")
    return X.running_total(rows, ["Date", "Direction"], order, "TotalCost", "CumCost_byLS").select(*orders.columns, "CumCost_byLS")


def net_orders(orders: DataFrame, keys: Sequence[str] = ("Date", "Code")) -> DataFrame:
    """One order per code over all models: long minus short lots, nothing when they cancel.

    ``Model`` orders the sources; cost, names and sector come from the first row,
    limit price and borrowing flag from the first long row if there is one.
    """
    keys = list(keys)
    is_long = F.col("Direction") == "Long"
    first = F.struct("Model", "Direction")
    long_first = F.struct((~is_long).cast("int").alias("_s"), F.col("Model").alias("_m"))
    lots = F.sum(F.when(is_long, F.col("Unit")).otherwise(-F.col("Unit")))
    out = orders.groupBy(*keys).agg(
        lots.cast("int").alias("_net"), *[F.min_by(c, first).alias(c) for c in ("CompanyName", "Sector", "EstimatedCost")],
        *[F.min_by(c, long_first).alias(c) for c in ("UpperLimitCost", "isBorrowingStock")])
    out = out.filter(F.col("_net") != 0).withColumns({
        "Unit": F.abs("_net"), "Direction": F.when(F.col("_net") > 0, "Long").otherwise("Short")})
    return out.withColumns({
        "TotalCost": F.col("Unit") * F.col("EstimatedCost"), "UpperLimitTotal": F.col("Unit") * F.col("UpperLimitCost")}).drop("_net")


def admit_orders(orders: DataFrame, margin: Column | float, existing: DataFrame | None = None) -> DataFrame:
    """Walk a day's orders in order; one that exceeds the remaining margin is refused, an accepted one uses it up.

    Codes with a standing order are skipped. The walk goes in phases over all days at once. While more than half of a phase's free
    margin is left, every order up to half of it passes, so running totals of these tell what is free at each order; the phase ends at
    the first larger order that still fits, or where half is used up. What lies before the end is settled, orders above the free margin
    are refused for good, and the free margin has at least halved. Phases are as many as halvings from the margin to the smallest
    order, and a day's orders need not fit into one task.
    """
    rows = orders.withColumn("_margin", margin if isinstance(margin, Column) else F.lit(float(margin)))
    if existing is not None:
        marks = existing.select("Date", "Code").distinct().withColumn("_dup", F.lit(True))
        rows = rows.join(marks, ["Date", "Code"], "left")
    else:
        rows = rows.withColumn("_dup", F.lit(None).cast("boolean"))
    need, free = F.col("UpperLimitTotal"), F.col("_free")
    status = F.when(F.col("_dup"), "already ordered").when(need > F.col("_margin"), "refused")
    order = ["CumCost_byLS", "Direction", "Code"]
    pending = X.ranged(rows.withColumn("Status", status).drop("_dup"), ["Date", *order], "orders-in-turn")
    left = stage(pending.groupBy("Date").agg(F.max("_margin").alias("_free")), "margin-left")  # a row a day
    decided, pending = [pending.filter("Status is not null")], pending.filter("Status is null")
    small, here = need * 2 <= free, F.struct(*order)
    while pending.limit(1).count():
        now = X.running_total(pending.join(left, "Date"), ["Date"], order, F.when(small, need), "_before", inclusive=False)
        used = F.col("_before") + need
        ends = F.when(small, (used * 2 >= free) & (used > 0)).otherwise(used <= free)
        end = now.filter(ends).groupBy("Date").agg(F.min(F.struct(*order, used.alias("used"))).alias("_end"))
        last = F.struct(*[F.col("_end")[c].alias(c) for c in order])
        after = F.col("_end").isNotNull() & (here > last)
        passed = F.when(small | (F.col("_end").isNotNull() & (here == last)), "accepted").otherwise("refused")
        verdict = F.when(after & (need <= free - F.col("_end")["used"]), None).when(after, "refused").otherwise(passed)
        done = stage(now.join(end, "Date", "left").withColumn("Status", verdict).drop("_before", "_end", "_free"), "orders-settled")
        left = stage(left.join(end, "Date").select("Date", (F.col("_free") - F.col("_end")["used"]).alias("_free")), "margin-left")
        decided.append(done.filter("Status is not null"))
        pending = done.filter("Status is null")
    out = decided[0]
    for part in decided[1:]:
        out = out.unionByName(part)
    return out.select(*orders.columns, "Status")
