"""Cross-asset and sector price features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import windows as P

# Relative strength of a currency, the mean of signed pair returns.
CURRENCY_STRENGTH = {
    "JPY": (("USDJPY", -1), ("EURJPY", -1), ("AUDJPY", -1)),
    "USD": (("USDJPY", 1), ("EURUSD", -1), ("AUDUSD", -1)),
    "AUD": (("AUDJPY", 1), ("AUDUSD", 1), ("EURAUD", -1)),
    "EUR": (("EURJPY", 1), ("EURUSD", 1), ("EURAUD", 1)),
}
CURRENCY_PAIRS = ("USDJPY", "EURJPY", "AUDJPY", "EURUSD", "AUDUSD", "EURAUD")
SUFFIX = "_1d_return"


def select_series(
    catalogue: DataFrame, groups: Mapping[str, bool] | None = None, names: Mapping[str, bool] | None = None,
) -> DataFrame:
    """Adoption flag per series: a setting by name, else by group, else the catalogue's own."""
    def lookup(setting: Mapping[str, bool] | None, key: str):
        if not setting:
            return F.lit(None).cast("boolean")
        return F.element_at(F.create_map(*[F.lit(v) for kv in setting.items() for v in kv]), F.col(key))
    flag = F.coalesce(lookup(names, "Name"), lookup(groups, "Group"), F.col("is_adopted"))
    return catalogue.withColumn("is_adopted", flag)


def series_returns(series: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One-day change of every adopted series: a difference for bonds, a ratio otherwise."""
    adopted = catalogue.filter("is_adopted").select("Name", "Group")
    rows = series.select("Name", "Date", "Close").join(adopted, "Name")
    change = F.when(F.col("Group") == "bond", P.diff("Close", "Name")).otherwise(P.pct_change("Close", "Name"))
    return rows.select("Name", "Group", "Date", change.alias("value"))


def commodity_in_yen(series: DataFrame, catalogue: DataFrame, rate_name: str = "USDJPY") -> DataFrame:
    """Commodity closes converted at the day's rate before the one-day change."""
    adopted = catalogue.filter(F.col("is_adopted") & (F.col("Group") == "commodity")).select("Name", "Group")
    rate = series.filter(F.col("Name") == rate_name).select("Date", F.col("Close").alias("_rate"))
    rows = series.select("Name", "Date", "Close").join(adopted, "Name").join(rate, "Date", "left")
    rows = rows.withColumn("_yen", F.col("Close") * F.col("_rate"))
    return rows.select("Name", "Group", "Date", P.pct_change("_yen", "Name").alias("value"))


def widen_series(returns: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per series on the union of dates, carried forward.

    A single pivot with known columns replaces one outer join per series.  The
    forward fill runs over one row per day.
    """
    wide = returns.groupBy("Date").pivot("Name", list(names)).agg(F.max("value"))
    w = Window.orderBy("Date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("Date", *[F.last(n, ignorenulls=True).over(w).alias(n + SUFFIX) for n in names])


def currency_strength(wide: DataFrame) -> DataFrame:
    """Six pair returns to four currency strengths."""
    strength = {}
    for currency, legs in CURRENCY_STRENGTH.items():
        total = sum((F.col(pair + SUFFIX) * sign for pair, sign in legs[1:]), F.col(legs[0][0] + SUFFIX) * legs[0][1])
        strength[currency + SUFFIX] = total / 3
    return wide.withColumns(strength).drop(*[p + SUFFIX for p in CURRENCY_PAIRS])


def bond_spread(wide: DataFrame) -> DataFrame:
    """Ten-year minus two-year change; the two-year column goes, the ten-year one stays."""
    tens = [c for c in wide.columns if "bond10" in c]
    out = wide.withColumns({c.replace("10", "_diff"): F.col(c) - F.col(c.replace("10", "2")) for c in tens})
    return out.drop(*[c.replace("10", "2") for c in tens])


def index_features(
    series: DataFrame, catalogue: DataFrame, names: Sequence[str], currencies: str = "relative", commodity: str = "raw",
) -> DataFrame:
    """Wide cross-asset feature table; ``names`` are the adopted series, in column order."""
    if currencies not in ("relative", "raw"):
        raise ValueError("currencies must be 'relative' or 'raw'")
    returns = series_returns(series, catalogue)
    if commodity == "JPY":
        returns = returns.filter(F.col("Group") != "commodity").unionByName(commodity_in_yen(series, catalogue))
    wide = widen_series(returns, names)
    if currencies == "relative" and set(CURRENCY_PAIRS) <= set(names):
        wide = currency_strength(wide)
    return bond_spread(wide) if any("bond10" in n for n in names) else wide


def _bands(durations: Sequence[int]) -> list[tuple[int, int]]:
    """(n, excluded recent days): each band starts where the previous one ended."""
    out, excluded = [], 1
    for n in durations:
        out.append((n, excluded))
        excluded = n
    return out


def momentum(index: DataFrame, durations: Sequence[int] = (5, 21)) -> DataFrame:
    return index.withColumns({
        f"{n}d_mom": P.rolling_mean("1d_return", n - d, "Sector", lag=d) for n, d in _bands(durations)})


def volatility(index: DataFrame, durations: Sequence[int] = (5, 21)) -> DataFrame:
    return index.withColumns({
        f"{n}d_vola": P.rolling_std("1d_return", n - d, "Sector", lag=d) for n, d in _bands(durations)})


def add_daily_ranks(df: DataFrame, columns: Mapping[str, str], ascending: bool = False) -> DataFrame:
    """Cross-sectional ranks of several columns in one projection (one exchange on Date)."""
    return df.withColumns({out: P.rank_avg(c, "Date", ascending) for c, out in columns.items()})


def sector_category(df: DataFrame) -> DataFrame:
    """Integer per sector in order of first appearance (first date, then name)."""
    first = df.groupBy("Sector").agg(F.min("Date").alias("_first"))
    codes = first.withColumn("Sector_cat", (F.dense_rank().over(Window.orderBy("_first", "Sector")) - 1).cast("int"))
    return df.join(codes.select("Sector", "Sector_cat"), "Sector")


def price_features(
    index: DataFrame, size: DataFrame | None = None, eps: DataFrame | None = None,
    mom: Sequence[int] | None = (5, 21), vola: Sequence[int] | None = (5, 21),
    categorical: bool = True, add_rank: bool = True,
) -> DataFrame:
    """Return, momentum, volatility, size and EPS factors with daily ranks per sector."""
    out = index.select("Date", "Sector", "1d_return")
    ranks = {"1d_return": "1d_return_rank"}
    if mom:
        out = momentum(out, mom)
        ranks.update({f"{n}d_mom": f"{n}d_mom_rank" for n in mom})
    if vola:
        out = volatility(out, vola)
        ranks.update({f"{n}d_vola": f"{n}d_vola_rank" for n in vola})
    if size is not None:
        out = out.join(size, ["Date", "Sector"], "left")
        ranks["MarketCapAtClose"] = "MarketCap_rank"
    if not add_rank:
        ranks = {}
    if eps is not None:
        out = out.join(eps, ["Date", "Sector"], "left")
        ranks["ForecastEPS"] = "ForecastEPS_rank"
    out = add_daily_ranks(out, ranks)
    return sector_category(out) if categorical else out


def merge_features(index_wide: DataFrame | None, price: DataFrame | None) -> DataFrame | None:
    """Cross-asset columns on the sector rows of the day, carried forward per sector."""
    if price is None or index_wide is None:
        return price if index_wide is None else index_wide
    joined = price.join(index_wide, "Date", "left")
    values = [c for c in joined.columns if c not in ("Date", "Sector")]
    return joined.select("Date", "Sector", *[P.ffill(c, "Sector").alias(c) for c in values])
