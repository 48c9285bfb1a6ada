"""Queries over market capitalisation, sector indices and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.functions import windows as P
from panelforge.operators import dataset as D
from panelforge.operators import features as FE
from panelforge.operators import marketcap as MC
from panelforge.operators import sector_index as SI
from panelforge.plans.market import SERIES_NAMES, Market
from panelforge.plans.reference_sql import CTES, INDEX_FROM_BASE, avg_rank, band
from panelforge.plans.registry import query

CAPS = "MarketCapOpen MarketCapClose MarketCapHigh MarketCapLow"
BY_CODE = "OVER (PARTITION BY Code ORDER BY Date)"
UP, DOWN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


@query("sector_attach", "C1 C16", "SELECT Sector, count(*) AS StockDays, CAST(sum(Volume) AS BIGINT) AS Volume FROM x_traded LEFT JOIN x_definition USING (Code) GROUP BY Sector")
def sector_attach(m: Market):
    rows = SI.attach_sector(m.traded, m.definition)
    return rows.groupBy("Sector").agg(F.count(F.lit(1)).alias("StockDays"), F.sum("Volume").cast("long").alias("Volume"))


CTES["x_groups_of"] = "SELECT Code, 'Region ' || MarketCodeName AS Sector FROM x_listing UNION ALL SELECT Code, 'Size ' || ScaleCategory FROM x_listing"


@query("sector_index_from_groups", "C2 D1 E12 E13", f"""
    WITH base AS (SELECT Date, Sector, sum(MarketCapOpen) AS MarketCapOpen, sum(MarketCapClose) AS MarketCapClose, sum(MarketCapHigh) AS MarketCapHigh, sum(MarketCapLow) AS MarketCapLow,
      sum(OutstandingShares) AS OutstandingShares, sum(CorrectionValue) AS CorrectionValue FROM x_caps JOIN x_groups_of USING (Code) GROUP BY Date, Sector)
    SELECT Date, Sector, "1d_return", Close, Open, High, Low FROM ({INDEX_FROM_BASE.format(base='base')})""", "1d_return Close Open High Low")
def sector_index_from_groups(m: Market):
    """Every stock in the group of its region and in that of its size."""
    of = lambda label, column: m.listing.select("Code", F.concat(F.lit(label), F.col(column)).alias("Sector"))
    groups = of("Region ", "MarketCodeName").unionByName(of("Size ", "ScaleCategory"))
    return SI.sector_index_by_groups(m.caps, groups).select("Date", "Sector", "1d_return", "Close", "Open", "High", "Low")


@query("shares_at_period_end", "E4", """
    SELECT Code, CAST(CurrentPeriodEndDate + 1 AS DATE) AS Day, OutstandingShares FROM x_fin QUALIFY row_number() OVER (PARTITION BY CurrentPeriodEndDate, Code ORDER BY Date DESC, OutstandingShares) = 1""")
def shares_at_period_end(m: Market):
    return MC.shares_at_period_end(m.fin)


@query("business_day_snap", "C3", "SELECT Date, Code, OutstandingShares FROM x_shares")
def business_day_snap(m: Market):
    snapped = MC.snap_to_business_day(MC.shares_at_period_end(m.fin), m.calendar)
    return snapped.filter("Date is not null").select("Date", "Code", "OutstandingShares")


@query("price_with_shares", "C4", "SELECT p.Date, p.Code, p.Close, s.OutstandingShares, s.Date IS NOT NULL AS isSettlementDay FROM x_traded p LEFT JOIN x_shares s ON p.Date = s.Date AND p.Code = s.Code")
def price_with_shares(m: Market):
    return MC.attach_shares(m.traded, m.fin, m.calendar).select("Date", "Code", "Close", "OutstandingShares", "isSettlementDay")


@query("share_rate_events", "E5 E6", """
    SELECT Date, Code, OutstandingShares, SharesRate FROM x_vol_events""", "SharesRate:3")
def share_rate_events(m: Market):
    """Settlement days with the ratio of the settlement day before."""
    rows = MC.add_share_rates(MC.attach_shares(m.price.repartition(m.panel_parts, "Code"), m.volatile_fin, m.calendar)).filter("isSettlementDay")
    return rows.select("Date", "Code", "OutstandingShares", P.shift("EventRate", 1, "Code").alias("SharesRate"))


@query("share_rates_on_prices", "C5 E7", f"""
    SELECT p.Date, p.Code, coalesce(lead(e.SharesRate) OVER (PARTITION BY p.Code ORDER BY p.Date), 1.0) AS SharesRate FROM x_price p LEFT JOIN x_vol_events e ON p.Date = e.Date AND p.Code = e.Code""", "SharesRate:3")
def share_rates_on_prices(m: Market):
    return MC.add_share_rates(MC.attach_shares(m.price.repartition(m.panel_parts, "Code"), m.volatile_fin, m.calendar)).select("Date", "Code", "SharesRate")


@query("share_rate_overrides", "E8", """
    SELECT Code, round(sum(r), 3) + 0.0 AS RateSum, count(*) FILTER (r <> 1) AS Scaled FROM (
      SELECT p.Code, CASE WHEN p.Code IN ('0001', '0003') AND p.Date <= DATE '1999-06-30' THEN 1.0 ELSE coalesce(lead(e.SharesRate) OVER (PARTITION BY p.Code ORDER BY p.Date), 1.0) END AS r
      FROM x_price p LEFT JOIN x_vol_events e ON p.Date = e.Date AND p.Code = e.Code) GROUP BY Code""", "RateSum:3")
def share_rate_overrides(m: Market):
    rows = MC.attach_shares(m.price.repartition(m.panel_parts, "Code"), m.volatile_fin, m.calendar)
    rows = MC.add_share_rates(rows, overrides=[("0001", "1999-06-30"), ("0003", "1999-06-30")])
    return rows.groupBy("Code").agg(F.sum("SharesRate").alias("RateSum"), F.count_if(F.col("SharesRate") != 1).alias("Scaled"))


@query("adjusted_shares", "E9 E10", "SELECT Date, Code, OutstandingShares FROM x_vol_caps", "OutstandingShares:2")
def adjusted_shares(m: Market):
    return MC.market_caps(m.price, m.volatile_fin, m.calendar, overrides=(), parts=m.panel_parts).select("Date", "Code", "OutstandingShares")


@query("stock_market_caps", "B14 E11", f"SELECT Date, Code, {', '.join(CAPS.split())}, CorrectionValue FROM x_caps", " ".join(f"{c}:2" for c in (CAPS + " CorrectionValue").split()))
def stock_market_caps(m: Market):
    return m.caps.select("Date", "Code", *CAPS.split(), "CorrectionValue")


@query("sector_cap_base", "D1", "SELECT Date, Sector, MarketCapOpen, MarketCapClose, MarketCapHigh, MarketCapLow, OutstandingShares, CorrectionValue FROM x_index_base", "MarketCapOpen:2 MarketCapClose:2 MarketCapHigh:2 MarketCapLow:2 OutstandingShares:2 CorrectionValue:2")
def sector_cap_base(m: Market):
    return m.index.select("Date", "Sector", *CAPS.split(), "OutstandingShares", "CorrectionValue")


@query("sector_index", "C1 D1 E12 E13", 'SELECT Date, Sector, "1d_return", "1d_rate", Open, High, Low, Close FROM x_index', "1d_return 1d_rate Open High Low Close")
def sector_index(m: Market):
    index, _ = SI.sector_index(m.price, m.fin, m.definition, m.calendar, m.panel_parts)
    return index.select("Date", "Sector", "1d_return", "1d_rate", "Open", "High", "Low", "Close")


@query("order_prices", "A6 E29", "SELECT Date, Code, MarketCapClose, Close, Volume FROM x_caps", "MarketCapClose:2")
def order_prices(m: Market):
    _, prices = SI.sector_index(m.price, m.fin, m.definition, m.calendar, m.panel_parts)
    return prices


@query("size_factor", "D2", "SELECT Date, Sector, avg(MarketCapClose) AS MarketCapAtClose FROM x_caps JOIN x_definition USING (Code) GROUP BY Date, Sector", "MarketCapAtClose:1")
def size_factor(m: Market):
    return SI.size_factor(m.caps, m.definition)


AS_OF = """SELECT Date, Code, max(Close) AS Close, max(S) AS S, max(E) AS E, bool_or(traded) AS traded FROM (
    SELECT Date, Code, Close, NULL AS S, NULL AS E, true AS traded FROM x_traded UNION ALL SELECT Date, Code, NULL, OutstandingShares, ForecastEPS, false FROM x_fin) GROUP BY Date, Code"""


@query("fundamentals_as_of", "C6", f"""
    SELECT Date, Code, Close, last_value(S IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {UP}) AS OutstandingShares,
      last_value(E IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {UP}) AS ForecastEPS FROM ({AS_OF})""")
def fundamentals_as_of(m: Market):
    return SI.fundamentals_as_of(m.traded.select("Date", "Code", "Close"), m.fin, ["OutstandingShares", "ForecastEPS"])


@query("sector_fundamentals", "C6 D4", f"""
    WITH a AS (SELECT Date, Code, Close * last_value(S IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {UP}) AS cap,
      last_value(E IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {UP}) AS E FROM ({AS_OF}))
    SELECT Date, Sector, avg(cap) AS MarketCap, coalesce(sum(E * cap) / nullif(sum(cap), 0), 0.0) AS ForecastEPS FROM a JOIN x_definition USING (Code) GROUP BY Date, Sector""", "MarketCap:1 ForecastEPS:4")
def sector_fundamentals(m: Market):
    return SI.sector_fundamentals(m.traded, m.fin, m.definition)


@query("sector_eps_factor", "C7 D3", f"""
    WITH f AS (SELECT *, last_value(E IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {UP}) AS e1 FROM ({AS_OF})),
    b AS (SELECT *, first_value(e1 IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {DOWN}) AS e2 FROM f)
    SELECT Date, Sector, avg(e2) AS ForecastEPS FROM b JOIN x_definition USING (Code) WHERE traded GROUP BY Date, Sector""", "ForecastEPS:4")
def sector_eps_factor(m: Market):
    return SI.eps_factor(m.traded, m.fin, m.definition)


@query("series_selection", "B18", """
    SELECT Name, "Group", CASE Name WHEN 'NK225' THEN true WHEN 'Gold' THEN false ELSE CASE "Group" WHEN 'bond' THEN false ELSE is_adopted END END AS is_adopted FROM x_catalogue SEMI JOIN x_series USING (Name)""")
def series_selection(m: Market):
    return FE.select_series(m.catalogue.join(m.series.select("Name").distinct(), "Name"), {"bond": False}, {"NK225": True, "Gold": False})


X_RET = """SELECT s.Name, c."Group", Date, CASE WHEN c."Group" = 'bond' THEN Close - lag(Close) OVER (PARTITION BY s.Name ORDER BY Date)
    ELSE Close / nullif(lag(Close) OVER (PARTITION BY s.Name ORDER BY Date), 0) - 1 END AS value FROM x_series s JOIN x_catalogue c ON s.Name = c.Name WHERE c.is_adopted"""


@query("series_returns", "E14", X_RET, "value")
def series_returns(m: Market):
    return FE.series_returns(m.series, m.catalogue)


@query("commodity_in_yen", "C9", """
    SELECT Name, "Group", Date, y / nullif(lag(y) OVER (PARTITION BY Name ORDER BY Date), 0) - 1 AS value FROM (
      SELECT s.Name, c."Group", s.Date, s.Close * u.Close AS y FROM x_series s JOIN x_catalogue c ON s.Name = c.Name AND c."Group" = 'commodity' AND c.is_adopted
      LEFT JOIN (SELECT Date, Close FROM x_series WHERE Name = 'USDJPY') u ON s.Date = u.Date)""", "value")
def commodity_in_yen(m: Market):
    return FE.commodity_in_yen(m.series, m.catalogue)


ADOPTED = [n for n in SERIES_NAMES if n != "NK225"]
X_WIDE = "SELECT Date, " + ", ".join(
    f"""last_value(max(value) FILTER (Name = '{n}') IGNORE NULLS) OVER (ORDER BY Date {UP}) AS "{n}_1d_return" """ for n in ADOPTED) + f" FROM ({X_RET}) GROUP BY Date"


@query("wide_series", "C8 G5", X_WIDE, " ".join(f"{n}_1d_return" for n in ADOPTED))
def wide_series(m: Market):
    return FE.widen_series(FE.series_returns(m.series, m.catalogue), ADOPTED)


def _leg(pair: str) -> str:
    return f'"{pair}_1d_return"'


STRENGTH = {"JPY": "-{USDJPY} - {EURJPY} - {AUDJPY}", "USD": "{USDJPY} - {EURUSD} - {AUDUSD}", "AUD": "{AUDJPY} + {AUDUSD} - {EURAUD}", "EUR": "{EURJPY} + {EURUSD} + {EURAUD}"}
STRENGTH_SQL = ", ".join(f'({t.format(**{p: _leg(p) for p in FE.CURRENCY_PAIRS})}) / 3 AS "{c}_1d_return"' for c, t in STRENGTH.items())
DROPPED = ", ".join(_leg(p) for p in FE.CURRENCY_PAIRS)


@query("currency_strength", "B16", f"SELECT Date, {STRENGTH_SQL} FROM ({X_WIDE})", " ".join(f"{c}_1d_return" for c in STRENGTH))
def currency_strength(m: Market):
    wide = FE.widen_series(FE.series_returns(m.series, m.catalogue), ADOPTED)
    return FE.currency_strength(wide).select("Date", *[f"{c}_1d_return" for c in STRENGTH])


BONDS = """"JP_bond10_1d_return", "US_bond10_1d_return", "JP_bond10_1d_return" - "JP_bond2_1d_return" AS "JP_bond_diff_1d_return", "US_bond10_1d_return" - "US_bond2_1d_return" AS "US_bond_diff_1d_return" """
BOND_COLS = "JP_bond10_1d_return US_bond10_1d_return JP_bond_diff_1d_return US_bond_diff_1d_return"


@query("bond_term_spread", "B17", f"SELECT Date, {BONDS} FROM ({X_WIDE})", BOND_COLS)
def bond_term_spread(m: Market):
    wide = FE.widen_series(FE.series_returns(m.series, m.catalogue), ADOPTED)
    return FE.bond_spread(wide).select("Date", *BOND_COLS.split())


REST = '"WTI_1d_return", "Gold_1d_return", "TOPIX_1d_return"'
X_FEAT_IDX = f"SELECT Date, {REST}, {STRENGTH_SQL}, {BONDS} FROM ({X_WIDE})"
FEAT_IDX_COLS = "WTI_1d_return Gold_1d_return TOPIX_1d_return " + " ".join(f"{c}_1d_return" for c in STRENGTH) + " " + BOND_COLS


@query("cross_asset_features", "C8 B16 B17 E14", X_FEAT_IDX, FEAT_IDX_COLS)
def cross_asset_features(m: Market):
    return FE.index_features(m.series, m.catalogue, ADOPTED)


MOM = f"""{band('avg', '"1d_return"', 4, 1)} AS "5d_mom", {band('avg', '"1d_return"', 16, 5)} AS "21d_mom" """
VOLA = f"""{band('stddev_samp', '"1d_return"', 4, 1)} AS "5d_vola", {band('stddev_samp', '"1d_return"', 16, 5)} AS "21d_vola" """


@query("sector_momentum", "E15", f"SELECT Date, Sector, {MOM} FROM x_index", "5d_mom 21d_mom")
def sector_momentum(m: Market):
    return FE.momentum(m.index).select("Date", "Sector", "5d_mom", "21d_mom")


@query("sector_volatility", "E16", f"SELECT Date, Sector, {VOLA} FROM x_index", "5d_vola 21d_vola")
def sector_volatility(m: Market):
    return FE.volatility(m.index).select("Date", "Sector", "5d_vola", "21d_vola")


@query("daily_sector_ranks", "E17 E18", f"""
    SELECT Date, Sector, {avg_rank('Target', desc=True)} AS Target_rank, {avg_rank('Pred', desc=True)} AS Pred_rank, {avg_rank('Pred')} AS Pred_rank_up FROM x_pred""")
def daily_sector_ranks(m: Market):
    out = FE.add_daily_ranks(m.predictions, {"Target": "Target_rank", "Pred": "Pred_rank"})
    return FE.add_daily_ranks(out, {"Pred": "Pred_rank_up"}, ascending=True).drop("Target", "Pred")


@query("sector_categories", "H4", """
    SELECT Sector, CAST(row_number() OVER (ORDER BY first, Sector) - 1 AS INTEGER) AS Sector_cat FROM (SELECT Sector, min(Date) AS first FROM x_index GROUP BY Sector)""")
def sector_categories(m: Market):
    return FE.sector_category(m.index.select("Date", "Sector")).select("Sector", "Sector_cat").distinct()


X_FEATURES = f"""SELECT i.Date, i.Sector, "1d_return", {MOM}, {VOLA}, s.MarketCapAtClose, e.ForecastEPS FROM (SELECT Date, Sector, "1d_return" FROM x_index) i
    LEFT JOIN (SELECT Date, Sector, avg(MarketCapClose) AS MarketCapAtClose FROM x_caps JOIN x_definition USING (Code) GROUP BY Date, Sector) s ON i.Date = s.Date AND i.Sector = s.Sector
    LEFT JOIN (WITH f AS (SELECT *, last_value(E IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {UP}) AS e1 FROM ({AS_OF.replace('x_traded', 'x_price')})),
      b AS (SELECT *, first_value(e1 IGNORE NULLS) OVER (PARTITION BY Code ORDER BY Date {DOWN}) AS e2 FROM f)
      SELECT Date, Sector, avg(e2) AS ForecastEPS FROM b JOIN x_definition USING (Code) WHERE traded GROUP BY Date, Sector) e ON i.Date = e.Date AND i.Sector = e.Sector"""
X_FEATURES = X_FEATURES.replace("PARTITION BY Sector", "PARTITION BY i.Sector").replace("ORDER BY Date ROWS BETWEEN 4 ", "ORDER BY i.Date ROWS BETWEEN 4 ").replace("ORDER BY Date ROWS BETWEEN 20 ", "ORDER BY i.Date ROWS BETWEEN 20 ")


@query("price_features", "E15 E16 E17 D2 D3 C7", f"""
    SELECT Date, Sector, "1d_return", "5d_mom", "21d_mom", "5d_vola", "21d_vola", MarketCapAtClose, ForecastEPS,
      {avg_rank('MarketCapAtClose', desc=True)} AS MarketCap_rank, {avg_rank('round(ForecastEPS, 6)', desc=True)} AS ForecastEPS_rank FROM ({X_FEATURES})""",
       "1d_return 5d_mom 21d_mom 5d_vola 21d_vola MarketCapAtClose:1 ForecastEPS:4")
def price_features(m: Market):
    return m.features.select("Date", "Sector", "1d_return", "5d_mom", "21d_mom", "5d_vola", "21d_vola", "MarketCapAtClose",
                             "ForecastEPS", "MarketCap_rank", "ForecastEPS_rank")


@query("merged_features", "C10", f"""
    SELECT Date, Sector, last_value("TOPIX_1d_return" IGNORE NULLS) OVER w AS "TOPIX_1d_return", last_value("JPY_1d_return" IGNORE NULLS) OVER w AS "JPY_1d_return",
      last_value("5d_mom" IGNORE NULLS) OVER w AS "5d_mom" FROM (SELECT p.Date, p.Sector, "5d_mom", "TOPIX_1d_return", "JPY_1d_return"
        FROM (SELECT Date, Sector, {MOM} FROM x_index) p LEFT JOIN ({X_FEAT_IDX}) i ON p.Date = i.Date) WINDOW w AS (PARTITION BY Sector ORDER BY Date {UP})""", "TOPIX_1d_return JPY_1d_return 5d_mom")
def merged_features(m: Market):
    wide = FE.index_features(m.series, m.catalogue, ADOPTED).select("Date", "TOPIX_1d_return", "JPY_1d_return")
    return FE.merge_features(wide, FE.momentum(m.index).select("Date", "Sector", "5d_mom"))


# Names of the 25 nations.
NATIONS = [f"NATION_{i}" for i in range(25)]


@query("one_hot_sectors", "H5", "SELECT Date, Sector, " + ", ".join(f"CAST(Sector = '{n}' AS INTEGER) AS Sector_{n}" for n in NATIONS) + " FROM x_target")
def one_hot_sectors(m: Market):
    return D.one_hot(m.target.select("Date", "Sector"), m.sectors)


@query("daytime_return", "B15", "SELECT Date, Code, Close / nullif(Open, 0) - 1 AS Target FROM x_traded", "Target")
def daytime_return(m: Market):
    return m.traded.select("Date", "Code", S.daytime_return(F.col("Open"), F.col("Close")).alias("Target"))
