"""Queries over realised trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.operators import metrics as ME
from panelforge.operators import trades as TR
from panelforge.plans.catalog_evaluation import MONTHS, RUN, describe_sql
from panelforge.plans.market import Market
from panelforge.plans.reference_sql import CTES
from panelforge.plans.registry import QUERIES, query

RATES = "Rate RateAfterTax"


def daily(m: Market):
    return TR.daily_profit(m.ledger)


def leveraged(m: Market):
    return TR.daily_leveraged(m.deposits, daily(m))


@query("fill_vwap", "D5", "SELECT Date, Type, Code, CompanyName, CAST(sum(Shares) AS BIGINT) AS Shares, sum(Price * Shares) / sum(Shares) AS Price FROM x_fills GROUP BY ALL", "Price")
def fill_vwap(m: Market):
    return TR.fill_vwap(m.fills)


CTES["x_totals"] = """SELECT Date, CompanyName, Code, Market, Type, CAST(sum(Shares) AS BIGINT) AS Shares, sum(Price) AS Price, CAST(sum(Fee) AS BIGINT) AS Fee, CAST(sum(Tax) AS BIGINT) AS Tax FROM x_fills GROUP BY ALL"""


@query("fill_totals", "D6", "SELECT * FROM x_totals")
def fill_totals(m: Market):
    return TR.fill_totals(m.fills)


VWAP = "SELECT Date, Code, CompanyName, Type, CAST(sum(Shares) AS BIGINT) AS Shares, sum(Price * Shares) / sum(Shares) AS Price FROM x_fills GROUP BY ALL"
PAIRS = f"""WITH v AS ({VWAP}),
    o AS (SELECT *, CASE WHEN Type = '信用新規売' THEN '売' ELSE '買' END AS Side FROM v WHERE Type IN ('信用新規買', '信用新規売')),
    c AS (SELECT *, CASE WHEN Type = '信用返済買' THEN '売' ELSE '買' END AS Side FROM v WHERE Type IN ('信用返済買', '信用返済売'))
    SELECT Date, Code, Side, CompanyName, coalesce(o.Shares, 0) AS Shares, coalesce(o.Price, 0.0) AS AcqPrice, coalesce(c.Price, 0.0) AS SettlePrice
    FROM o FULL JOIN c USING (Date, Code, Side, CompanyName)"""


@query("fills_paired", "C15", PAIRS, "AcqPrice SettlePrice")
def fills_paired(m: Market):
    return TR.pair_fills(TR.fill_vwap(m.fills)).select("Date", "Code", "Side", "CompanyName", "Shares", "AcqPrice", "SettlePrice")


@query("trade_profit", "L11", "SELECT Date, Code, Side, Sector, AcqAmount, SettleAmount, Fee, Profit, Rate FROM x_ledger", "Rate")
def trade_profit(m: Market):
    return m.ledger.select("Date", "Code", "Side", "Sector", "AcqAmount", "SettleAmount", "Fee", "Profit", "Rate")


@query("cashflows_normalised", "B26", "SELECT Date, Text, Amount FROM x_cash")
def cashflows_normalised(m: Market):
    return TR.normalise_cashflows(m.cash_raw)


@query("spot_deltas_signed", "B27", "SELECT Date, CAST(sum(CASE WHEN Side = '買' THEN -AcqAmount ELSE AcqAmount END) AS BIGINT) AS Delta FROM x_ledger GROUP BY Date")
def spot_deltas_signed(m: Market):
    signed = TR.signed_spot_delta(m.ledger.withColumn("Delta", F.col("AcqAmount")))
    return signed.groupBy("Date").agg(F.sum("Delta").alias("Delta"))


@query("deposits_rolled_forward", "L12", "SELECT Date, Deposit FROM x_deposits")
def deposits_rolled_forward(m: Market):
    return m.deposits


@query("expanding_mean_deposit", "E26", f"SELECT Date, Deposit, CAST(trunc(avg(Deposit) OVER (ORDER BY Date {RUN})) AS BIGINT) AS MeanDeposit FROM x_deposits")
def expanding_mean_deposit(m: Market):
    return TR.expanding_mean_deposit(m.deposits)


@query("daily_profit", "D8 E27", "SELECT * FROM x_daily", RATES)
def daily_profit(m: Market):
    return daily(m)


@query("daily_profit_summary", "D13", describe_sql("x_daily", RATES.split(), sharpe=True), RATES)
def daily_profit_summary(m: Market):
    return ME.describe(daily(m), RATES.split(), with_sharpe=True)


@query("daily_profit_by_sector", "E28 D8", "SELECT * FROM x_daily_sector", RATES)
def daily_profit_by_sector(m: Market):
    return TR.daily_profit_by_sector(m.ledger)


@query("daily_leveraged", "L13", "SELECT * FROM x_lev", RATES)
def daily_leveraged(m: Market):
    return leveraged(m)


CUM = "product({0} + 1) OVER w - 1 AS {0}"


@query("daily_cumulative", "E26", f"""SELECT Date, avg(AcqAmount) OVER w AS MeanAcqAmount, CAST(sum(Profit) OVER w AS BIGINT) AS Profit, {CUM.format('Rate')}, CAST(sum(ProfitAfterTax) OVER w AS BIGINT) AS ProfitAfterTax,
    {CUM.format('RateAfterTax')} FROM x_daily WINDOW w AS (ORDER BY Date {RUN})""", "MeanAcqAmount:2 " + RATES)
def daily_cumulative(m: Market):
    return TR.daily_cumulative(daily(m))


@query("daily_leveraged_cumulative", "L13 E26", f"""SELECT Date, CAST(trunc(avg(Deposit) OVER w) AS BIGINT) AS MeanDeposit, CAST(sum(Profit) OVER w AS BIGINT) AS Profit, {CUM.format('Rate')},
    CAST(sum(ProfitAfterTax) OVER w AS BIGINT) AS ProfitAfterTax, {CUM.format('RateAfterTax')} FROM x_lev WINDOW w AS (ORDER BY Date {RUN})""", RATES)
def daily_leveraged_cumulative(m: Market):
    return TR.leveraged_cumulative(m.deposits, leveraged(m))


MONTH_AGG = "avg(AcqAmount) AS MeanAcqAmount, count(*) AS Days, CAST(sum(Profit) AS BIGINT) AS Profit, CAST(sum(ProfitAfterTax) AS BIGINT) AS ProfitAfterTax"


@query("monthly_profit", "D9", f"""
    SELECT c.Date, MeanAcqAmount, coalesce(Days, 0) AS Days, coalesce(Profit, 0) AS Profit, coalesce(ProfitAfterTax, 0) AS ProfitAfterTax, Profit / MeanAcqAmount AS Rate, ProfitAfterTax / MeanAcqAmount AS RateAfterTax
    FROM ({MONTHS.format(t='x_daily')}) c LEFT JOIN (SELECT last_day(Date) AS Date, {MONTH_AGG} FROM x_daily GROUP BY 1) g ON c.Date = g.Date""", "MeanAcqAmount:2 " + RATES)
def monthly_profit(m: Market):
    return TR.monthly_profit(daily(m))


@query("monthly_profit_by_sector", "D10", f"""
    SELECT c.Side, c.Sector, c.Date, MeanAcqAmount, coalesce(Days, 0) AS Days, coalesce(Profit, 0) AS Profit, coalesce(ProfitAfterTax, 0) AS ProfitAfterTax, Profit / MeanAcqAmount AS Rate, ProfitAfterTax / MeanAcqAmount AS RateAfterTax
    FROM (SELECT Side, Sector, last_day(CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE)) AS Date FROM (SELECT Side, Sector, date_trunc('month', min(Date)) AS a, date_trunc('month', max(Date)) AS b FROM x_daily_sector GROUP BY 1, 2)) c
    LEFT JOIN (SELECT Side, Sector, last_day(Date) AS Date, {MONTH_AGG} FROM x_daily_sector GROUP BY 1, 2, 3) g ON c.Date = g.Date AND c.Side = g.Side AND c.Sector = g.Sector""", "MeanAcqAmount:2 " + RATES)
def monthly_profit_by_sector(m: Market):
    return TR.monthly_profit(TR.daily_profit_by_sector(m.ledger), ["Side", "Sector"])


@query("monthly_leveraged", "D11", f"""
    SELECT m.Date, power + mean - first AS MeanDeposit, coalesce(d.Days, 0) AS Days, coalesce(Profit, 0) AS Profit, coalesce(ProfitAfterTax, 0) AS ProfitAfterTax, Profit / (power + mean - first) AS Rate, ProfitAfterTax / (power + mean - first) AS RateAfterTax
    FROM ({MONTHS.format(t='x_deposits')}) m
    LEFT JOIN (SELECT last_day(Date) AS Date, avg(Deposit) AS mean, arg_min(Deposit, Date) AS first, count(*) AS Days FROM x_deposits GROUP BY 1) d ON m.Date = d.Date
    LEFT JOIN (SELECT last_day(Date) AS Date, arg_min(Deposit * 2, Date) AS power FROM x_deposits GROUP BY 1) p ON m.Date = p.Date
    LEFT JOIN (SELECT last_day(Date) AS Date, CAST(sum(Profit) AS BIGINT) AS Profit, CAST(sum(ProfitAfterTax) AS BIGINT) AS ProfitAfterTax FROM x_lev GROUP BY 1) l ON m.Date = l.Date""", "MeanDeposit:2 " + RATES)
def monthly_leveraged(m: Market):
    power = m.deposits.select("Date", (F.col("Deposit") * 2).alias("BuyingPower"))
    return TR.monthly_leveraged(m.deposits, power, leveraged(m))


TOTAL = "SELECT {k} {mean} AS MeanAcqAmount, count(*) AS Days, CAST(sum(Profit) AS BIGINT) AS Profit, CAST(sum(ProfitAfterTax) AS BIGINT) AS ProfitAfterTax, sum(Profit) / avg(AcqAmount) AS MeanReturn, sum(ProfitAfterTax) / avg(AcqAmount) AS MeanReturnAfterTax FROM {t} {g}"


@query("total_profit", "D12 D20", TOTAL.format(k="", mean="CAST(trunc(avg(AcqAmount)) AS BIGINT)", t="x_daily", g=""), "MeanReturn MeanReturnAfterTax")
def total_profit(m: Market):
    return TR.total_profit(daily(m))


@query("total_profit_by_sector", "D12", TOTAL.format(k="Side, Sector,", mean="avg(AcqAmount)", t="x_daily_sector", g="GROUP BY Side, Sector"), "MeanAcqAmount:2 MeanReturn MeanReturnAfterTax")
def total_profit_by_sector(m: Market):
    return TR.total_profit(TR.daily_profit_by_sector(m.ledger), ["Side", "Sector"])


@query("total_leveraged", "D12", """
    SELECT (SELECT CAST(trunc(avg(Deposit)) AS BIGINT) FROM x_deposits) AS MeanDeposit, (SELECT count(*) FROM x_deposits) AS Days, CAST(sum(Profit) AS BIGINT) AS Profit, CAST(sum(ProfitAfterTax) AS BIGINT) AS ProfitAfterTax,
      sum(Profit) / (SELECT avg(Deposit) FROM x_deposits) AS TotalReturn, sum(ProfitAfterTax) / (SELECT avg(Deposit) FROM x_deposits) AS TotalReturnAfterTax FROM x_lev""", "TotalReturn TotalReturnAfterTax")
def total_leveraged(m: Market):
    return TR.total_leveraged(m.deposits, leveraged(m))


@query("latest_result", "D22", "SELECT Date, CAST(sum(Profit) AS BIGINT) AS Profit, sum(Profit) / sum(AcqAmount) AS Rate FROM x_ledger WHERE Date = (SELECT max(Date) FROM x_ledger) GROUP BY Date", "Rate")
def latest_result(m: Market):
    return TR.latest_result(m.ledger)


@query("trade_report_levels", "L14 D8 D10 D12", """
    WITH r AS (SELECT *, last_day(Date) AS Month FROM x_daily_sector),
    g AS (SELECT Side, Sector, Month, Date, sum(AcqAmount) AS a, sum(Profit) AS p, sum(ProfitAfterTax) AS t, 'day' AS Level FROM r GROUP BY Side, Sector, Month, Date
      UNION ALL SELECT Side, Sector, Month, NULL, sum(AcqAmount), sum(Profit), sum(ProfitAfterTax), 'month' FROM r GROUP BY Side, Sector, Month
      UNION ALL SELECT Side, Sector, NULL, NULL, sum(AcqAmount), sum(Profit), sum(ProfitAfterTax), 'total' FROM r GROUP BY Side, Sector)
    SELECT Side, Sector, Level, CAST(coalesce(Date, Month) AS DATE) AS Upto, CAST(a AS BIGINT) AS AcqAmount, CAST(p AS BIGINT) AS Profit, CAST(t AS BIGINT) AS ProfitAfterTax FROM g""")
def trade_report_levels(m: Market):
    rows = TR.report_rollup(TR.daily_profit_by_sector(m.ledger))
    return rows.select("Side", "Sector", "Level", F.coalesce("Date", "Month").alias("Upto"), "AcqAmount", "Profit", "ProfitAfterTax")


#: The report's tables, the query that states each, and the columns that tell its rows apart.
REPORT = {
    "daily": ("daily_profit", "Date"), "daily_summary": ("daily_profit_summary", "Stat"), "daily_by_sector": ("daily_profit_by_sector", "Date Side Sector"),
    "daily_leveraged": ("daily_leveraged", "Date"), "daily_leveraged_summary": (None, "Stat"), "daily_cumulative": ("daily_cumulative", "Date"),
    "daily_leveraged_cumulative": ("daily_leveraged_cumulative", "Date"), "monthly": ("monthly_profit", "Date"), "monthly_by_sector": ("monthly_profit_by_sector", "Date Side Sector"),
    "monthly_leveraged": ("monthly_leveraged", "Date"), "total": ("total_profit", ""), "total_by_sector": ("total_profit_by_sector", "Side Sector"), "total_leveraged": ("total_leveraged", "")}
_AMOUNTS, _RATES = ("Profit", "ProfitAfterTax"), ("Rate", "RateAfterTax")
REPORT_COLUMNS = {
    "daily": ("AcqAmount", "DayTax", *_AMOUNTS, *_RATES), "daily_summary": _RATES, "daily_by_sector": ("AcqAmount", "DayTax", *_AMOUNTS, *_RATES), "daily_leveraged": ("Deposit", *_AMOUNTS, *_RATES),
    "daily_leveraged_summary": _RATES, "daily_cumulative": ("MeanAcqAmount", *_AMOUNTS, *_RATES), "daily_leveraged_cumulative": ("MeanDeposit", *_AMOUNTS, *_RATES),
    "monthly": ("MeanAcqAmount", "Days", *_AMOUNTS, *_RATES), "monthly_by_sector": ("MeanAcqAmount", "Days", *_AMOUNTS, *_RATES), "monthly_leveraged": ("MeanDeposit", "Days", *_AMOUNTS, *_RATES),
    "total": ("MeanAcqAmount", "Days", *_AMOUNTS, "MeanReturn", "MeanReturnAfterTax"), "total_by_sector": ("MeanAcqAmount", "Days", *_AMOUNTS, "MeanReturn", "MeanReturnAfterTax"),
    "total_leveraged": ("MeanDeposit", "Days", *_AMOUNTS, "TotalReturn", "TotalReturnAfterTax")}


def _digits(column: str) -> int:
    return 6 if "Rate" in column or "Return" in column else 3


def _report_sql() -> str:
    """Every cell of every table as a row."""
    parts = []
    for table, (name, keys) in REPORT.items():
        source = QUERIES[name].sql if name else describe_sql("x_lev", RATES.split(), sharpe=True)
        key = "'' " + "".join(f" || '|' || CAST({k} AS VARCHAR)" for k in keys.split())
        parts += [f"SELECT '{table}' AS TableName, {key} AS Key, '{c}' AS Measure, round(CAST({c} AS DOUBLE), {_digits(c)}) + 0.0 AS Value FROM ({source})" for c in REPORT_COLUMNS[table]]
    return " UNION ALL ".join(parts)


@query("trade_report_tables", "L14", _report_sql())
def trade_report_tables(m: Market):
    """All thirteen tables of the report, cell by cell."""
    tables = TR.report(m.ledger, m.deposits, m.deposits.select("Date", (F.col("Deposit") * 2).alias("BuyingPower")))
    out = None
    for name, (_, keys) in REPORT.items():
        key = F.concat(F.lit(""), *[F.concat(F.lit("|"), F.col(k).cast("string")) for k in keys.split()])
        cells = F.array(*[F.struct(F.lit(c).alias("Measure"), F.round(F.col(c).cast("double"), _digits(c)).alias("Value")) for c in REPORT_COLUMNS[name]])
        rows = tables[name].select(F.lit(name).alias("TableName"), key.alias("Key"), F.inline(cells))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("settle_list", "L15", "SELECT DISTINCT Code FROM x_ledger WHERE Code NOT IN (SELECT Code FROM x_ledger WHERE Shares >= 120)")
def settle_list(m: Market):
    return TR.settle_list(m.ledger.select("Code").distinct(), m.ledger.filter("Shares >= 120"))


@query("position_filters", "L16", """
    SELECT 'pending' AS Kind, count(*) AS Positions FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
    UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def position_filters(m: Market):
    state = lambda c: F.when(c, TR.UNORDERED).otherwise(TR.ORDERED)
    positions = m.table("orders").select(state(F.col("o_orderstatus") == "O").alias("OrderStatus"), state(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("SettlementStatus"))
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("Positions")).select(F.lit(n).alias("Kind"), "Positions")
    return count(TR.pending_positions(positions), "pending").unionByName(count(TR.open_positions(positions), "open"))


@query("annualised_daily_returns", "B22", "SELECT Date, pow(1 + Rate / 100, 252) - 1 AS Annual, abs(Rate) * sqrt(252) AS Volatility FROM x_daily", "Annual Volatility")
def annualised_daily_returns(m: Market):
    return daily(m).select("Date", S.annualise_return(F.col("Rate") / 100).alias("Annual"), S.annualise_volatility(F.abs("Rate")).alias("Volatility"))
