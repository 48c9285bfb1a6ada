"""Queries over back-test evaluation and return metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions import normal as N
from panelforge.functions import scalar as S
from panelforge.operators import evaluate as EV
from panelforge.operators import metrics as ME
from panelforge.plans.market import Market
from panelforge.plans.reference_sql import CTES, avg_rank
from panelforge.plans.registry import query
from panelforge.session import reuse

RUN = "ROWS UNBOUNDED PRECEDING"
TAX, LEV = "0.20315", "3.1"


def describe_sql(table: str, cols: list[str], by: str = "", sharpe: bool = False) -> str:
    """Long describe: one SELECT per statistic."""
    stats = [("count", "CAST(count({c}) AS DOUBLE)"), ("mean", "avg({c})"), ("std", "stddev_samp({c})"), ("min", "CAST(min({c}) AS DOUBLE)"),
             ("25%", "quantile_cont({c}, 0.25)"), ("50%", "quantile_cont({c}, 0.5)"), ("75%", "quantile_cont({c}, 0.75)"), ("max", "CAST(max({c}) AS DOUBLE)")]
    if sharpe:
        stats.append(("SR", "avg({c}) / nullif(stddev_samp({c}), 0)"))
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(f"SELECT {key}'{n}' AS Stat, " + ", ".join(f"{e.format(c=c)} AS {c}" for c in cols) + f" FROM {table}{group}" for n, e in stats)


def poly(coef, x: str) -> str:
    out = f"{float(coef[0])!r}::DOUBLE"
    for c in coef[1:]:
        out = f"({out} * {x} + {float(c)!r}::DOUBLE)"
    return out


def cdf_sql(z: str) -> str:
    a = f"abs({z})"
    body = f"exp(-{a} * {a} / 2) * {poly(N.HART_NUM, a)} / {poly(N.HART_DEN, a)}"
    frac = f"({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65::DOUBLE)))))"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN {body} ELSE exp(-{a} * {a} / 2) / {frac} / 2.506628274631 END)"
    return f"CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


def ppf_sql(p: str) -> str:
    q = f"({p} - 0.5)"
    r = f"(0.180625::DOUBLE - {q} * {q})"
    t = f"sqrt(-ln(CASE WHEN {q} < 0 THEN {p} ELSE 1 - {p} END))"
    centre = f"{q} * {poly(N.AS241_A[::-1], r)} / {poly(N.AS241_B[::-1], r)}"
    near = f"{poly(N.AS241_C[::-1], f'({t} - 1.6)')} / {poly(N.AS241_D[::-1], f'({t} - 1.6)')}"
    far = f"{poly(N.AS241_E[::-1], f'({t} - 5.0)')} / {poly(N.AS241_F[::-1], f'({t} - 5.0)')}"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE sign({q}) * CASE WHEN {t} <= 5 THEN {near} ELSE {far} END END)"


def perf(m: Market):
    return EV.long_short_performance(m.result)


@query("result_panel_ranks", "E18 C13", "SELECT Date, Sector, RawTarget, Target_Rank, Pred_Rank FROM x_result")
def result_panel_ranks(m: Market):
    return m.result.select("Date", "Sector", "RawTarget", "Target_Rank", "Pred_Rank")


@query("benchmark_returns", "E35", "SELECT Date, Close / Open - 1 AS Control_daytime, Close / lag(Close) OVER (ORDER BY Date) - 1 AS Control_hold FROM x_series WHERE Name = 'TOPIX'", "Control_daytime Control_hold")
def benchmark_returns(m: Market):
    return EV.benchmark_returns(m.series)


EDGES = [i / 5 for i in range(1, 5)]
CTES["x_bins"] = """SELECT Date, Pred_Bin, avg(RawTarget) AS RawTarget FROM (SELECT r.*, """ + " + ".join(
    f"CASE WHEN e{i} < Pred_Rank THEN 1 ELSE 0 END" for i in range(4)) + """ AS Pred_Bin FROM x_result r JOIN (SELECT Date, """ + ", ".join(
    f"quantile_cont(Pred_Rank, {q}) AS e{i}" for i, q in enumerate(EDGES)) + """ FROM x_result WHERE Target IS NOT NULL AND RawTarget IS NOT NULL GROUP BY Date) e ON r.Date = e.Date
    WHERE Target IS NOT NULL AND RawTarget IS NOT NULL) GROUP BY Date, Pred_Bin"""


@query("quantile_bin_returns", "D14 K17", "SELECT Date, CAST(Pred_Bin AS INTEGER) AS Pred_Bin, RawTarget FROM x_bins", "RawTarget:12")
def quantile_bin_returns(m: Market):
    return EV.quantile_bin_returns(m.result, 5)


@query("quantile_bin_matrix", "D14", "SELECT Date, " + ", ".join(f'max(RawTarget) FILTER (Pred_Bin = {i}) AS "{i}"' for i in range(5)) + " FROM x_bins GROUP BY Date", "0:12 1:12 2:12 3:12 4:12")
def quantile_bin_matrix(m: Market):
    return EV.quantile_bin_matrix(m.result, 5)


@query("quantile_bin_summary", "D13 D14", f"SELECT CAST(Pred_Bin AS INTEGER) AS Pred_Bin, Stat, RawTarget FROM ({describe_sql('x_bins', ['RawTarget'], 'Pred_Bin')})", "RawTarget:9")
def quantile_bin_summary(m: Market):
    return EV.quantile_bin_summary(m.result, 5)


@query("long_short_performance", "K14 F1 E22 E23 E24", "SELECT Date, LS, LS_Cumprod, DD, MaxDD, DDdays, MaxDDdays, Long, Short, L_Cumprod, S_Cumprod FROM x_perf", "LS:12 LS_Cumprod DD MaxDD Long:12 Short:12 L_Cumprod S_Cumprod")
def long_short_performance(m: Market):
    return perf(m)


@query("long_short_overweight", "F4 F1", """
    SELECT *, (Long + Short) / 2 AS LS FROM (SELECT Date, avg(CASE WHEN Pred_Rank > mx - 3 THEN RawTarget * CASE WHEN Pred_Rank = mx THEN 1.5 ELSE 0.75 END END) AS Long,
      avg(CASE WHEN Pred_Rank <= 3 THEN -RawTarget * CASE WHEN Pred_Rank = mn THEN 1.5 ELSE 0.75 END END) AS Short
      FROM (SELECT *, max(Pred_Rank) OVER (PARTITION BY Date) AS mx, min(Pred_Rank) OVER (PARTITION BY Date) AS mn FROM x_result) GROUP BY Date)""", "Long:12 Short:12 LS:12")
def long_short_overweight(m: Market):
    return EV.long_short(m.result, 3, 1.5)


@query("long_short_summary", "D13 K14", describe_sql("x_perf", ["Long", "Short", "LS"], sharpe=True), "Long:9 Short:9 LS:9")
def long_short_summary(m: Market):
    return EV.long_short_summary(perf(m))


PRIOR = f"""SELECT * FROM (SELECT Date, LS, avg(LS) OVER w AS CumMean, stddev_samp(LS) OVER w AS CumStd, count(LS) OVER w - 1 AS DegFreedom FROM x_ls
    WINDOW w AS (ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE LS IS NOT NULL AND CumMean IS NOT NULL AND CumStd IS NOT NULL"""


@query("prior_moments", "E25", PRIOR, "LS:12 CumMean:9 CumStd:9")
def prior_moments(m: Market):
    return EV.prior_moments(EV.long_short(m.result))


@query("daily_probability", "K19", f"SELECT Date, LS, {cdf_sql('z')} AS Probability FROM (SELECT *, (LS - CumMean) / nullif(CumStd, 0) AS z FROM ({PRIOR}))", "LS:12 Probability")
def daily_probability(m: Market):
    return EV.daily_probability(EV.long_short(m.result)).select("Date", "LS", "Probability")


@query("daily_probability_bounds", "K18 K19")
def daily_probability_bounds(m: Market):
    return EV.daily_probability_bounds(EV.long_short(m.result))


@query("population_estimate", "K18 K7")
def population_estimate(m: Market):
    return EV.population_estimate(EV.long_short(m.result), "LS")


CONTROL = "SELECT Date, Close / Open - 1 AS c FROM x_series WHERE Name = 'TOPIX'"
MINUS = f"SELECT p.Date, p.Long - c AS Long, p.Short + c AS Short, p.LS FROM x_ls p LEFT JOIN ({CONTROL}) k ON p.Date = k.Date"


@query("performance_minus_benchmark", "K15 C14", f"""
    SELECT Date, Long, Short, LS, CASE WHEN Long IS NOT NULL THEN product(Long + 1) OVER w - 1 END AS L_Cumprod, CASE WHEN Short IS NOT NULL THEN product(Short + 1) OVER w - 1 END AS S_Cumprod
    FROM ({MINUS}) WINDOW w AS (ORDER BY Date {RUN})""", "Long Short LS L_Cumprod S_Cumprod")
def performance_minus_benchmark(m: Market):
    return EV.minus_benchmark(perf(m), EV.benchmark_returns(m.series)).select("Date", "Long", "Short", "LS", "L_Cumprod", "S_Cumprod")


MONTHS = """SELECT CAST(last_day(CAST(unnest(generate_series(date_trunc('month', min(Date)), date_trunc('month', max(Date)), INTERVAL 1 MONTH)) AS DATE)) AS DATE) AS Date FROM {t}"""


@query("monthly_long_short", "K16 K9", f"""
    SELECT *, product(LS + 1) OVER (ORDER BY Date {RUN}) - 1 AS Cumprod FROM (SELECT c.Date, coalesce(l, 1) - 1 AS Long, coalesce(s, 1) - 1 AS Short, coalesce(x, 1) - 1 AS LS FROM ({MONTHS.format(t='x_ls')}) c
      LEFT JOIN (SELECT last_day(Date) AS Date, product(Long + 1) AS l, product(Short + 1) AS s, product(LS + 1) AS x FROM x_ls GROUP BY 1) g ON c.Date = g.Date)""", "Long Short LS Cumprod")
def monthly_long_short(m: Market):
    return EV.monthly_long_short(EV.long_short(m.result))


CTES["x_traded_sectors"] = """SELECT r.*, Side FROM (SELECT *, (SELECT count(DISTINCT Sector) FROM x_result) AS n FROM x_result) r, (VALUES ('Long'), ('Short')) AS s(Side)
    WHERE (Side = 'Long' AND Pred_Rank >= n - 2) OR (Side = 'Short' AND Pred_Rank <= 3)"""


@query("daily_sector_listing", "F3 D19", "SELECT Date, Sector, Side, Pred_Rank, RawTarget FROM x_traded_sectors")
def daily_sector_listing(m: Market):
    return EV.daily_sector_listing(m.result).select("Date", "Sector", "Side", "Pred_Rank", "RawTarget")


@query("monthly_sector_performance", "D15", """
    SELECT CAST(last_day(Date) AS DATE) AS Date, Sector, CAST(count(*) FILTER (Side = 'Long') AS DOUBLE) AS Long_Num, coalesce(product(RawTarget + 1) FILTER (Side = 'Long'), 0) AS Long_Growth,
      CAST(count(*) FILTER (Side = 'Short') AS DOUBLE) AS Short_Num, coalesce(product(abs(RawTarget - 1)) FILTER (Side = 'Short'), 0) AS Short_Growth
    FROM (SELECT *, max(Date) OVER (PARTITION BY Side) AS last FROM x_traded_sectors) WHERE Date <> last GROUP BY 1, 2""", "Long_Growth Short_Growth")
def monthly_sector_performance(m: Market):
    return EV.monthly_sector_performance(m.result)


def _side(s: str) -> str:
    x = f"FILTER (Side = '{s}')"
    return (f"CAST(count(Target_Rank) {x} AS DOUBLE) AS {s}_num, coalesce(avg(Target_Rank) {x}, 0) AS {s}_mean, coalesce(quantile_cont(Target_Rank, 0.5) {x}, 0) AS {s}_med, "
            f"coalesce(stddev_samp(Target_Rank) {x}, 0) AS {s}_std")


@query("total_sector_performance", "D16", f"SELECT *, Long_num + Short_num AS Total_num FROM (SELECT Sector, {_side('Long')}, {_side('Short')} FROM x_traded_sectors GROUP BY Sector)", "Long_mean Long_med Long_std Short_mean Short_med Short_std")
def total_sector_performance(m: Market):
    return EV.total_sector_performance(m.result)


SPEARMAN = "SELECT Date, CASE WHEN min(Target_Rank) <> max(Target_Rank) AND min(Pred_Rank) <> max(Pred_Rank) THEN corr(Target_Rank, Pred_Rank) END AS SpearmanCorr FROM x_both GROUP BY Date"
CTES["x_both"] = f"""SELECT Date, Sector, {avg_rank('Target')} AS Target_Rank, {avg_rank('Pred')} AS Pred_Rank, count(*) OVER (PARTITION BY Date) AS n FROM x_pred WHERE Target IS NOT NULL AND Pred IS NOT NULL"""


@query("daily_spearman", "K11", SPEARMAN, "SpearmanCorr")
def daily_spearman(m: Market):
    return EV.daily_spearman(m.predictions)


@query("spearman_summary", "K11 D13", describe_sql(f"({SPEARMAN})", ["SpearmanCorr"]), "SpearmanCorr")
def spearman_summary(m: Market):
    return ME.describe(EV.daily_spearman(m.predictions), ["SpearmanCorr"])


CTES["x_shaped"] = f"""SELECT Date, sign(gp) * pow(abs(gp), 1.5) AS gp, sign(gt) * pow(abs(gt), 1.5) AS gt, sign(ct) * pow(abs(ct), 1.5) AS ct FROM (
    SELECT Date, {ppf_sql('pp')} AS gp, {ppf_sql('pt')} AS gt, ct FROM (SELECT Date, (Pred_Rank - 0.5) / n AS pp, (Target_Rank - 0.5) / n AS pt, Target_Rank - avg(Target_Rank) OVER (PARTITION BY Date) AS ct FROM x_both))"""


def _corr(a: str, b: str) -> str:
    return f"CASE WHEN min({a}) <> max({a}) AND min({b}) <> max({b}) THEN corr({a}, {b}) END"


@query("daily_numerai", "K12 K13", f"SELECT Date, {_corr('gp', 'ct')} AS NumeraiCorr, {_corr('gt', 'gp')} AS Rank_NumeraiCorr FROM x_shaped GROUP BY Date", "NumeraiCorr Rank_NumeraiCorr")
def daily_numerai(m: Market):
    return EV.daily_numerai(m.predictions)


@query("recent_summaries", "F6", "SELECT 252 AS Days, Stat, LS FROM (" + describe_sql("(SELECT * FROM x_ls ORDER BY Date DESC LIMIT 252)", ["LS"]) + ") UNION ALL SELECT 63, Stat, LS FROM (" +
       describe_sql("(SELECT * FROM x_ls ORDER BY Date DESC LIMIT 63)", ["LS"]) + ")", "LS")
def recent_summaries(m: Market):
    daily = EV.long_short(m.result)
    parts = [ME.describe(EV.recent(daily, n), ["LS"]).select(F.lit(n).alias("Days"), "Stat", "LS") for n in (252, 63)]
    return parts[0].unionByName(parts[1])


CTES["x_strategies"] = "SELECT Date, 'Long' AS Strategy, Long AS Return FROM x_ls UNION ALL SELECT Date, 'Short', Short FROM x_ls UNION ALL SELECT Date, 'Book', Rate FROM x_daily"


def strategies(m: Market):
    ls = EV.long_short(m.result).unpivot(["Date"], ["Long", "Short"], "Strategy", "Return")
    return ls.unionByName(m.returns.select("Date", F.lit("Book").alias("Strategy"), "Return"))


@query("strategy_blend", "K20 G5", """
    SELECT Date, sum(Return * CASE Strategy WHEN 'Long' THEN 0.67 ELSE 0.33 END) AS Return FROM x_strategies WHERE Strategy IN ('Long', 'Book') GROUP BY Date HAVING count(*) = 2""", "Return")
def strategy_blend(m: Market):
    return EV.blend(strategies(m), {"Long": 0.67, "Book": 0.33})


@query("strategy_correlation", "D21 K20", "SELECT a.Strategy AS A, b.Strategy AS B, corr(a.Return, b.Return) AS Corr FROM x_strategies a JOIN x_strategies b ON a.Date = b.Date GROUP BY 1, 2", "Corr")
def strategy_correlation(m: Market):
    return EV.strategy_correlation(strategies(m), ["Long", "Short", "Book"])


@query("strategy_summaries", "K20 D13", describe_sql("x_strategies", ["Return"], "Strategy", sharpe=True), "Return")
def strategy_summaries(m: Market):
    return ME.describe(strategies(m), ["Return"], by=["Strategy"], with_sharpe=True)


@query("sector_correlation", "D21", "SELECT a.Sector AS A, b.Sector AS B, corr(a.Target, b.Target) AS Corr FROM x_target a JOIN x_target b ON a.Date = b.Date GROUP BY 1, 2", "Corr")
def sector_correlation(m: Market):
    return EV.panel_correlation(reuse(m.target))


CTES["x_returns"] = "SELECT Date, Rate AS Return FROM x_daily"
CTES["x_variants"] = f"""SELECT Date, 'pretax_unlevered' AS Variant, Return FROM x_returns UNION ALL SELECT Date, 'pretax_levered', Return * {LEV} FROM x_returns
    UNION ALL SELECT Date, 'taxed_unlevered', Return * (1 - {TAX}) FROM x_returns UNION ALL SELECT Date, 'taxed_levered', Return * {LEV} * (1 - {TAX}) FROM x_returns"""


@query("return_variants", "B19 B20 B21", "SELECT Date, Variant, Return FROM x_variants", "Return")
def return_variants(m: Market):
    return ME.return_variants(m.returns)


@query("return_variants_from_levered_taxed", "B19 B20 B21", "SELECT Date, Variant, Return FROM x_variants", "Return")
def return_variants_from_levered_taxed(m: Market):
    """The other way round: taxed, levered input gives the same four series."""
    net = S.apply_tax(S.apply_leverage(F.col("Return")))
    return ME.return_variants(m.returns.withColumn("Return", net), tax_excluded=False, leverage_applied=True)


@query("daily_strategy_return", "D7", "SELECT Date, CAST(sum(CASE WHEN Side = '売' THEN -1 ELSE 1 END * (SettleAmount - AcqAmount)) AS DOUBLE) / sum(AcqAmount) AS Return FROM x_ledger GROUP BY Date", "Return")
def daily_strategy_return(m: Market):
    return ME.daily_returns(m.ledger, "Date", "AcqAmount", "SettleAmount", "Side", "売")


BASE = f"""SELECT Variant, avg(Return) AS expected_return, stddev_pop(Return) AS std_return, quantile_cont(Return, 0.5) AS median, avg(CASE WHEN Return > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM x_variants GROUP BY Variant"""
CTES["x_growth"] = f"SELECT *, max(g) OVER (PARTITION BY Variant ORDER BY Date {RUN}) AS peak FROM (SELECT *, product(Return + 1) OVER (PARTITION BY Variant ORDER BY Date {RUN}) AS g FROM x_variants)"
CTES["x_runs"] = f"SELECT Variant, CAST(max(n) AS DOUBLE) AS longest FROM (SELECT Variant, grp, sum(below) AS n FROM (SELECT *, CASE WHEN g < peak THEN 1 ELSE 0 END AS below, sum(CASE WHEN g < peak THEN 0 ELSE 1 END) OVER (PARTITION BY Variant ORDER BY Date {RUN}) AS grp FROM x_growth) GROUP BY 1, 2) GROUP BY Variant"
MU, SD = "expected_return", "std_return"
ANN, ANNSD = f"(pow(1 + {MU}, 252) - 1)", f"({SD} * sqrt(252))"


@query("metric_suite", "K1 K2 K3 K4 K5 K6 K7 K10 B22 D20 E33 E34", f"""
    SELECT b.*, max_drawdown, {MU} / nullif({SD}, 0) AS sharpe_ratio, {SD} * {SD} / {MU} * 9 / 4 AS theoretical_max_drawdown, {ANN} AS annualized_return, {ANNSD} AS annualized_std,
      {ANN} / {ANNSD} AS annualized_sharpe, {ANN} / nullif(max_drawdown, 0) AS calmar_ratio, longest AS longest_drawdown_days,
      (SELECT product(Return + 1) - 1 FROM x_variants WHERE Variant = 'taxed_unlevered') AS total_profit
    FROM ({BASE}) b JOIN (SELECT Variant, max(1 - g / peak) AS max_drawdown FROM x_growth GROUP BY Variant) d ON b.Variant = d.Variant JOIN x_runs r ON b.Variant = r.Variant WHERE b.Variant <> 'taxed_unlevered'""",
       "expected_return std_return median hit_rate max_drawdown sharpe_ratio theoretical_max_drawdown annualized_return annualized_std annualized_sharpe calmar_ratio total_profit")
def metric_suite(m: Market):
    return ME.metric_suite(m.returns)


@query("drawdown_series", "E23 E33", "SELECT Date, g AS Growth, peak AS Peak, 1 - g / peak AS Drawdown FROM x_growth WHERE Variant = 'pretax_unlevered'", "Growth Peak Drawdown")
def drawdown_series(m: Market):
    return ME.add_drawdown(m.returns).select("Date", "Growth", "Peak", "Drawdown")


@query("longest_drawdown", "E34 K5", "SELECT Variant, longest AS longest_drawdown_days FROM x_runs")
def longest_drawdown(m: Market):
    return ME.longest_drawdown(ME.add_drawdown(ME.return_variants(m.returns), ["Variant"]), ["Variant"])


@query("cumulative_return", "K8", f"SELECT Date, product(Return + 1) OVER (ORDER BY Date {RUN}) - 1 AS CumulativeReturn FROM x_returns", "CumulativeReturn")
def cumulative_return(m: Market):
    return ME.cumulative_return(m.returns)


# Stocks trade on some days only, so whole months of a stock can be empty.
CTES["x_sparse"] = "SELECT Code, Date, Close / Open - 1 AS Return FROM x_traded"
STOCK_MONTHS = """SELECT Code, CAST(last_day(CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE)) AS DATE) AS Date FROM (
    SELECT Code, date_trunc('month', min(Date)) AS a, date_trunc('month', max(Date)) AS b FROM x_sparse GROUP BY Code)"""
STOCK_YEARS = """SELECT Code, make_date(CAST(unnest(range(a, b + 1)) AS INTEGER), 12, 31) AS Date FROM (SELECT Code, year(min(Date)) AS a, year(max(Date)) AS b FROM x_sparse GROUP BY Code)"""
MONTHLY = f"""SELECT c.Code, c.Date, coalesce(p, 1) - 1 AS Return FROM ({STOCK_MONTHS}) c LEFT JOIN (SELECT Code, last_day(Date) AS Date, product(Return + 1) AS p FROM x_sparse GROUP BY 1, 2) g ON c.Date = g.Date AND c.Code = g.Code"""
YEARLY = f"""SELECT c.Code, c.Date, coalesce(p, 1) - 1 AS Return FROM ({STOCK_YEARS}) c LEFT JOIN (SELECT Code, year(Date) AS y, product(Return + 1) AS p FROM x_sparse GROUP BY 1, 2) g ON year(c.Date) = g.y AND c.Code = g.Code"""
RUNNING = f"SELECT Code, Date, product(Return + 1) OVER (PARTITION BY Code ORDER BY Date {RUN}) - 1 AS CumulativeReturn FROM "


def sparse(m: Market):
    return m.traded.select("Code", "Date", S.daytime_return(F.col("Open"), F.col("Close")).alias("Return"))


@query("monthly_return", "K9", MONTHLY, "Return")
def monthly_return(m: Market):
    return ME.compound_by_period(sparse(m), by=["Code"])


@query("annual_return", "K9", YEARLY, "Return")
def annual_return(m: Market):
    return ME.compound_by_period(sparse(m), by=["Code"], unit="year")


@query("monthly_cumulative_return", "K9", f"{RUNNING} ({MONTHLY})", "CumulativeReturn")
def monthly_cumulative_return(m: Market):
    return ME.cumulative_by_period(sparse(m), by=["Code"])


@query("annual_cumulative_return", "K9", f"{RUNNING} ({YEARLY})", "CumulativeReturn")
def annual_cumulative_return(m: Market):
    return ME.cumulative_by_period(sparse(m), by=["Code"], unit="year")
