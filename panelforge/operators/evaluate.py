"""Back-test of predictions: long/short portfolios, probabilities, benchmark, sectors, rank correlations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.functions import windows as P
from panelforge.functions.normal import norm_cdf, norm_ppf
from panelforge.functions.quantiles import quantile_table
from panelforge.functions.stats import correlation
from panelforge.operators import linalg as L
from panelforge.operators import metrics as M
from panelforge.sources.readers import between

KEYS = ["Date", "Sector"]
LEGS = ("Long", "Short", "LS")


def one_day() -> WindowSpec:
    """All sectors of a day; a function, since a window needs a running session."""
    return Window.partitionBy("Date")


def result_panel(
    predictions: DataFrame, raw: DataFrame, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Predictions with ascending daily ranks and the raw target next to them."""
    if start is not None and end is not None:
        predictions, raw = between(predictions, start, end), between(raw, start, end)
    joined = predictions.join(raw.select(*KEYS, F.col("Target").alias("RawTarget")), KEYS, "left")
    return joined.withColumns({
        "Target_Rank": P.rank_avg("Target", "Date"), "Pred_Rank": P.rank_avg("Pred", "Date")})


def benchmark_returns(series: DataFrame, name: str = "TOPIX") -> DataFrame:
    """Daytime and hold return of the control series."""
    rows = series.filter(F.col("Name") == name)
    return rows.select(
        "Date", S.daytime_return(F.col("Open"), F.col("Close")).alias("Control_daytime"),
        P.pct_change("Close", "Name").alias("Control_hold"))


def quantile_bin(x: Column, q: int) -> Column:
    """Zero-based bin of ``x`` among ``q`` equal-frequency bins of its day, edges interpolated."""
    if q <= 1:
        return F.lit(0)
    edges = F.percentile(x, F.array(*[F.lit(i / q) for i in range(1, q)])).over(one_day())
    return F.size(F.filter(edges, lambda e: e < x))


def quantile_bin_returns(result: DataFrame, bins: int) -> DataFrame:
    """Mean raw target per day and predicted bin."""
    full = result.dropna()
    return full.withColumn("Pred_Bin", quantile_bin(F.col("Pred_Rank"), bins)).groupBy("Date", "Pred_Bin").agg(
        F.avg("RawTarget").alias("RawTarget"))


def quantile_bin_matrix(result: DataFrame, bins: int) -> DataFrame:
    means = quantile_bin_returns(result, bins)
    return means.groupBy("Date").pivot("Pred_Bin", list(range(bins))).agg(F.first("RawTarget"))


def quantile_bin_summary(result: DataFrame, bins: int) -> DataFrame:
    return M.describe(quantile_bin_returns(result, bins), ["RawTarget"], by=["Pred_Bin"])


def leg_weights(rank: Column, best: Column, k: int, top_weight: float) -> Column:
    """The best-ranked sector counts ``top_weight``, the other k-1 share the rest."""
    if k <= 1:
        return F.lit(1.0)
    return F.when(rank == best, F.lit(float(top_weight))).otherwise(F.lit(1 - (top_weight - 1) / (k - 1)))


def long_short(result: DataFrame, k: int = 3, top_weight: float = 1.0) -> DataFrame:
    """Daily mean return of the k best and the k worst predicted sectors."""
    ranked = result.withColumns({"_max": F.max("Pred_Rank").over(one_day()), "_min": F.min("Pred_Rank").over(one_day())})
    rank = F.col("Pred_Rank")
    short = F.when(rank <= k, -F.col("RawTarget") * leg_weights(rank, F.col("_min"), k, top_weight))
    long = F.when(rank > F.col("_max") - k, F.col("RawTarget") * leg_weights(rank, F.col("_max"), k, top_weight))
    daily = ranked.groupBy("Date").agg(F.avg(long).alias("Long"), F.avg(short).alias("Short"))
    return daily.withColumn("LS", (F.col("Long") + F.col("Short")) / 2)


def add_track_record(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Compounded legs, drawdown of the long/short leg and days since its peak."""
    by = list(by)
    out = daily.withColumns({
        "L_Cumprod": P.cumprod(F.col("Long") + 1, by) - 1, "S_Cumprod": P.cumprod(F.col("Short") + 1, by) - 1,
        "LS_Cumprod": P.cumprod(F.col("LS") + 1, by) - 1})
    growth = F.col("LS_Cumprod") + 1
    out = out.withColumn("DD", 1 - F.try_divide(growth, P.cummax(growth, by)))
    w = P.ordered(by).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({
        "MaxDD": P.cummax("DD", by), "_peaks": F.sum((F.col("DD") == 0).cast("long")).over(w)})
    out = out.withColumn("DDdays", F.row_number().over(P.ordered([*by, "_peaks"])) - 1)
    return out.withColumn("MaxDDdays", P.cummax("DDdays", by)).select(
        *by, "Date", "LS", "LS_Cumprod", "DD", "MaxDD", "DDdays", "MaxDDdays", "Long", "Short", "L_Cumprod", "S_Cumprod")


def long_short_performance(result: DataFrame, k: int = 3, top_weight: float = 1.0) -> DataFrame:
    return add_track_record(long_short(result, k, top_weight))


def long_short_summary(performance: DataFrame) -> DataFrame:
    return M.describe(performance, LEGS, with_sharpe=True)


def prior_moments(performance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation and degrees of freedom of the days before each day."""
    by = list(by)
    return performance.select(
        *by, "Date", "LS", P.prior(F.avg, "LS", by).alias("CumMean"), P.prior(F.stddev_samp, "LS", by).alias("CumStd"),
        (P.prior(F.count, "LS", by) - 1).alias("DegFreedom")).dropna()


def population_bounds(df: DataFrame, mean: str, std: str, dof: str, confidence: float = 0.997) -> DataFrame:
    """Interval estimates of mean and deviation; the quantiles are computed once per distinct dof."""
    table = quantile_table(df.select(F.col(dof).alias("Dof")), confidence)
    joined = df.join(table.withColumnRenamed("Dof", dof), dof)
    half = F.col("T") * F.sqrt(F.col(std) * F.col(std) / (F.col(dof) + 1))
    spread = F.col(dof) * F.col(std) * F.col(std)
    return joined.withColumns({
        "MeanWorst": F.col(mean) - half, "MeanBest": F.col(mean) + half,
        "StdWorst": F.sqrt(spread / F.col("ChiLow")), "StdBest": F.sqrt(spread / F.col("ChiHigh")),
    }).drop("T", "ChiLow", "ChiHigh")


def _probability(x: str, mean: str, std: str) -> Column:
    return F.round(norm_cdf(F.try_divide(F.col(x) - F.col(mean), F.col(std))), 6)


def daily_probability(performance: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How far down the prior distribution each day's return lies."""
    return prior_moments(performance, by).withColumn("Probability", _probability("LS", "CumMean", "CumStd"))


def daily_probability_bounds(performance: DataFrame, confidence: float = 0.997, by: Sequence[str] = ()) -> DataFrame:
    bounded = population_bounds(daily_probability(performance, by), "CumMean", "CumStd", "DegFreedom", confidence)
    return bounded.select(*by, "Date", "LS", "Probability", _probability("LS", "MeanWorst", "StdWorst").alias("ProbabWorst"),
                          _probability("LS", "MeanBest", "StdBest").alias("ProbabBest"))


def population_estimate(series: DataFrame, column: str, confidence: float = 0.997) -> DataFrame:
    """Sample value, worst and best case of mean, deviation, Sharpe ratio and drawdown."""
    stats = series.agg(F.avg(column).alias("Mean"), F.stddev_samp(column).alias("Std"), (F.count(column) - 1).alias("Dof"))
    b = population_bounds(stats, "Mean", "Std", "Dof", confidence)

    def case(m: str, s: str) -> list[Column]:
        mean, std = F.col(m), F.col(s)
        return [mean, std, F.try_divide(mean, std), M.theoretical_max_drawdown(mean, std), M.theoretical_drawdown_days(mean, std)]

    names = ("mean", "std", "SR", "MaxDD", "MaxDDdays")
    rows = zip(names, case("Mean", "Std"), case("MeanWorst", "StdWorst"), case("MeanBest", "StdBest"), strict=True)
    return b.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("Stat"), s.alias("Sample"), w.alias("Worst"), g.alias("Best")) for n, s, w, g in rows])))


def minus_benchmark(performance: DataFrame, control: DataFrame) -> DataFrame:
    """Long minus, short plus the benchmark's daytime return, compounded again."""
    joined = performance.join(control.select("Date", "Control_daytime"), "Date", "left")
    joined = joined.withColumns({
        "Long": F.col("Long") - F.col("Control_daytime"), "Short": F.col("Short") + F.col("Control_daytime")})
    return joined.withColumns({
        "L_Cumprod": P.cumprod(F.col("Long") + 1, []) - 1, "S_Cumprod": P.cumprod(F.col("Short") + 1, []) - 1,
    }).select(*performance.columns)


def monthly_long_short(performance: DataFrame) -> DataFrame:
    """Compounded months of the three legs and the running long/short total."""
    per = M.compound_by_period(performance, LEGS)
    return per.withColumn("Cumprod", P.cumprod(F.col("LS") + 1, []) - 1)


def traded_sectors(result: DataFrame, k: int = 3) -> DataFrame:
    """Rows on either side of the book, with the side they are on."""
    total = result.select("Sector").agg(F.countDistinct("Sector"))
    rows = result.withColumn("_n", total.scalar())
    side = F.array_compact(F.array(
        F.when(F.col("Pred_Rank") >= F.col("_n") - k + 1, F.lit("Long")), F.when(F.col("Pred_Rank") <= k, F.lit("Short"))))
    return rows.withColumn("Side", F.explode(side)).drop("_n")


def daily_sector_listing(result: DataFrame, k: int = 3) -> DataFrame:
    return traded_sectors(result, k).orderBy("Date", "Pred_Rank", "Sector", "Side")


def monthly_sector_performance(result: DataFrame, k: int = 3) -> DataFrame:
    """Days on each side and compounded growth per month and sector, the last day of each side left out."""
    rows = traded_sectors(result, k)
    last = rows.groupBy("Side").agg(F.max("Date").alias("_last"))
    rows = rows.join(last, "Side").filter(F.col("Date") != F.col("_last"))
    growth = F.when(F.col("Side") == "Long", F.col("RawTarget") + 1).otherwise(F.abs(F.col("RawTarget") - 1))
    rows = rows.withColumn("_g", growth)

    def on(side: str) -> Column:
        return F.col("Side") == side

    return rows.groupBy(F.last_day("Date").alias("Date"), "Sector").agg(
        F.sum(on("Long").cast("long")).cast("double").alias("Long_Num"),
        F.coalesce(F.product(F.when(on("Long"), F.col("_g"))), F.lit(0.0)).alias("Long_Growth"),
        F.sum(on("Short").cast("long")).cast("double").alias("Short_Num"),
        F.coalesce(F.product(F.when(on("Short"), F.col("_g"))), F.lit(0.0)).alias("Short_Growth"))


def total_sector_performance(result: DataFrame, k: int = 3) -> DataFrame:
    """Count, mean, median and deviation of the realised rank per sector and side."""
    rows = traded_sectors(result, k)
    aggs = []
    for side in ("Long", "Short"):
        x = F.when(F.col("Side") == side, F.col("Target_Rank"))
        aggs += [F.count(x).cast("double").alias(f"{side}_num"), F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{side}_mean"),
                 F.coalesce(F.percentile(x, 0.5), F.lit(0.0)).alias(f"{side}_med"),
                 F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"{side}_std")]
    out = rows.groupBy("Sector").agg(*aggs)
    return out.withColumn("Total_num", F.col("Long_num") + F.col("Short_num")).orderBy(F.desc("Total_num"), "Sector")


def daily_spearman(result: DataFrame) -> DataFrame:
    both = result.filter(F.col("Target").isNotNull() & F.col("Pred").isNotNull())
    both = both.select("Date", P.rank_avg("Target", "Date").alias("_t"), P.rank_avg("Pred", "Date").alias("_p"))
    return both.groupBy("Date").agg(correlation(F.col("_t"), F.col("_p")).alias("SpearmanCorr"))


def daily_numerai(result: DataFrame) -> DataFrame:
    """Tail-weighted correlation: gaussianised prediction ranks against centred and against gaussianised target ranks."""
    both = result.filter(F.col("Target").isNotNull() & F.col("Pred").isNotNull())
    both = both.select("Date", P.rank_avg("Target", "Date").alias("_t"), P.rank_avg("Pred", "Date").alias("_p"))
    n = F.count(F.lit(1)).over(one_day())
    gauss = lambda r: S.signed_power(norm_ppf((F.col(r) - 0.5) / n), 1.5)
    shaped = both.select(
        "Date", gauss("_p").alias("_gp"), gauss("_t").alias("_gt"),
        S.signed_power(F.col("_t") - F.avg("_t").over(one_day()), 1.5).alias("_ct"))
    return shaped.groupBy("Date").agg(
        correlation(F.col("_gp"), F.col("_ct")).alias("NumeraiCorr"),
        correlation(F.col("_gt"), F.col("_gp")).alias("Rank_NumeraiCorr"))


def recent(daily: DataFrame, days: int) -> DataFrame:
    """The last ``days`` rows of a daily table."""
    return daily.orderBy(F.desc("Date")).limit(days)


def blend(strategies: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted daily sum of named strategies ``(Strategy, Date, Return)`` on their common days."""
    w = F.element_at(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv]), F.col("Strategy"))
    rows = strategies.filter(F.col("Strategy").isin(*weights))
    out = rows.groupBy("Date").agg(F.sum(F.col("Return") * w).alias("Return"), F.countDistinct("Strategy").alias("_n"))
    return out.filter(F.col("_n") == len(weights)).drop("_n")


def strategy_correlation(strategies: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pairwise correlations of a known list of strategies, one wide pass."""
    wide = strategies.groupBy("Date").pivot("Strategy", list(names)).agg(F.first("Return"))
    return correlation_table(wide, names)


def correlation_table(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """Long correlation matrix of numeric columns over the rows that have both values; null where a side does not vary."""
    rho = L.pairwise_correlations(wide, list(names))
    cells = [(a, b, float(rho[i, j]) if np.isfinite(rho[i, j]) else None) for i, a in enumerate(names) for j, b in enumerate(names)]
    return wide.sparkSession.createDataFrame(cells, "A string, B string, Corr double")


def panel_correlation(panel: DataFrame, value: str = "Target", item: str = "Sector") -> DataFrame:
    """Pairwise-complete correlation matrix of a long (Date, item, value) panel.

    Each day becomes one array of presence marks, values and squares in item order;
    their summed cross-products hold every pair's count, sums and squares, so no day's
    pairs are listed and only a matrix of three times the number of items is collected.
    """
    levels = panel.groupBy(item).agg(F.avg(value).alias("m")).orderBy(item).limit(L.MAX_DIM + 1).collect()
    names = [r[0] for r in levels]
    k = len(names)
    L.check_dim(3 * k)
    level = {r[0]: float(r["m"] or 0.0) for r in levels}
    lookup = lambda d: F.element_at(F.create_map(*[F.lit(v) for kv in d.items() for v in kv]), F.col(item))
    rows = panel.filter(F.col(value).isNotNull()).select(
        "Date", lookup({n: i for i, n in enumerate(names)}).alias("_i"), (F.col(value) - lookup(level)).alias("_v"))
    days = rows.groupBy("Date").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_v"))).alias("_m"))
    x = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.try_element_at("_m", i))
    days = days.select(x.alias("_x")).select(F.concat(
        F.transform("_x", lambda v: v.isNotNull().cast("double")), F.transform("_x", lambda v: F.coalesce(v, F.lit(0.0))),
        F.transform("_x", lambda v: F.coalesce(v * v, F.lit(0.0)))).alias("_z"))
    g = L.to_matrix(L.gram(days, "_z", 3 * k).toPandas(), 3 * k)
    n, sx, sxy, sxx = g[:k, :k], g[k:2 * k, :k], g[k:2 * k, k:2 * k], g[2 * k:, :k]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = sxy / n - (sx / n) * (sx.T / n)
        var = sxx / n - (sx / n) ** 2
        corr = cov / np.sqrt(var * var.T)
    cells = [(names[i], names[j], float(corr[i, j]) if np.isfinite(corr[i, j]) else None) for i in range(k) for j in range(k)]
    return panel.sparkSession.createDataFrame(cells, "A string, B string, Corr double")
