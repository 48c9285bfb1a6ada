"""Return metrics of one or many daily series ``(by.., Date, Return)``.

A daily series has one row per trading day, so its windows are bounded by the
calendar; many strategies or tax variants are evaluated in one job through ``by``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.functions import windows as P

QUARTILES = (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))


def daily_returns(
    trades: DataFrame, date: str = "Date", acquisition: str = "Acquisition", settlement: str = "Settlement",
    side: str = "Side", short_value: str = "Short",
) -> DataFrame:
    """Profit over acquired amount per day, short trades with the sign turned."""
    sign = F.when(F.col(side) == short_value, -1).otherwise(1)
    profit = F.sum((F.col(settlement) - F.col(acquisition)) * sign)
    return trades.groupBy(F.col(date).alias("Date")).agg(F.try_divide(profit, F.sum(acquisition)).alias("Return"))


def return_variants(
    returns: DataFrame, tax_excluded: bool = True, leverage_applied: bool = False,
    tax: float = S.TAX_RATE, leverage: float = S.LEVERAGE_RATIO,
) -> DataFrame:
    """Each return before and after tax, with and without leverage, in long form."""
    base = F.col("Return")
    base = base if tax_excluded else S.remove_tax(base, tax)
    base = S.remove_leverage(base, leverage) if leverage_applied else base
    variants = F.array(
        F.struct(F.lit("pretax_unlevered").alias("Variant"), base.alias("Return")),
        F.struct(F.lit("pretax_levered").alias("Variant"), S.apply_leverage(base, leverage).alias("Return")),
        F.struct(F.lit("taxed_unlevered").alias("Variant"), S.apply_tax(base, tax).alias("Return")),
        F.struct(F.lit("taxed_levered").alias("Variant"), S.apply_tax(S.apply_leverage(base, leverage), tax).alias("Return")),
    )
    keep = [c for c in returns.columns if c != "Return"]
    return returns.select(*keep, F.inline(variants))


def sharpe(mean: Column, std: Column) -> Column:
    return F.when(std != 0, F.try_divide(mean, std))


def theoretical_max_drawdown(mean: Column, std: Column) -> Column:
    return F.try_divide(std * std, mean) * 9 / 4


def theoretical_drawdown_days(mean: Column, std: Column) -> Column:
    return F.bround(F.try_divide(std * std * 9, mean * mean), 0)


BASIC: dict[str, Callable[[], Column]] = {
    "expected_return": lambda: F.avg("Return"),
    "std_return": lambda: F.stddev_pop("Return"),
    "median": lambda: F.percentile("Return", 0.5),
    "hit_rate": lambda: F.avg((F.col("Return") > 0).cast("double")),
}


def register_metric(name: str, column: Callable[[], Column]) -> None:
    """Add an aggregate over ``Return`` to the suite."""
    BASIC[name] = column


def add_drawdown(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Growth factor, its running peak, and the drawdown from it."""
    out = returns.withColumn("Growth", P.cumprod(F.col("Return") + 1, list(by)))
    out = out.withColumn("Peak", P.cummax("Growth", list(by)))
    return out.withColumn("Drawdown", 1 - F.try_divide(F.col("Growth"), F.col("Peak")))


def longest_drawdown(with_drawdown: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Longest run of days below the running peak."""
    by = list(by)
    below = F.col("Growth") < F.col("Peak")
    w = P.ordered(by).rowsBetween(Window.unboundedPreceding, 0)
    runs = with_drawdown.select(*by, below.cast("long").alias("_below"), F.sum((~below).cast("long")).over(w).alias("_run"))
    lengths = runs.groupBy(*by, "_run").agg(F.sum("_below").alias("_n"))
    return lengths.groupBy(*by).agg(F.max("_n").cast("double").alias("longest_drawdown_days"))


def summary(returns: DataFrame, by: Sequence[str] = ("Variant",)) -> DataFrame:
    """The whole aggregate suite, one row per group."""
    by = list(by)
    drawn = add_drawdown(returns, by)
    base = drawn.groupBy(*by).agg(*[f().alias(n) for n, f in BASIC.items()], F.max("Drawdown").alias("max_drawdown"))
    mean, std = F.col("expected_return"), F.col("std_return")
    base = base.withColumns({
        "sharpe_ratio": sharpe(mean, std),
        "theoretical_max_drawdown": theoretical_max_drawdown(mean, std),
        "annualized_return": S.annualise_return(mean),
        "annualized_std": S.annualise_volatility(std),
    })
    base = base.withColumns({
        "annualized_sharpe": sharpe(F.col("annualized_return"), F.col("annualized_std")),
        "calmar_ratio": F.try_divide(F.col("annualized_return"), F.col("max_drawdown")),
    })
    longest = longest_drawdown(drawn, by)
    return base.join(longest, by) if by else base.withColumn("longest_drawdown_days", longest.scalar())


def total_profit(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return returns.groupBy(*by).agg((F.product(F.col("Return") + 1) - 1).alias("total_profit"))


def metric_suite(returns: DataFrame, by: Sequence[str] = (), **variant_args) -> DataFrame:
    """Suite over three tax and leverage variants plus the compounded taxed, unlevered profit."""
    by = list(by)
    long = return_variants(returns, **variant_args)
    shown = long.filter(F.col("Variant") != "taxed_unlevered")
    total = total_profit(long.filter(F.col("Variant") == "taxed_unlevered"), by)
    out = summary(shown, [*by, "Variant"])
    return out.join(total, by) if by else out.withColumn("total_profit", total.scalar())


def cumulative_return(returns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return returns.select(*by, "Date", (P.cumprod(F.col("Return") + 1, list(by)) - 1).alias("CumulativeReturn"))


def periods(df: DataFrame, by: Sequence[str] = (), unit: str = "month") -> DataFrame:
    """Every calendar period between the first and last row of a group, labelled by its last day."""
    span = df.groupBy(*by).agg(F.trunc(F.min("Date"), unit).alias("_a"), F.trunc(F.max("Date"), unit).alias("_b"))
    step = F.expr(f"explode(sequence(_a, _b, interval 1 {unit}))")
    return span.filter("_a is not null").select(*by, step.alias("_start")).select(*by, period_end(F.col("_start"), unit).alias("Date"))


def period_end(date: Column, unit: str = "month") -> Column:
    return F.last_day(date) if unit == "month" else F.make_date(F.year(date), F.lit(12), F.lit(31))


def compound_by_period(returns: DataFrame, columns: Sequence[str] = ("Return",), by: Sequence[str] = (), unit: str = "month") -> DataFrame:
    """Compounded return per month or year; a period without days shows 0."""
    by = list(by)
    grown = returns.groupBy(*by, period_end(F.col("Date"), unit).alias("Date")).agg(
        *[F.product(F.col(c) + 1).alias(c) for c in columns])
    frame = periods(returns, by, unit).join(grown, [*by, "Date"], "left")
    return frame.withColumns({c: F.coalesce(F.col(c), F.lit(1.0)) - 1 for c in columns})


def cumulative_by_period(returns: DataFrame, by: Sequence[str] = (), unit: str = "month") -> DataFrame:
    per = compound_by_period(returns, by=by, unit=unit)
    return per.select(*by, "Date", (P.cumprod(F.col("Return") + 1, list(by)) - 1).alias("CumulativeReturn"))


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), with_sharpe: bool = False) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles as rows ``(by.., Stat, columns..)``."""
    by, columns = list(by), list(columns)
    aggs = []
    for c in columns:
        x = F.col(c)
        aggs += [F.count(x).cast("double").alias(f"{c}#count"), F.avg(x).alias(f"{c}#mean"), F.stddev_samp(x).alias(f"{c}#std"),
                 F.min(x).cast("double").alias(f"{c}#min"), F.max(x).cast("double").alias(f"{c}#max"),
                 F.percentile(x, F.array(*[F.lit(q) for _, q in QUARTILES])).alias(f"{c}#q")]
    wide = df.groupBy(*by).agg(*aggs)
    stats = ["count", "mean", "std", "min", *[n for n, _ in QUARTILES], "max"] + (["SR"] if with_sharpe else [])

    def value(c: str, stat: str) -> Column:
        names = [n for n, _ in QUARTILES]
        if stat in names:
            return F.col(f"{c}#q")[names.index(stat)]
        if stat == "SR":
            return F.try_divide(F.col(f"{c}#mean"), F.col(f"{c}#std"))
        return F.col(f"{c}#{stat}")

    rows = F.array(*[F.struct(F.lit(s).alias("Stat"), *[value(c, s).alias(c) for c in columns]) for s in stats])
    return wide.select(*by, F.inline(rows))
