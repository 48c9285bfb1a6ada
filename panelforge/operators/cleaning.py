"""Cleaning of raw price, fundamentals and listing tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import scalar as S
from panelforge.functions import windows as P
from panelforge.sources.upserts import keep_one, total_order

PRICE_OUT = ("Date", "Code", "Open", "High", "Low", "Close", "Volume", "AdjustmentFactor",
             "CumulativeAdjustmentFactor", "TurnoverValue")
# Splits missing from the vendor's factors, (code, before this day, rate).
MANUAL_SPLITS = (("1333", "2014-04-01", 10.0), ("5021", "2015-10-01", 10.0))
# Mergers, (new code, surviving code, absorbed code, merger day, exchange rate).
MERGERS = (("7167", "7167", "8333", "2016-12-19", 1.17),)


def rename_and_cast(df: DataFrame, spec: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Select ``(raw name, clean name, type)`` triples; ``date`` means day grain."""
    def one(raw: str, name: str, kind: str):
        c = F.col(raw)
        return (S.day(c) if kind == "date" else c.try_cast(kind)).alias(name)
    return df.select(*[one(*s) for s in spec])


def clean_listing(raw: DataFrame) -> DataFrame:
    """Individual stocks only, typed and distinct."""
    return (
        raw.filter(F.col("Sector33CodeName") != S.FUND_CATEGORY)
        .withColumn("Code", S.normalise_code(F.col("Code").cast("string")))
        .withColumn("Listing", F.col("Listing").cast("long"))
        .distinct()
    )


def drop_outage_day(df: DataFrame, outage: str = S.OUTAGE_DAY) -> DataFrame:
    return df.filter(F.col("Date") != F.lit(outage).cast("date"))


def fill_suspensions(price: DataFrame, codes: Sequence[str] | DataFrame, max_missing: int = 5) -> DataFrame:
    """Add rows for market days a renamed code missed, when it missed at most ``max_missing``.

    The missing days are found per gap: a row is expanded over the market days up
    to the code's next row, so only codes of the list are touched and nothing is
    multiplied with the calendar.  Days before the first row have no earlier close
    and are left out.
    """
    if not isinstance(codes, DataFrame):
        codes = price.sparkSession.createDataFrame([(c,) for c in codes], "Code string")
    renamed = price.join(codes.select("Code").distinct(), "Code", "left_semi")
    days = price.select("Date").distinct()
    span = days.agg(F.max("Date").alias("_end"), F.count(F.lit(1)).alias("_n"))
    present = renamed.groupBy("Code").agg(F.countDistinct("Date").alias("_have"))
    eligible = (
        present.withColumn("_n", span.select("_n").scalar())
        .filter(F.col("_n") - F.col("_have") <= max_missing).select("Code")
    )
    last_close = renamed.join(eligible, "Code", "left_semi").groupBy("Code", "Date").agg(F.max("Close").alias("Close"))
    until_next = F.coalesce(P.shift("Date", -1, "Code"), F.date_add(F.col("_end"), 1))
    gaps = (
        last_close.withColumn("_end", span.select("_end").scalar())
        .withColumn("_next", until_next)
        .filter(F.datediff("_next", "Date") > 1)
        .select("Code", "Close", F.explode(F.expr("sequence(date_add(Date, 1), date_sub(_next, 1), interval 1 day)")).alias("Date"))
        .join(days, "Date", "left_semi")
    )
    zero, one = F.lit(0.0), F.lit(1.0)
    filled = gaps.select(
        "Date", "Code", F.col("Close").alias("Open"), F.col("Close").alias("High"), F.col("Close").alias("Low"),
        "Close", zero.alias("Volume"), zero.alias("TurnoverValue"), one.alias("AdjustmentFactor"),
    )
    return price.unionByName(filled, allowMissingColumns=True)


def add_cumulative_adjustment(price: DataFrame, manual: Sequence[tuple[str, str, float]] = MANUAL_SPLITS) -> DataFrame:
    """Product of the split factors after each row, times the manual splits still ahead of it."""
    factor = P.product_after("AdjustmentFactor", "Code")
    for code, before, rate in manual:
        hit = (F.col("Code") == code) & (F.col("Date") < F.lit(before).cast("date"))
        factor = factor * F.when(hit, F.lit(float(rate))).otherwise(1.0)
    return price.withColumn("CumulativeAdjustmentFactor", factor)


def add_manual_adjustment(price: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Table-driven manual splits: ``adjustments(Code, Before, Rate)``.

    The adjustments are folded into (Code, sorted list) first, so the price rows
    are joined on Code once and never multiplied.
    """
    folded = adjustments.groupBy("Code").agg(F.collect_list(F.struct("Before", "Rate")).alias("_adj"))
    rate = F.aggregate(
        "_adj", F.lit(1.0), lambda acc, a: acc * F.when(F.col("Date") < a["Before"], a["Rate"]).otherwise(1.0)
    )
    return (
        price.join(folded, "Code", "left")
        .withColumn("CumulativeAdjustmentFactor", F.col("CumulativeAdjustmentFactor") * F.coalesce(rate, F.lit(1.0)))
        .drop("_adj")
    )


def apply_adjustment(price: DataFrame, columns: Sequence[str] = ("Open", "High", "Low", "Close", "Volume")) -> DataFrame:
    """Scale prices, and volume as the stored convention has it, by the cumulative factor."""
    return price.withColumns({c: F.col(c) * F.col("CumulativeAdjustmentFactor") for c in columns})


def clean_prices(
    raw: DataFrame, replacements: Mapping[str, str] = S.CODE_REPLACEMENTS,
    manual: Sequence[tuple[str, str, float]] = MANUAL_SPLITS,
) -> DataFrame:
    """Raw quotes to the adjusted price panel."""
    code = S.replace_code(S.normalise_code(F.col("Code").cast("string")), replacements)
    price = raw.withColumn("Code", code).withColumn("Date", S.day(F.col("Date"))).filter(F.col("Code").isNotNull())
    price = drop_outage_day(fill_suspensions(price, sorted(set(replacements.values()))))
    price = keep_one(price, ["Date", "Code"], total_order(price, skip=("Date", "Code")))
    return apply_adjustment(add_cumulative_adjustment(price, manual)).select(*PRICE_OUT)


def latest_disclosure(fin: DataFrame) -> DataFrame:
    """Forecast revisions out; the day's last disclosure of a code stays."""
    full = fin.filter(S.is_full_disclosure(F.col("TypeOfDocument")))
    order = [F.col("DisclosedTime").desc_nulls_last(), *total_order(full, skip=("Code", "Date", "DisclosedTime"))]
    return keep_one(full, ["Code", "Date"], order)


def add_fundamental_columns(fin: DataFrame) -> DataFrame:
    return fin.withColumns({
        "ForecastEPS": S.forecast_eps(F.col("ForecastEarningsPerShare"), F.col("NextYearForecastEarningsPerShare")),
        "OutstandingShares": S.outstanding_shares(F.col("IssuedShares"), F.col("TreasuryShares")),
        "CurrentFiscalYear": S.fiscal_year(F.col("CurrentFiscalYearEndDate")),
        "ForecastFiscalYearEndDate": S.forecast_year_end(
            F.col("CurrentFiscalYearEndDate"), F.col("TypeOfCurrentPeriod")),
    })


def synthesise_mergers(
    fin: DataFrame, mergers: DataFrame | Sequence[tuple], add_columns: Sequence[str] = ("IssuedShares", "TreasuryShares"),
    shares_col: str = "OutstandingShares",
) -> DataFrame:
    """Combine the disclosures of two companies up to their merger day.

    Both companies are put on the union of their disclosure days, holes are filled
    forward then backward inside each company, shares add up at the exchange rate
    and ``add_columns`` add up plainly.  Rows after the merger day pass through.
    """
    spark = fin.sparkSession
    if not isinstance(mergers, DataFrame):
        mergers = spark.createDataFrame(
            list(mergers), "NewCode string, Code1 string, Code2 string, MergerDay string, ExchangeRate double")
    mergers = mergers.withColumn("MergerDay", F.col("MergerDay").cast("date"))
    sides = mergers.select("NewCode", "MergerDay", "ExchangeRate", F.col("Code1").alias("Code"), F.lit(1).alias("_side")).unionByName(
        mergers.select("NewCode", "MergerDay", "ExchangeRate", F.col("Code2").alias("Code"), F.lit(2).alias("_side")))
    untouched = fin.join(sides.select("Code"), "Code", "left_anti")
    involved = fin.join(sides, "Code")
    after = involved.filter((F.col("_side") == 1) & (F.col("Date") > F.col("MergerDay"))).select(*fin.columns)
    before = involved.filter((F.col("_side") == 2) | (F.col("Date") <= F.col("MergerDay")))
    values = [c for c in fin.columns if c not in ("Date", "Code")]
    days = before.select("NewCode", "Date").distinct()
    both_sides = mergers.select("NewCode", "ExchangeRate", F.explode(F.array(F.lit(1), F.lit(2))).alias("_side"))
    frame = days.join(both_sides, "NewCode")
    grid = frame.join(before.select("NewCode", "Date", "_side", *values), ["NewCode", "Date", "_side"], "left")
    key = ["NewCode", "_side"]
    grid = grid.select("NewCode", "Date", "_side", "ExchangeRate", *[P.fill_both(c, key).alias(c) for c in values])

    def side(c: str, n: int):
        return F.max(F.when(F.col("_side") == n, F.col(c)))

    def combined(c: str):
        if c == shares_col:
            return side(c, 1) + side(c, 2) * F.max("ExchangeRate")
        return side(c, 1) + side(c, 2) if c in add_columns else side(c, 1)

    merged = grid.groupBy("NewCode", "Date").agg(*[combined(c).alias(c) for c in values])
    merged = merged.withColumnRenamed("NewCode", "Code").select(*fin.columns)
    return untouched.select(*fin.columns).unionByName(merged).unionByName(after)


def clean_fundamentals(
    raw: DataFrame, mergers: DataFrame | Sequence[tuple] = MERGERS, replacements: Mapping[str, str] = S.CODE_REPLACEMENTS,
) -> DataFrame:
    """Raw disclosures (text, blanks as missing) to the fundamentals panel."""
    text = raw.select(*[S.blank_to_null(F.col(c).cast("string")).alias(c) for c in raw.columns])
    dates = ("Date", "CurrentPeriodEndDate", "CurrentFiscalYearEndDate")
    numbers = ("IssuedShares", "TreasuryShares", "ForecastEarningsPerShare", "NextYearForecastEarningsPerShare")
    typed = text.withColumns({
        **{c: S.day(F.col(c)) for c in dates}, **{c: F.col(c).try_cast("double") for c in numbers},
        "Code": S.replace_code(S.normalise_code(F.col("Code")), replacements),
    })
    fin = add_fundamental_columns(latest_disclosure(typed))
    if isinstance(mergers, DataFrame) or mergers:
        fin = synthesise_mergers(fin, mergers)
    return fin.drop("DisclosedTime").distinct()
