"""Hand-computed fixtures for the panel helpers and metrics."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import normal as N
from panelforge.functions import quantiles as QT
from panelforge.functions import scalar as S
from panelforge.functions import windows as P
from panelforge.operators import cleaning as C
from panelforge.operators import ensemble as EN
from panelforge.operators import evaluate as EV
from panelforge.operators import features as FE
from panelforge.operators import metrics as ME
from panelforge.operators import trades as TR


def column(df, name, order="Date"):
    return [r[name] for r in df.orderBy(order).collect()]


def series(spark, values, key="a", start=dt.date(2020, 1, 1)):
    rows = [(key, start + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, Date date, x double")


def test_split_factor_is_the_product_of_later_factors(spark, days):
    df = spark.createDataFrame([("1", days(i + 1), f) for i, f in enumerate((1.0, 1.0, 0.5, 1.0))], "Code string, Date date, AdjustmentFactor double")
    assert column(C.add_cumulative_adjustment(df), "CumulativeAdjustmentFactor") == [0.5, 0.5, 1.0, 1.0]


def test_average_rank_with_tie_and_null(spark, days):
    df = spark.createDataFrame([(days(1), v, i) for i, v in enumerate((3.0, 3.0, 1.0, None))], "Date date, x double, i int")
    assert column(df.withColumn("r", P.rank_avg("x", "Date", ascending=False)), "r", "i") == [1.5, 1.5, 3.0, None]


def test_momentum_needs_four_returns_and_a_lag(spark):
    df = series(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]).withColumnRenamed("k", "Sector").withColumnRenamed("x", "1d_return")
    got = column(FE.momentum(df, [5]), "5d_mom")
    assert got[:4] == [None] * 4 and got[4] == pytest.approx(0.25) and got[5] == pytest.approx(0.35)


def test_fills_and_products_skip_nulls(spark):
    df = series(spark, [None, 2.0, None, 3.0, None])
    out = df.select("Date", P.ffill("x", "k").alias("f"), P.bfill("x", "k").alias("b"), P.cumprod("x", "k").alias("p"), P.product_from_here("x", "k").alias("h"))
    assert column(out, "f") == [None, 2, 2, 3, 3] and column(out, "b") == [2, 2, 3, 3, None]
    assert column(out, "p") == [None, 2, None, 6, None] and column(out, "h") == [6, 6, 3, 3, None]


def test_month_without_rows_returns_zero(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 5), 0.1), (dt.date(2020, 1, 6), 0.1), (dt.date(2020, 3, 2), -0.5)], "Date date, Return double")
    out = ME.compound_by_period(df).orderBy("Date").collect()
    assert [r["Date"] for r in out] == [dt.date(2020, 1, 31), dt.date(2020, 2, 29), dt.date(2020, 3, 31)]
    assert [r["Return"] for r in out] == pytest.approx([0.21, 0.0, -0.5])


def test_drawdown_and_longest_run(spark):
    df = series(spark, [0.1, -0.5, 0.2, 1.0]).select("Date", F.col("x").alias("Return"))
    drawn = ME.add_drawdown(df)
    assert column(drawn, "Growth") == pytest.approx([1.1, 0.55, 0.66, 1.32])
    assert max(column(drawn, "Drawdown")) == pytest.approx(0.5)
    assert ME.longest_drawdown(drawn).first()[0] == 2.0


def test_tax_follows_the_year_to_date_profit(spark, days):
    rows = [(days(i + 1), 1000, p) for i, p in enumerate((1000, -500, 800))]
    out = TR.daily_profit(spark.createDataFrame(rows, "Date date, AcqAmount long, Profit long"))
    assert column(out, "DayTax") == [203, -102, 163]


def test_vote_gives_points_to_the_first_places(spark, days):
    def model(preds):
        return spark.createDataFrame([(days(1), s, p) for s, p in zip("abc", preds, strict=True)], "Date date, Sector string, Pred double")
    out = EN.by_vote([(model((3.0, 2.0, 1.0)), 0.5), (model((2.0, 3.0, 1.0)), 0.5)], top_n=2)
    assert column(out, "Pred", "Sector") == [1.5, 1.5, 0.0]


def test_ensemble_refuses_bad_inputs(spark, days):
    df = spark.createDataFrame([(days(1), "a", 1.0)], "Date date, Sector string, Pred double")
    with pytest.raises(ValueError):
        EN.by_value([(df, 0.0)])
    with pytest.raises(ValueError):
        EN.ensemble("nobody", [(df, 1.0)])
    with pytest.raises(ValueError):
        EN.check_keys([(df, 1.0), (df.filter("false"), 1.0)])


def test_normal_functions_match_the_standard_library(spark):
    zs = [-8.0, -3.3, -1.0, -0.2, 0.0, 0.7, 2.5, 6.0, 7.5]
    ps = [1e-9, 0.001, 0.07, 0.3, 0.5, 0.62, 0.93, 0.9999, 1 - 1e-9]
    rows = spark.createDataFrame(list(zip(zs, ps, strict=True)), "z double, p double").select(N.norm_cdf(F.col("z")).alias("c"), N.norm_ppf(F.col("p")).alias("q")).collect()
    for z, p, r in zip(zs, ps, rows, strict=True):
        assert r["c"] == pytest.approx(NormalDist().cdf(z), abs=1e-13)
        assert r["q"] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-9, abs=1e-12)


def test_quantiles_match_printed_tables():
    assert QT.t_ppf(0.975, np.array([1, 10, 30])) == pytest.approx([12.7062, 2.228139, 2.042272], abs=1e-4)
    assert QT.chi2_ppf(0.025, np.array([10.0]))[0] == pytest.approx(3.246973, abs=1e-5)
    assert QT.chi2_ppf(0.95, np.array([1.0, 100.0])) == pytest.approx([3.841459, 124.342113], abs=1e-4)
    assert QT.t_ppf(0.975, np.array([1e6]))[0] == pytest.approx(NormalDist().inv_cdf(0.975), abs=1e-4)


def test_population_estimate_brackets_the_sample(spark):
    df = series(spark, [0.01, -0.02, 0.03, 0.015, 0.0, 0.02, -0.01, 0.01]).select("Date", "x")
    out = {r["Stat"]: r for r in EV.population_estimate(df, "x").collect()}
    assert out["mean"]["Worst"] < out["mean"]["Sample"] < out["mean"]["Best"]
    assert out["std"]["Worst"] > out["std"]["Sample"] > out["std"]["Best"]


def test_price_rules(spark):
    rows = spark.createDataFrame([(99.0,), (100.0,), (3000.0,), (4999.0,), (6e7,), (None,)], "p double")
    out = rows.select(S.price_limit(F.col("p")).alias("l"), S.short_sale_limit_price(F.col("p")).alias("s"), S.lower_limit(F.col("p")).alias("low")).collect()
    assert [r["l"] for r in out] == [30, 50, 700, 700, 10000000, None]
    assert [r["s"] for r in out][:4] == [90, 91, 2715, 4525]
    assert out[0]["low"] == 69.0


def test_code_rules(spark):
    rows = spark.createDataFrame([("13010",), ("1301",), ("13015",), ("13340",)], "c string")
    out = [r[0] for r in rows.select(S.replace_code(S.normalise_code(F.col("c")))).collect()]
    assert out == ["1301", "1301", "13015", "1333"]


def test_long_short_overweight_and_drawdown_days(spark, days):
    rows = [(days(d), f"s{i}", float(i), float(i), 0.01 * i) for d in (1, 2) for i in range(1, 7)]
    df = spark.createDataFrame(rows, "Date date, Sector string, Pred_Rank double, Target_Rank double, RawTarget double")
    plain = EV.long_short(df, 2).orderBy("Date").first()
    assert plain["Long"] == pytest.approx(0.055) and plain["Short"] == pytest.approx(-0.015)
    heavy = EV.long_short(df, 2, 1.5).orderBy("Date").first()
    assert heavy["Long"] == pytest.approx((0.06 * 1.5 + 0.05 * 0.5) / 2) and heavy["Short"] == pytest.approx(-(0.01 * 1.5 + 0.02 * 0.5) / 2)


def test_spearman_is_bounded_and_exact(spark, days):
    df = spark.createDataFrame([(days(1), float(i), float(-i)) for i in range(5)] + [(days(2), float(i), 1.0) for i in range(3)], "Date date, Target double, Pred double")
    assert column(EV.daily_spearman(df), "SpearmanCorr") == [pytest.approx(-1.0), None]


def test_rounding_is_half_even_where_the_rule_says_so(spark):
    row = spark.sql("select 1.25D as a, 1.35D as b").select(F.bround("a", 1), F.bround("b", 1)).first()
    assert row[0] == 1.2 and math.isclose(row[1], 1.4)
