"""Operators without a SQL statement, against brute force on small fixtures."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import cleaning as C
from panelforge.operators import clustering as CL
from panelforge.operators import linalg as L
from panelforge.operators import models as MO
from panelforge.operators import portfolio as PO
from panelforge.operators import preprocess as PP
from panelforge.operators import sector_index as SI
from panelforge.operators import trades as TR
from panelforge.sources import files as IO
from panelforge.sources import upserts as U
from panelforge.sources.bundle import DatasetBundle

DAY = dt.date(2020, 1, 6)


def greedy(stocks, budget):
    """Lot sizing of one sector, straight from the rules."""
    out = []
    for code, weight, cost, limit in sorted(stocks, key=lambda s: (-s[1], s[0])):
        ideal = float(int(weight * budget))
        below = ideal // cost * cost
        rate = abs(ideal - below) / abs(ideal - below - cost)
        unit = (below if rate <= 1 else below + cost) / cost
        out.append({"code": code, "cost": cost, "ideal": ideal, "rate": rate, "unit": min(unit, limit), "full": unit >= limit, "limit": limit, "w": weight})
    for s in sorted((s for s in out if s["rate"] >= 1 and s["unit"] > 0), key=lambda s: (-s["rate"], -s["w"], s["code"])):
        if sum(x["unit"] * x["cost"] for x in out) <= budget:
            break
        s["unit"] -= 1
    while True:
        free = budget - sum(x["unit"] * x["cost"] for x in out)
        fit = [s for s in out if s["cost"] <= free and not s["full"]]
        if not fit:
            break
        s = min(fit, key=lambda s: s["rate"])
        s["unit"] += 1
        s["rate"] = abs(s["ideal"] - s["unit"] * s["cost"]) / abs(s["ideal"] - (s["unit"] + 1) * s["cost"])
        s["full"] = s["unit"] >= s["limit"]
    return {s["code"]: int(s["unit"]) for s in out if s["unit"] > 0}


def test_order_sizing_equals_the_step_by_step_rules(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for sector, margin in zip("ABCDEF", (1, 1, 1, 1, 1, 1), strict=True):
        raw = [rng.random() for _ in range(7)]
        stocks = [(f"{sector}{i}", w / sum(raw), float(rng.randrange(150, 2500) * 100), rng.choice((1, 2, 1000))) for i, w in enumerate(raw)]
        expected[sector] = greedy(stocks, 1_000_003.0)
        rows += [(DAY, "Long", sector, c, c, w, k, m, False) for c, w, k, m in stocks]
    weights = spark.createDataFrame(rows, "Date date, Direction string, Sector string, Code string, CompanyName string, Weight double, EstimatedCost double, MaxUnit long, isBorrowingStock boolean")
    budgets = weights.select("Date", "Direction", "Sector").distinct().withColumn("MaxCost", F.lit(1_000_003.0))
    got = PO.size_orders(weights, budgets).collect()
    for sector in expected:
        assert {r["Code"]: r["Unit"] for r in got if r["Sector"] == sector} == expected[sector]
        assert sum(r["TotalCost"] for r in got if r["Sector"] == sector) <= 1_000_003.0 or len(expected[sector]) == 0


def test_admission_walks_the_day_in_order(spark):
    rows = [(DAY, c, "Long", need, float(i)) for i, (c, need) in enumerate((("a", 60.0), ("b", 50.0), ("c", 40.0), ("d", 200.0), ("e", 1.0)))]
    orders = spark.createDataFrame(rows, "Date date, Code string, Direction string, UpperLimitTotal double, CumCost_byLS double")
    standing = spark.createDataFrame([(DAY, "e")], "Date date, Code string")
    got = {r["Code"]: r["Status"] for r in PO.admit_orders(orders, 100.0, standing).collect()}
    assert got == {"a": "accepted", "b": "refused", "c": "accepted", "d": "refused", "e": "already ordered"}


def test_netting_drops_codes_that_cancel(spark):
    rows = [(DAY, "a", "1", "Long", 5, 10.0, 13.0, True), (DAY, "a", "2", "Short", 2, 11.0, 14.0, False),
            (DAY, "b", "1", "Short", 3, 10.0, 13.0, False), (DAY, "b", "2", "Long", 3, 10.0, 13.0, False), (DAY, "c", "2", "Short", 4, 1.0, 2.0, True)]
    orders = spark.createDataFrame(rows, "Date date, Code string, Model string, Direction string, Unit int, EstimatedCost double, UpperLimitCost double, isBorrowingStock boolean")
    orders = orders.withColumns({"CompanyName": F.col("Code"), "Sector": F.lit("s")})
    got = {r["Code"]: (r["Direction"], r["Unit"], r["TotalCost"], r["UpperLimitTotal"]) for r in PO.net_orders(orders).collect()}
    assert got == {"a": ("Long", 3, 30.0, 39.0), "c": ("Short", 4, 4.0, 8.0)}


def test_margin_weights_fall_back_to_equal(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "Model string, margin_weight double")
    assert [r["margin_weight"] for r in PO.normalise_margin_weights(df).collect()] == [0.5, 0.5]


def test_lasso_satisfies_the_optimality_conditions(spark):
    rng = np.random.default_rng(3)
    n, k = 300, 6
    x = rng.normal(size=(n, k)) * [1, 5, 0.1, 2, 1, 3] + 10
    y = 0.02 * x[:, 0] - 0.001 * x[:, 3] + rng.normal(size=n) * 0.01
    cols = [f"f{i}" for i in range(k)]
    rows = [(DAY + dt.timedelta(days=i), "s", float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "Date date, Sector string, Target double, " + ", ".join(f"{c} double" for c in cols))
    row = MO.fit_lasso(df.select("Date", "Sector", "Target"), df.drop("Target"), cols, alpha=0.002).first()
    z = (x - x.mean(0)) / x.std(0)
    w = np.array(row["Coef"])
    grad = z.T @ (y - y.mean() - z @ w) / n
    assert row["Mean"] == pytest.approx(list(x.mean(0))) and row["Scale"] == pytest.approx(list(x.std(0)))
    assert np.all(np.abs(grad) <= 0.002 + 1e-7)
    assert np.allclose(grad[w != 0], 0.002 * np.sign(w[w != 0]), atol=1e-7)
    searched = MO.fit_lasso(df.select("Date", "Sector", "Target"), df.drop("Target"), cols, min_features=3, max_features=5).first()
    assert 3 <= sum(v != 0 for v in searched["Coef"]) <= 5
    assert row["Status"] == searched["Status"] == "ok"
    beyond = MO.fit_lasso(df.select("Date", "Sector", "Target"), df.drop("Target"), cols, min_features=0, max_features=0).first()
    assert beyond["Status"] == "features out of range"


def test_pca_residuals_are_orthogonal_to_the_component_over_the_fit_range(spark):
    """Five sectors with one market factor, the shape of the usual demonstration."""
    rng = np.random.default_rng(42)
    load = np.linspace(0.3, 0.7, 5)
    m = rng.normal(0, 0.02, 200)
    x = m[:, None] * load + rng.normal(0, 0.01, (200, 5))
    rows = [(DAY + dt.timedelta(days=i), f"s{j}", float(x[i, j])) for i in range(200) for j in range(5)]
    df = spark.createDataFrame(rows, "Date date, Sector string, Target double")
    model = PP.PanelPca(1, end=str(DAY + dt.timedelta(days=149))).fit(df)
    got = np.array([[r["Target"]] for r in model.residuals(df).orderBy("Date", "Sector").collect()]).reshape(200, 5)
    mu = x[:150].mean(0)
    v = np.linalg.svd(x[:150] - mu)[2][0]
    assert np.allclose(got, (x - mu) - np.outer((x - mu) @ v, v), atol=1e-10)
    assert abs((got[:150] @ model.axes[0]).sum()) < 1e-10
    with pytest.raises(ValueError):
        PP.PanelPca(1, start="1990-01-01", end="1990-12-31").fit(df)


@pytest.mark.parametrize("block", [3, 1000])
def test_pairs_within_equals_all_pairs(spark, block):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(40, 3))
    pts[10:20, 0] = 0.5
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, vector array<double>")
    got = {(r["a"], r["b"]) for r in CL.pairs_within(df, 1.0, block_rows=block).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(40), 2) if np.linalg.norm(pts[i] - pts[j]) <= 1.0}
    assert got == want


def test_connected_groups_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, j) for j in range(101, 140)] + [(200, 201), (202, 201)]
    nodes = spark.createDataFrame([(i,) for i in [*range(31), *range(100, 140), 200, 201, 202, 300]], "id long")
    got = {r["id"]: r["group"] for r in CL.connected_groups(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in range(100, 140))
    assert got[202] == 200 and got[300] == 300


def test_agreement_counts_equal_labels(spark):
    labels = [("r1", "a", 1), ("r1", "b", 1), ("r1", "c", 2), ("r2", "a", 1), ("r2", "b", 2)]
    df = spark.createDataFrame(labels, "Run string, Item string, Label long")
    got = {(r["A"], r["B"]): r["Agreement"] for r in CL.agreement_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == 1 and got[("a", "a")] == 2 and got[("c", "c")] == 1 and got[("a", "c")] == 0


def test_csv_with_free_text_in_front(spark, tmp_path):
    body = "一般信用売り銘柄一覧\r\n2020/01/06,作成\r\n\r\nコード,銘柄,売建受注枠\r\n1301,極洋,○\r\n1332,日水,受付不可\r\n"
    (tmp_path / "list.csv").write_bytes(body.encode("shift_jis"))
    out = IO.read_csv_after_marker(spark, str(tmp_path), ["Code", "Name", "Quota"], "コード")
    assert sorted(tuple(r) for r in out.collect()) == [("1301", "極洋", "○"), ("1332", "日水", "受付不可")]


def test_csv_drops_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("﻿Name,Group\nTOPIX,index\n".encode())
    assert IO.read_csv(spark, str(tmp_path / "f.csv")).columns == ["Name", "Group"]


def test_series_upsert_coerces_and_drops_empty(spark):
    old = spark.createDataFrame([("a", DAY, "1,000"), ("a", DAY + dt.timedelta(days=1), "2")], "Name string, Date date, Close string")
    new = spark.createDataFrame([("a", DAY + dt.timedelta(days=1), "3,500"), ("a", DAY + dt.timedelta(days=2), None)], "Name string, Date date, Close string")
    out = U.upsert_series(old, new).withColumn("Empty", F.lit(None).cast("double"))
    assert [r["Close"] for r in out.orderBy("Date").collect()] == [1000.0, 3500.0]
    assert "Empty" not in U.drop_empty_columns(out).columns


def test_an_empty_new_row_replaces_nothing(spark):
    schema = "Name string, Date date, Close string"
    out = U.upsert_series(spark.createDataFrame([("a", DAY, "1")], schema), spark.createDataFrame([("a", DAY, None)], schema))
    assert [r["Close"] for r in out.collect()] == [1.0]


def test_fills_of_both_sides_of_a_day_stay_apart(spark):
    rows = [(DAY, TR.OPEN_BUY, "1", "x", 100, 10.0), (DAY, TR.OPEN_BUY, "1", "x", 300, 20.0), (DAY, TR.CLOSE_SELL, "1", "x", 400, 18.0),
            (DAY, TR.OPEN_SELL, "1", "x", 50, 11.0), (DAY, TR.CLOSE_BUY, "1", "x", 50, 9.0), (DAY, TR.CLOSE_BUY, "2", "y", 70, 5.0)]
    fills = spark.createDataFrame(rows, "Date date, Type string, Code string, CompanyName string, Shares long, Price double")
    got = {(r.Code, r.Side): (r.CompanyName, r.Shares, r.AcqPrice, r.SettlePrice) for r in TR.pair_fills(TR.fill_vwap(fills)).collect()}
    assert got == {("1", TR.LONG): ("x", 400, 17.5, 18.0), ("1", TR.SHORT): ("x", 50, 11.0, 9.0), ("2", TR.SHORT): ("y", 0, 0.0, 5.0)}


def test_leveraged_months_follow_the_calendar(spark):
    march = dt.date(2020, 3, 2)
    deposits = spark.createDataFrame([(DAY, 100), (march, 300)], "Date date, Deposit long")
    profit = spark.createDataFrame([(DAY, 10, 8), (march, 20, 16)], "Date date, Profit long, ProfitAfterTax long")
    got = TR.monthly_leveraged(deposits, deposits.withColumnRenamed("Deposit", "BuyingPower"), profit).orderBy("Date").collect()
    assert [(r.Date.month, r.MeanDeposit, r.Days, r.Profit, r.Rate) for r in got] == [(1, 100.0, 1, 10, 0.1), (2, None, 0, 0, None), (3, 300.0, 1, 20, 20 / 300)]


def test_made_up_codes_meet_no_code_change(spark):
    """A company per key, also where the key equals a code that was changed; the rule's own map is the default."""
    codes = [f"{i}0" for i in range(1300, 1400)]
    rows = [(DAY, c, 1.0, 1.0, 1.0, 1.0, 10.0, 5.0, 1.0) for c in codes]
    raw = spark.createDataFrame(rows, "Date date, Code string, Open double, High double, Low double, Close double, Volume double, TurnoverValue double, AdjustmentFactor double")
    assert C.clean_prices(raw, replacements={}, manual=()).select("Code").distinct().count() == 100
    assert C.clean_prices(raw).select("Code").distinct().count() == 99


@pytest.mark.parametrize("held", [1 << 24, 1])
def test_cross_products_do_not_depend_on_batches(spark, monkeypatch, held):
    monkeypatch.setattr(L, "HELD", held)
    x = np.random.default_rng(5).normal(size=(3000, 4))
    df = spark.createDataFrame([("ab"[i % 2], [float(v) for v in r]) for i, r in enumerate(x)], "k string, x array<double>").repartition(3)
    for j, key in enumerate("ab"):
        rows = L.gram(df, "x", 4, by=["k"]).filter(F.col("k") == key).toPandas()
        assert len(rows) == 10 and np.allclose(L.to_matrix(rows, 4), x[j::2].T @ x[j::2])


def test_bundle_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    DatasetBundle({"raw_returns": df}, {"k": 3}).save(spark, str(tmp_path / "b"))
    back = DatasetBundle.load(spark, str(tmp_path / "b"))
    assert back.params == {"k": 3} and back["raw_returns"].collect() == df.collect()
    with pytest.raises(ValueError):
        DatasetBundle({"other": df})


def test_index_level_follows_the_rate(spark):
    rows = [(DAY + dt.timedelta(days=i), "s", float(c)) for i, c in enumerate((100, 110, 99))]
    base = spark.createDataFrame(rows, "Date date, Sector string, MarketCapClose double").withColumns({
        **{f"MarketCap{x}": F.col("MarketCapClose") for x in ("Open", "High", "Low")}, "OutstandingShares": F.lit(1.0), "CorrectionValue": F.lit(0.0)})
    out = SI.index_from_base(base).orderBy("Date").collect()
    assert [r["Close"] for r in out][1:] == pytest.approx([1.1, 0.99]) and out[0]["Close"] is None and out[0]["Open"] == 1.0
