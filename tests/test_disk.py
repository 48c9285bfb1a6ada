"""Queries on the stock panel move no panel rows after it is stored, and store no day that follows from the one before."""

import datetime as dt
import random
import re
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import marketcap as MC
from panelforge.operators import portfolio as PO
from panelforge.plans import catalog_portfolio as CP
from panelforge.plans.catalog import QUERIES

DAY = dt.date(2020, 1, 1)


def by_day(df) -> bool:
    """Whether the plan deals rows by day and something else; the calendar alone has a row a day."""
    return re.search(r"Exchange hashpartitioning\(Date#\d+, [A-Z_]", df._jdf.queryExecution().executedPlan().toString()) is not None


@pytest.fixture()
def folder(spark, tmp_path):
    """Lines of seven stocks in two sectors on a few of thirty days; one line without a stock, one without a day, one stock listed twice."""
    rng = random.Random(5)
    lines = [(i, rng.randint(1, 7), rng.randint(1, 20), rng.randint(1, 3), float(rng.randint(1, 50)), rng.randint(10000, 99999) / 100, rng.randint(0, 10) / 100,
              rng.randint(0, 8) / 100, rng.choice("ANR"), rng.choice("FO"), dt.datetime.combine(DAY + dt.timedelta(days=rng.randint(0, 29) * 4), dt.time())) for i in range(90)]
    lines += [(90, None, 1, 1, 5.0, 10.0, 0.1, 0.0, "A", "F", dt.datetime(2020, 1, 1)), (91, 1, 1, 1, 5.0, 10.0, 0.1, 0.0, "A", "F", None)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    stocks = [(k, f"Supplier {k}", k % 2, 100.0) for k in range(1, 8)] + [(3, "Twin of 3", 1, 100.0), (None, "Nobody", 0, 1.0)]
    spark.createDataFrame(stocks, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "X", 0), (1, "Y", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def test_panel_is_dealt_by_stock_alone_for_sector_weights(spark, folder):
    out = QUERIES["sector_weights"].run(spark, folder)
    assert not by_day(out)
    got = out.toPandas()
    assert got.groupby(["Date", "Sector"])["Weight"].sum().to_numpy() == pytest.approx(1.0)
    days = spark.read.parquet(f"{folder}/lineitem.parquet").select(F.to_date("l_shipdate").alias("d"), "l_suppkey").dropna().toPandas()
    calendar = sorted({*days["d"]})
    first = days.groupby("l_suppkey")["d"].min()
    assert len(got) == sum((2 if k == 3 else 1) * sum(d >= first[k] for d in calendar) for k in first.index)


def test_quiet_days_are_not_stored_and_come_back(spark):
    """Splits, share counts that move on a quiet day, missing share counts, and a day that is missing."""
    rows = []
    for code, missing, shares in (("1", (), [10.0] * 4 + [12.0] * 4), ("2", (3,), [None] * 5 + [7.0] * 3), (None, (), [1.0] * 8)):
        close, before = 100.0, None
        for i in (i for i in range(8) if i not in missing):
            live = i in (0, 2, 6)
            close = 100.0 + i if live else close
            n = shares[i]
            cap = None if n is None else close * n
            rows.append((DAY + dt.timedelta(days=i), code, *([close + (x if live else 0) for x in (1, 2, -1)]), close, 5.0 * live, 9.0 * live, 0.5 if i == 2 else 1.0,
                         n, cap and cap - close * (before or 0.0), i))
            before = n
    schema = "Date date, Code string, Open double, High double, Low double, Close double, Volume double, TurnoverValue double, AdjustmentFactor double, OutstandingShares double, CorrectionValue double, DayNumber int"
    panel = MC.add_market_caps(spark.createDataFrame(rows, schema))
    folded = MC.fold_quiet_days(panel, "DayNumber")
    assert sorted((r.Code or "", r.DayNumber, r._n) for r in folded.collect()) == [
        ("", 0, 2), ("", 2, 4), ("", 6, 2), ("1", 0, 2), ("1", 2, 2), ("1", 4, 2), ("1", 6, 2),
        ("2", 0, 2), ("2", 2, 1), ("2", 4, 1), ("2", 5, 1), ("2", 6, 2)]
    days = F.array(*[F.lit(DAY + dt.timedelta(days=i)) for i in range(8)])
    back = MC.unfold_quiet_days(folded, "DayNumber", days)
    assert sorted(map(repr, back.select(*MC.PANEL).collect())) == sorted(map(repr, panel.select(*MC.PANEL).collect()))


def weights_by_code(spark, seed=3, stocks=40):
    """Weights of two days, both sides, two sectors, some stocks listed twice, stored by code."""
    from panelforge.session import stage_by

    rng = random.Random(seed)
    rows = [(DAY + dt.timedelta(days=d), side, sector, f"{sector}{k:02d}", f"Name {k}", rng.choice([10.0, 20.0, 50.0, 70.0]), rng.randint(1, 6), False, rng.randint(1, 9) / 400)
            for d in range(2) for side in ("Long", "Short") for sector in "ab" for k in range(stocks) for _ in range(1 + (k % 11 == 0))]
    df = spark.createDataFrame(rows, "Date date, Direction string, Sector string, Code string, CompanyName string, EstimatedCost double, MaxUnit long, isBorrowingStock boolean, Weight double")
    budgets = spark.createDataFrame([(DAY + dt.timedelta(days=d), side, sector, 4000.0 + 500 * d) for d in range(2) for side in ("Long", "Short") for sector in "ab"],
                                    "Date date, Direction string, Sector string, MaxCost double")
    return stage_by(df.repartition(4, "Code"), "weights", "Code", 4), budgets


def same_rows(got: pd.DataFrame, wanted: pd.DataFrame, columns: list[str]):
    table = lambda x: sorted(map(tuple, x[columns].round(9).itertuples(index=False)))
    assert table(got) == table(wanted)


KEYS = ["Date", "Direction", "Sector", "Code", "Weight", "EstimatedCost"]


def test_draft_units_moves_no_rows(spark):
    weights, budgets = weights_by_code(spark)
    out = PO.draft_units(weights, budgets)
    assert not by_day(out)
    got = out.toPandas()
    ideal = np.trunc(got["Weight"] * got["MaxCost"])
    low = np.floor(ideal / got["EstimatedCost"]) * got["EstimatedCost"]
    up = (ideal - low) > (low + got["EstimatedCost"] - ideal)
    assert (got["Unit"] == low / got["EstimatedCost"] + up).all() and len(got) == weights.count()


def test_capped_units_moves_no_rows(spark):
    weights, budgets = weights_by_code(spark)
    draft = PO.draft_units(weights, budgets)
    out = PO.cap_units(draft)
    assert not by_day(out)
    got = out.toPandas()
    assert (got["Unit"] <= got["MaxUnit"]).all() and (got["TotalCost"] == got["Unit"] * got["EstimatedCost"]).all() and got["isMaxUnit"].any()


def reduced_by_hand(rows: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for _, g in rows.groupby(PO.GROUP):
        g = g.sort_values(["ReductionRate", "Weight", "Code"], ascending=[False, False, True]).reset_index(drop=True)
        spent, unit = g["TotalCost"].sum(), g["Unit"].to_numpy(copy=True)
        for i in range(len(g)):
            if spent > g["MaxCost"][i] and g["ReductionRate"][i] >= 1 and unit[i] > 0:
                unit[i] -= 1
                spent -= g["EstimatedCost"][i]
        parts.append(g.assign(Unit=unit, TotalCost=unit * g["EstimatedCost"]))
    return pd.concat(parts)


def test_reduction_sends_candidates_alone(spark):
    weights, budgets = weights_by_code(spark)
    units = PO.cap_units(PO.draft_units(weights, budgets)).withColumn("MaxCost", F.col("MaxCost") * 0.2)
    out = PO.reduce_to_budget(units)
    assert not by_day(out)
    before = units.toPandas()
    wanted = reduced_by_hand(before)
    assert wanted["Unit"].sum() < before["Unit"].sum()
    same_rows(out.toPandas(), wanted, [*KEYS, "Unit", "TotalCost"])


def spent_by_hand(rows: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for _, g in rows.groupby(PO.GROUP):
        g = g.sort_values(["Weight", "Code"], ascending=[False, True]).reset_index(drop=True)
        free, unit, rate, full = g["MaxCost"][0] - g["TotalCost"].sum(), g["Unit"].to_numpy(copy=True), g["ReductionRate"].to_numpy(copy=True), g["isMaxUnit"].to_numpy(dtype=bool, copy=True)
        while True:
            open_rows = [i for i in range(len(g)) if g["EstimatedCost"][i] <= free and not full[i] and rate[i] == rate[i]]
            if not open_rows:
                break
            i = min(open_rows, key=lambda j: rate[j])
            cost, ideal = g["EstimatedCost"][i], g["IdealCost"][i]
            unit[i] += 1
            free -= cost
            rate[i] = abs(ideal - unit[i] * cost) / max(abs(ideal - (unit[i] + 1) * cost), 1e-12)
            full[i] = unit[i] >= g["MaxUnit"][i]
        parts.append(g.assign(Unit=unit, TotalCost=unit * g["EstimatedCost"], isMaxUnit=full))
    return pd.concat(parts)


def test_rest_of_the_budget_is_spent_without_moving_all_rows(spark):
    weights, budgets = weights_by_code(spark)
    units = PO.reduce_to_budget(PO.cap_units(PO.draft_units(weights, budgets)))
    out = PO.spend_budget(units)
    assert not by_day(out) and "InMemoryTableScan" not in out._jdf.queryExecution().executedPlan().toString()
    before = units.toPandas()
    wanted = spent_by_hand(before)
    assert wanted["Unit"].sum() > before["Unit"].sum()
    same_rows(out.toPandas(), wanted, [*KEYS, "Unit", "TotalCost", "isMaxUnit"])


def test_admission_makes_its_orders_once(spark, tmp_path, monkeypatch):
    rows = [(DAY, f"c{i:02d}", "n", "s", 1, 10.0, 10.0 + i, 12.0, 12.0 + i, "Long", False) for i in range(20)]
    schema = "Date date, Code string, CompanyName string, Sector string, Unit int, EstimatedCost double, TotalCost double, UpperLimitCost double, UpperLimitTotal double, Direction string, isBorrowingStock boolean"
    seen = str(tmp_path)

    def note(batches):
        for b in batches:
            for code in b["Code"]:
                open(f"{seen}/{code}-{uuid.uuid4().hex}", "w").close()
            yield b

    monkeypatch.setattr(CP, "sized", lambda m: spark.createDataFrame(rows, schema).mapInPandas(note, schema))
    got = QUERIES["admitted_orders"].build(None).collect()
    assert len(got) == 20 and {r.Status for r in got} == {"accepted"}
    assert len([*tmp_path.iterdir()]) == 20
