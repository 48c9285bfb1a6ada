"""Operators that replace a task per day, an items x items matrix or a job per column, against plain walks."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge import session
from panelforge.operators import evaluate as EV
from panelforge.operators import clustering as CL
from panelforge.operators import factors as FC
from panelforge.operators import linalg as L
from panelforge.operators import marketcap as MC
from panelforge.operators import portfolio as PO
from panelforge.operators import prefix as X
from panelforge.operators import preprocess as PP
from panelforge.operators import sector_index as SI
from panelforge.operators import splitting as SP
from panelforge.plans.market import Market
from panelforge.session import stage

DAY = dt.date(2024, 1, 1)


def test_running_total_inside_large_keys(spark):
    rng = random.Random(1)
    rows = [("big" if i % 10 else f"k{i % 30}", i, None if i % 17 == 3 else float(rng.randrange(100))) for i in range(3000)]
    table = X.ranged(spark.createDataFrame(rows, "k string, i long, v double").repartition(5), ["k", "i"], "test")
    got = {(r.k, r.i): (r.upto, r.before) for r in X.running_total(X.running_total(table, ["k"], ["i"], "v", "upto"), ["k"], ["i"], "v", "before", inclusive=False).collect()}
    total = {}
    for k, i, v in sorted(rows):
        total[k] = total.get(k, 0.0) + (v or 0.0)
        assert got[k, i] == (total[k], total[k] - (v or 0.0))


@pytest.mark.parametrize("seed", range(3))
def test_admission_is_the_walk(spark, seed):
    rng = random.Random(seed)
    orders = []
    for day in range(6):
        for i in range([0, 1, 7, 40, 150, 400][day]):
            need = float(rng.choice([0, 1, 2, 5, 30, 60, 90, 250, 600, 1001]) if seed else rng.randrange(1, 700))
            orders.append((DAY + dt.timedelta(days=day), f"c{i:04d}", rng.choice(["Long", "Short"]), float(rng.randrange(60)), need))
    table = spark.createDataFrame(orders, "Date date, Code string, Direction string, CumCost_byLS double, UpperLimitTotal double").repartition(4)
    standing = table.filter("Code in ('c0003', 'c0005')").select("Date", "Code").filter("Date = '2024-01-05'")
    got = {(r.Date, r.Code): r.Status for r in PO.admit_orders(table, 1000.0, standing).collect()}
    left = {}
    for d, code, side, cum, need in sorted(orders, key=lambda o: (o[0], o[3], o[2], o[1])):
        if d == dt.date(2024, 1, 5) and code in ("c0003", "c0005"):
            want = "already ordered"
        else:
            free = left.setdefault(d, 1000.0)
            want = "accepted" if need <= free else "refused"
            left[d] = free - need if need <= free else free
        assert got[d, code] == want, (d, code, need)
    assert len(got) == len(orders)


def panel_of(spark, days, items, holes, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(days, 3)) @ rng.normal(size=(3, items)) + 0.3 * rng.normal(size=(days, items))
    mask = rng.random((days, items)) < holes
    rows = [(DAY + dt.timedelta(days=d), f"s{i:05d}", None if mask[d, i] else float(x[d, i])) for d in range(days) for i in range(items)]
    full = x.copy()
    for i in range(items):
        known = np.flatnonzero(~mask[:, i])
        full[:, i] = x[known[np.maximum(np.searchsorted(known, np.arange(days), side="right") - 1, 0)], i]
    return spark.createDataFrame(rows, "Date date, Code string, value double").repartition(4), full


@pytest.mark.parametrize("days,items,k", [(30, 8, 2), (25, 4000, 3), (12, 5, 5)])
def test_factors_against_the_whole_matrix(spark, days, items, k):
    table, x = panel_of(spark, days, items, 0.05)
    got = np.zeros_like(x)
    for r in FC.remove_factors(table, k).collect():
        got[(r.Date - DAY).days, int(r.Code[1:])] = r.value
    c = x - x.mean(axis=0)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    want = c - (u[:, :k] * s[:k]) @ v[:k]
    assert np.allclose(got, want, atol=1e-8)
    assert FC.remove_factors(table, 0) is table


def test_coordinates_against_the_whole_matrix(spark):
    table, x = panel_of(spark, 20, 300, 0.0, 3)
    got = np.array([[r.Feature0, r.Feature1] for r in FC.item_coordinates(table, 2, "value", "Code").orderBy("Code").collect()])
    u, s, v = np.linalg.svd((x - x.mean(axis=1, keepdims=True)).T, full_matrices=False)
    want = (u * s)[:, :2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert all(got[np.abs(got[:, i]).argmax(), i] > 0 for i in range(2))


def columns_with_holes(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(3.0, 1.0, (400, 6))
    x[:, 4] += 0.7 * x[:, 0] - 0.2 * x[:, 1]
    x[:, 5] = 2.5
    hole = rng.random(x.shape) < 0.08
    hole[:, 5] = False
    rows = [(DAY + dt.timedelta(days=i), *[None if h else float(v) for v, h in zip(r, m, strict=True)]) for i, (r, m) in enumerate(zip(x, hole, strict=True))]
    return spark.createDataFrame(rows, "Date date, a double, b double, c double, d double, e double, f double").repartition(3), np.where(hole, np.nan, x)


@pytest.mark.parametrize("intercept", [False, True])
def test_one_pass_fits_every_target_on_its_own_rows(spark, intercept):
    table, x = columns_with_holes(spark)
    step = PP.NeutraliseOn(["c", "d", "e", "a", "missing"], ["a", "b"], fit_intercept=intercept).fit(table)
    for name, at in (("c", 2), ("d", 3), ("e", 4)):
        z = x[:, [0, 1, at]]
        z = z[~np.isnan(z).any(axis=1)]
        design = np.column_stack([z[:, :2], np.ones(len(z))]) if intercept else z[:, :2]
        want = np.linalg.lstsq(design, z[:, 2], rcond=None)[0]
        xs, coef, level = step.models[name]
        assert xs == ["a", "b"] and np.allclose(coef, want[:2], atol=1e-9) and np.isclose(level, want[2] if intercept else 0.0, atol=1e-8)
    assert step.models["a"][0] == ["b"] and "missing" not in step.models


def test_specs_in_waves(spark):
    table, x = columns_with_holes(spark)
    chain = PP.neutralisation_steps([("c", "a", "c1"), ("d", "a, b", "d1"), ("e", "c1", "e1")]).fit(table)
    assert [len(s.specs) for _, s in chain.steps] == [2, 1]
    out = chain.transform(table).orderBy("Date").toPandas()
    c, a = x[:, 2], x[:, 0]
    ok = ~np.isnan(c) & ~np.isnan(a)
    c1 = np.where(np.isnan(a), c, c - a * (c[ok] @ a[ok]) / (a[ok] @ a[ok]))
    assert np.allclose(out["c1"].to_numpy(), c1, equal_nan=True)
    e = x[:, 4]
    ok = ~np.isnan(e) & ~np.isnan(c1)
    assert np.allclose(out["e1"].to_numpy(), np.where(np.isnan(c1), e, e - c1 * (e[ok] @ c1[ok]) / (c1[ok] @ c1[ok])), equal_nan=True)


def test_correlations_of_all_pairs(spark):
    table, x = columns_with_holes(spark)
    got = L.pairwise_correlations(table, list("abcdef"))
    for i in range(6):
        for j in range(6):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 5 in (i, j):
                assert np.isnan(got[i, j])
            else:
                assert np.isclose(got[i, j], np.corrcoef(x[ok, i], x[ok, j])[0, 1], atol=1e-10)
    cells = {(r.A, r.B): r.Corr for r in EV.correlation_table(table, list("abf")).collect()}
    assert len(cells) == 9 and cells["a", "f"] is None and abs(cells["a", "a"] - 1) < 1e-12


def test_splits_end_where_nothing_separates(spark):
    rng = np.random.default_rng(3)
    centres = [(0, 0, 0), (9, 0, 0), (0, 9, 0), (9, 9, 9), (-9, 4, 4)]
    rows = [(i, [float(v) for v in np.array(centres[i % 5]) + rng.normal(0, 0.05, 3)]) for i in range(300)]
    rows += [(1000, [50.0, 0.0, 0.0]), (1001, [50.0, 0.0, 0.0]), (1002, None)]
    table = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    got = {r.id: (r.Path, r.Cluster) for r in SP.recursive_splits(table, 0.5).collect()}
    assert set(got) == {i for i, v in rows if v is not None}
    groups = {}
    for i, label in got.items():
        groups.setdefault(label, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted([[i for i in range(300) if i % 5 == c] for c in range(5)] + [[1000, 1001]])
    assert sorted(c for _, c in groups) == list(range(6)) and [p for p, _ in sorted(groups)] == [p for p, _ in sorted(groups, key=lambda g: g[1])]
    assert SP.recursive_splits(table.limit(0)).count() == 0
    assert {r.Path for r in SP.recursive_splits(table.filter(F.col("id") >= 1000)).collect()} == {""}


def test_pairs_within_sends_a_row_to_a_bounded_number_of_blocks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(CL, "stage", lambda df, name: seen.append(stage(df, name)) or seen[-1])
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)) / 3
    x[::7] = np.round(x[::7], 1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 6), (902, [None, 1.0, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, vector array<double>").repartition(5)
    got = {(r.a, r.b): r.distance for r in CL.pairs_within(table, 0.5, block_rows=5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(int(i), int(j)): d[i, j] for i, j in zip(*np.nonzero(np.triu(d <= 0.5, 1)))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert seen[0].select("b").distinct().count() <= CL.BLOCKS


@pytest.mark.parametrize("scale, limit", [(1e6, 1.0), (1e-6, 1e-6), (1e20, 1e20)])
def test_pairs_within_at_any_scale(spark, monkeypatch, scale, limit):
    monkeypatch.setattr(CL, "BLOCK_BYTES", 1 << 11)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * (scale if limit == scale else 1) + (scale if limit != scale else 0)
    rows = [(f"k{i:03d}", [float(c) for c in v]) for i, v in enumerate(x)]
    got = {(r.a, r.b) for r in CL.pairs_within(spark.createDataFrame(rows, "id string, vector array<double>"), limit, block_rows=40).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert got == {(f"k{i:03d}", f"k{j:03d}") for i, j in zip(*np.nonzero(np.triu(d <= limit, 1)))} and got


def test_dense_block_leaves_its_pairs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(CL, "PAIRS_AT_ONCE", 100)
    table = spark.createDataFrame([(i, [0.001 * i, 1.0]) for i in range(200)], "id long, vector array<double>")
    got = CL.pairs_within(table, 1.0).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == 199 * 100 and all(r.a < r.b for r in got)


LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def test_stock_panel_is_dealt_by_its_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "PANEL_ROWS", 100)
    rows = [(i, 1, i % 40 + 1, i % 7 + 1, float(i % 9 + 1), 10.0 * i, 0.01 * (i % 10), 0.01 * (i % 8), "N", "O", dt.datetime(2024, 1, 1) + dt.timedelta(days=i % 29)) for i in range(400)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    m = Market(spark, str(tmp_path))
    held = [r["count"] for r in m.price.groupBy(F.spark_partition_id()).count().collect()]
    assert m.panel_parts >= 8 and max(held) <= 4 * 100
    got = MC.market_caps(m.price, m.fin, m.calendar, overrides=(), parts=m.panel_parts)
    assert got.rdd.getNumPartitions() == m.panel_parts
    want = MC.market_caps(m.price, m.fin, m.calendar, overrides=())
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == sum(held)
    definition = spark.createDataFrame([(f"{k:04d}", f"s{k % 3}") for k in range(1, 41)], "Code string, Sector string")
    eps = SI.eps_factor(got, m.fin, definition, m.panel_parts)
    plain = SI.eps_factor(want, m.fin, definition)
    assert {(r.Date, r.Sector): r.ForecastEPS for r in eps.collect()} == pytest.approx({(r.Date, r.Sector): r.ForecastEPS for r in plain.collect()})


def test_shuffles_grow_with_the_lines(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        session.more_partitions(spark, session.LINE_ROWS)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        session.more_partitions(spark, 50 * session.LINE_ROWS)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert session.panel_partitions(spark, 10) == 1 and session.panel_partitions(spark, 360 * 2_500_000) == 1800


def test_tasks_read_bounded_bytes(spark):
    """Merged shuffle partitions and parts of files stay at what one task holds, whatever the session allows; smaller settings stay."""
    assert [session.in_bytes(x) for x in ("64MB", "16m", "512k", "7", "9b", "1g", "2KiB")] == [64 << 20, 16 << 20, 512 << 10, 7, 9, 1 << 30, 2048]
    before = {key: spark.conf.get(key) for key in session.BYTES_CONF}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
        session.tune(spark)
        assert [session.in_bytes(spark.conf.get(key)) for key in session.BYTES_CONF] == [session.TASK_BYTES, 256 << 10]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
