"""Refitted, validated and boosted models against plain numpy over the same rows."""

import datetime as dt
import math

import numpy as np
import pytest

from panelforge.operators import models as MO
from panelforge.operators import trees as TR
from panelforge.operators import walkforward as WF

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def panel(spark):
    """Two years of days for three sectors; nulls in features and target, one sector with a constant column, one with few rows."""
    rng = np.random.default_rng(4)
    rows = []
    for s, sector in enumerate(("A", "B", "C")):
        for i in range(500 if sector != "C" else 30):
            x = rng.normal(0, 0.01, 4)
            x[3] = 0.5 * x[0] + 0.5 * x[3]
            if sector == "B":
                x[2] = 0.0
            y = float(0.4 * x[0] - 0.2 * x[1] + (s - 1) * 0.002 + (0.004 if x[2] > 0.003 else 0.0) + rng.normal(0, 0.004))
            day = dt.date(2020, 1, 1) + dt.timedelta(days=int(i * 1.4))
            rows.append((day, sector, None if i % 53 == 7 else y, *[None if i % 41 == j else float(v) for j, v in enumerate(x)]))
    table = spark.createDataFrame(rows, "Date date, Sector string, Target double, a double, b double, c double, d double").repartition(3)
    return rows, table.select("Date", "Sector", "Target"), table.select("Date", "Sector", *COLUMNS)


def complete(rows, sector=None):
    return [r for r in rows if (sector is None or r[1] == sector) and None not in r[2:]]


@pytest.mark.parametrize("months", [None, 6])
def test_walk_forward_uses_the_past_alone(panel, months):
    rows, target, features = panel
    number = lambda d: d.year * 12 + d.month - 1
    got = {(r.Date, r.Sector): r.Pred for r in WF.walk_forward_predictions(target, features, ["a", "b", "c"], months, min_rows=50).collect()}
    assert len(got) == len(rows)
    seen = 0
    for r in rows:
        past = [q for q in rows if q[1] == r[1] and None not in q[2:6] and number(q[0]) < number(r[0]) and (months is None or number(q[0]) >= number(r[0]) - months)]
        if len(past) < 50 or None in r[3:6]:
            assert got[r[0], r[1]] is None
            continue
        x, y = np.array([q[3:6] for q in past]), np.array([q[2] for q in past])
        if r[1] == "B":  # a constant column: the mean alone
            want = y.mean()
        else:
            coef = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
            want = coef[0] + np.array(r[3:6]) @ coef[1:]
        assert math.isclose(got[r[0], r[1]], want, rel_tol=1e-7, abs_tol=1e-10)
        seen += 1
    assert seen > 300


def plain_lasso(x, y, alpha):
    """Coordinate descent on the rows themselves."""
    mx, my = x.mean(0), y.mean()
    z, t, w = x - mx, y - my, np.zeros(x.shape[1])
    for _ in range(3000):
        for j in range(len(w)):
            v = (z[:, j] ** 2).mean()
            rho = (z[:, j] * (t - z @ w + z[:, j] * w[j])).mean()
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / v if v > 0 else 0.0
    return my - mx @ w, w


def test_penalty_by_held_out_days(panel):
    rows, target, features = panel
    grid = [3e-3, 1.5e-3, 8e-4, 4e-4, 1e-4]
    got = MO.fit_lasso_validated(target, features, COLUMNS, penalties=grid, min_features=1, max_features=3).filter("Sector = 'A'").first()
    data = sorted(complete(rows, "A"))
    x, y = np.array([r[3:] for r in data]), np.array([r[2] for r in data])
    x = (x - x.mean(0)) / x.std(0)
    cut = np.array_split(np.arange(len(y)), 5)
    best = None
    for alpha in grid:
        losses = []
        for out in cut:
            keep = np.setdiff1d(np.arange(len(y)), out)
            b, w = plain_lasso(x[keep], y[keep], alpha)
            losses.append(((y[out] - b - x[out] @ w) ** 2).sum() / ((y[out] - y[out].mean()) ** 2).sum())
        b, w = plain_lasso(x, y, alpha)
        kept = int((w != 0).sum())
        if 1 <= kept <= 3 and (best is None or np.mean(losses) < best[0]):
            best = (np.mean(losses), alpha, kept, b, w)
    assert got.Status == "ok" and got.Alpha == best[1] and got.Features == best[2]
    assert math.isclose(got.Loss, best[0], rel_tol=1e-9)
    assert np.allclose(got.Coef, best[4], atol=1e-10) and math.isclose(got.Intercept, best[3], abs_tol=1e-12)


def test_pooled_model_and_status(spark, panel):
    rows, target, features = panel
    pooled = MO.fit_lasso_validated(target, features, COLUMNS, by=None, penalties=[1e-4], min_features=4, max_features=4)
    model = pooled.first()
    assert model.Sector == "*" and model.Rows == len(complete(rows)) and model.Status == "ok"
    found = MO.predict_lasso(pooled, features, COLUMNS, pooled=True).collect()
    assert len(found) == len(rows) and sum(r.Pred is None for r in found) == sum(None in r[3:] for r in rows)
    tight = MO.fit_lasso_validated(target, features, COLUMNS, penalties=[1.0], min_features=3, max_features=4)
    assert {r.Status for r in tight.collect()} == {"features out of range"}
    assert {r.Pred for r in MO.predict_lasso(tight, features, COLUMNS, usable=["ok"]).collect()} == {None}
    # A sector without a model keeps its rows.
    few = MO.predict_lasso(tight.filter("Sector <> 'B'"), features, COLUMNS).filter("Sector = 'B'").collect()
    assert len(few) == 500 and {r.Pred for r in few} == {None}


def plain_trees(rows, model, rounds, leaves, rate, l1, min_rows):
    """The same boosting, over the rows themselves."""
    x = [[math.nan if v is None else v for v in r[3:]] + [r[1]] for r in rows]
    y = np.array([r[2] for r in rows])
    score = np.full(len(y), y.mean())
    shrink = lambda g: math.copysign(max(abs(g) - l1, 0.0), g)
    gain_of = lambda g, n, l2=0.0: shrink(g) ** 2 / (n + l2)
    for _ in range(rounds):
        g = score - y

        def best(at):
            total, options = gain_of(g[at].sum(), len(at)), []
            for f in range(4):
                values = np.array([x[i][f] for i in at])
                missing = np.isnan(values)
                for null_left in (True, False) if missing.any() else (False,):
                    for edge in [*model.edges[f], math.inf]:
                        left = np.where(missing, null_left, values <= edge)
                        options.append((f, 0.0, left))
            names = sorted({x[i][4] for i in at})
            sector = np.array([x[i][4] for i in at])
            names.sort(key=lambda s: g[at][sector == s].sum() / ((sector == s).sum() + 10.0))
            options += [(4, 10.0, np.isin(sector, names[:k])) for k in range(1, len(names) + 1)]
            found = None
            for f, l2, left in options:
                a, b = at[left], at[~left]
                if min(len(a), len(b)) >= min_rows:
                    gain = gain_of(g[a].sum(), len(a), l2) + gain_of(g[b].sum(), len(b), l2) - total
                    if gain > 1e-12 and (found is None or gain > found[0] * (1 + 1e-9)):
                        found = (gain, a, b)
            return found
        parts = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(parts) < leaves and any(p[1] for p in parts):
            i = max(range(len(parts)), key=lambda i: parts[i][1][0] if parts[i][1] else -1)
            _, a, b = parts.pop(i)[1]
            parts += [(a, best(a)), (b, best(b))]
        for at, _ in parts:
            score[at] -= rate * shrink(g[at].sum()) / len(at)
    return score


def test_trees_against_rows(panel):
    rows, target, features = panel
    target = target.selectExpr("Date", "Sector", "Target * 100 AS Target")
    data = [(r[0], r[1], r[2] * 100, *r[3:]) for r in rows if r[2] is not None]
    model = TR.fit_leafwise(target, features, COLUMNS, rounds=3, leaves=5, learning_rate=0.3, l1=0.5, min_rows=15, bins=8)
    assert [sum(n.children is None for n in t) for t in model.trees] == [5, 5, 5]
    want = dict(zip([(r[0], r[1]) for r in data], plain_trees(data, model, 3, 5, 0.3, 0.5, 15), strict=True))
    got = {(r.Date, r.Sector): r.Pred for r in TR.predict_leafwise(model, features).collect()}
    assert len(got) == len(rows) and None not in got.values()
    assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())
    assert len(set(got.values())) > 8


def test_trees_without_gain(spark, panel):
    _, target, features = panel
    model = TR.fit_leafwise(target, features, COLUMNS, rounds=2, l1=1e6)
    assert model.trees == [] and TR.predict_leafwise(model, features).select("Pred").distinct().count() == 1
    empty = TR.fit_leafwise(target.limit(0), features, COLUMNS, rounds=2)
    assert empty.trees == [] and empty.base == 0.0
