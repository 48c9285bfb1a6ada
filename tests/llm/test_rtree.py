"""Hard negatives from the packed R-tree against brute force in whole numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import rtree
from panelforge.session import ship_package

TABLE = "vec_id long, embedding array<double>, label int, low long, bundle string"


def brute(rows, scale=256, positives=5, negatives=10):
    kept = {}
    for key, x, label in rows:
        if key is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        value = (label, [int(np.floor(c * scale)) for c in x])
        kept[key] = min(kept.get(key, value), value)
    out = set()
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scores = [(-sum(p * q for p, q in zip(v, w, strict=True)), b, other) for b, (other, w) in kept.items() if b != a]
        same = sorted((s, b) for s, b, other in scores if other == label)[:positives]
        for s, b in same:
            rest = sorted((t, c) for t, c, other in scores if other != label and -30 * s <= -100 * t <= -90 * s)[:negatives]
            out |= {(a, b, i + 1, c, -s, -t) for i, (t, c) in enumerate(rest)}
    return out


def mined(spark, rows):
    table = spark.createDataFrame([(k, x, y, 1, "b") for k, x, y in rows], TABLE).repartition(4)
    found = rtree.scaled_rows(table, 256, F.col("label"))
    return {tuple(r) for r in rtree.hard_negatives(found, found.filter(F.col("vec_id") % 100 == 0)).collect()}


def made(kind):
    rng = np.random.default_rng(8)
    n, dim = 1500, 6
    centres = rng.normal(0, 0.4, (12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.05, (n, dim))
    if kind == "ties":
        x = np.round(x, 1)
        x[300:900] = x[0]  # a hot vector
    if kind == "large":
        x = x * 2e5
    rows = [(i, v.tolist(), None if i % 97 == 5 else int(i % 9 if i % 3 else 1)) for i, v in enumerate(x)]
    rows += [(3000, None, 1), (3001, [None, *x[0].tolist()[1:]], 1), (3002, [float("nan"), *x[0].tolist()[1:]], 1), (3003, [float("inf"), *x[0].tolist()[1:]], 1),
             (None, x[0].tolist(), 1), (400, x[7].tolist(), 8), (400, x[7].tolist(), 8), (-100, x[9].tolist(), 2), (3100, [0.0] * dim, 3), (3200, x[3].tolist(), 77)]
    return rows


@pytest.mark.parametrize("kind", ["clusters", "ties", "large"])
def test_against_brute_force(spark, monkeypatch, kind):
    ship_package(spark)
    for name, value in (("BLOCK", 128), ("LEAF", 8), ("CHILDREN", 3), ("BUNDLE", 4), ("PAGE", 8)):
        monkeypatch.setattr(rtree, name, value)
    rows = made(kind)
    want = brute(rows)
    assert mined(spark, rows) == want and len(want) > 100


def test_beyond_doubles():
    """Scores that a double cannot hold are still whole."""
    rng = np.random.default_rng(1)
    m = rng.integers(-(1 << 26), 1 << 26, (200, 4))
    labels = rng.integers(0, 2, 200)
    order = rtree.tile_order(m)
    tree = rtree.PackedTree(order, labels[order], m[order], False)
    q = rng.integers(-(1 << 26), 1 << 26, 4)
    low, high, kth = (np.array([v], dtype=np.int64) for v in (rtree.LOW, rtree.HIGH, rtree.LOW))
    want = sorted((-sum(int(a) * int(b) for a, b in zip(q, r, strict=True)), i) for i, r in enumerate(m) if labels[i] != 1)[:7]
    assert tree.search(-1, 1, q, False, low, high, kth, 7) == [want]


def test_boxes_hold_every_score():
    rng = np.random.default_rng(2)
    m, q = rng.integers(-50, 50, (60, 5)), rng.integers(-50, 50, (9, 5))
    least, most = rtree.bounds(q, m.min(axis=0)[None], m.max(axis=0)[None])
    scores = q @ m.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (most[:, 0] >= scores.max(axis=1)).all()
    assert sorted(rtree.tile_order(m, 8).tolist()) == list(range(60))


def test_refusals_and_empty(spark):
    ship_package(spark)
    wide = spark.createDataFrame([(1, [1.0], 1, 1, "b"), (2, [1.0, 2.0], 1, 1, "b")], TABLE)
    with pytest.raises(ValueError, match="dimension"):
        rtree.scaled_rows(wide, 256, F.col("label"))
    with pytest.raises(ValueError, match="too large"):
        rtree.scaled_rows(spark.createDataFrame([(1, [1e300], 1, 1, "b")], TABLE), 256, F.col("label"))
    assert mined(spark, []) == set() and mined(spark, [(100, [1.0], 1)]) == set()
