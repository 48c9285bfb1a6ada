"""Gradient-boosted trees with a leaf limit, an L1 term and categories, grown best leaf first from gradient histograms.

Rows are binned once and stored. Every job sends the trees so far to the rows, adds up gradients by node, feature and bin in each task
and sums those partial histograms; only histograms, whose size is set by leaves, columns and bins, reach the driver. Rows keep no state
between jobs, so a lost executor costs one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.session import stage

KEYS = ["Date", "Sector"]
#: Values of a categorical column, at most.
MAX_CATEGORIES = 1024
#: Weight of the overall level when categories are put in order, and the further L2 term of a split between categories.
CATEGORY_SMOOTHING, CATEGORY_L2 = 10.0, 10.0


@dataclass
class Node:
    """A place in a tree; ``feature`` is set where it is split. Bin 0 holds nulls and unknown categories."""

    depth: int = 0
    parent: int = -1
    is_left: bool = False
    gradient: float = 0.0
    rows: int = 0
    histogram: tuple[np.ndarray, np.ndarray] | None = None
    feature: int | None = None
    left_bins: np.ndarray | None = None  # whether a bin goes left
    gain: float = 0.0
    children: tuple[int, int] | None = None
    is_open: bool = True  # a leaf of the tree as grown so far
    value: float = 0.0


@dataclass
class BoostedTrees:
    """Fitted trees: ``columns`` with edges, then ``categorical`` with values; ``trees`` as lists of nodes, root first."""

    columns: list[str]
    categorical: list[str]
    edges: list[list[float]]
    values: list[list[str]]
    base: float = 0.0
    trees: list[list[Node]] = field(default_factory=list)

    def sizes(self) -> list[int]:
        return [len(e) + 2 for e in self.edges] + [len(v) + 1 for v in self.values]

    def goes_left(self, node: Node) -> Column:
        """The side of a split as a condition that is never null."""
        i = node.feature
        if i >= len(self.columns):
            chosen = [v for v, left in zip(self.values[i - len(self.columns)], node.left_bins[1:], strict=True) if left]
            return F.coalesce(F.col(self.categorical[i - len(self.columns)]).cast("string").isin(chosen), F.lit(False))
        x = F.col(self.columns[i]).cast("double")
        last = int(np.flatnonzero(node.left_bins[1:]).max(initial=-1))
        below = x <= self.edges[i][last] if 0 <= last < len(self.edges[i]) else F.lit(last >= 0)
        return F.when(x.isNull() | F.isnan(x), bool(node.left_bins[0])).otherwise(below)

    def prediction(self) -> Column:
        def walk(tree: list[Node], at: int) -> Column:
            node = tree[at]
            if node.children is None:
                return F.lit(float(node.value))
            return F.when(self.goes_left(node), walk(tree, node.children[0])).otherwise(walk(tree, node.children[1]))
        return sum((walk(tree, 0) for tree in self.trees), F.lit(float(self.base)))


def _shrunk(g: np.ndarray | float, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_value(gradient: float, rows: float, l1: float, l2: float) -> float:
    return float(-_shrunk(gradient, l1) / (rows + l2)) if rows + l2 > 0 else 0.0


def _score(g, n, l1: float, l2: float):
    return _shrunk(g, l1) ** 2 / np.maximum(n + l2, 1e-300)


def best_split(histogram: tuple[np.ndarray, np.ndarray], sizes: Sequence[int], numeric: int, l1: float, l2: float, min_rows: int) -> tuple[float, int, np.ndarray] | None:
    """Gain, feature and the bins that go left, or none. Ties go to the earlier feature, the smaller threshold, nulls to the left.

    Numeric features are cut between two bins with the nulls on either side. The values of a category are put in order of their mean
    gradient and cut once; unknown values and nulls go right.
    """
    gradients, counts = histogram
    best: tuple[float, int, np.ndarray] | None = None
    for i, size in enumerate(sizes):
        g, n = gradients[i, :size], counts[i, :size].astype(float)
        total_g, total_n = g.sum(), n.sum()
        order = np.arange(1, size)
        extra = l2
        if i >= numeric:
            order = order[n[1:] > 0]
            order = order[np.argsort(g[order] / (n[order] + CATEGORY_SMOOTHING), kind="stable")]
            extra = l2 + CATEGORY_L2
        for with_null in (True, False) if i < numeric and n[0] else (False,):
            left_g, left_n = np.cumsum(g[order]) + (g[0] if with_null else 0.0), np.cumsum(n[order]) + (n[0] if with_null else 0.0)
            gain = _score(left_g, left_n, l1, extra) + _score(total_g - left_g, total_n - left_n, l1, extra) - _score(total_g, total_n, l1, l2)
            gain = np.where((left_n >= min_rows) & (total_n - left_n >= min_rows), gain, -np.inf)
            at = int(np.argmax(gain)) if len(gain) else -1
            if at >= 0 and gain[at] > 1e-12 and (best is None or gain[at] > best[0] * (1 + 1e-12)):
                left = np.zeros(size, dtype=bool)
                left[order[: at + 1]] = True
                left[0] = with_null
                best = (float(gain[at]), i, left)
    return best


def bin_edges(rows: DataFrame, columns: Sequence[str], bins: int, digits: int = 6) -> list[list[float]]:
    """Thresholds between about equally filled bins: quantiles on a decimal grid, without repeats; one pass over all columns."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares).alias(f"e{i}") for i, c in enumerate(columns)]).first()
    return [sorted({round(v, digits) + 0.0 for v in found[f"e{i}"] or []}) for i in range(len(columns))]


def fit_leafwise(
    target: DataFrame, features: DataFrame, columns: Sequence[str], categorical: Sequence[str] = ("Sector",), rounds: int = 20, leaves: int = 7,
    learning_rate: float = 0.1, l1: float = 0.5, l2: float = 0.0, min_rows: int = 20, bins: int = 32,
) -> BoostedTrees:
    """Squared-error boosting over all sectors from the mean of the target; rows without a target are left out, null features are not."""
    data = features.join(target.select(*KEYS, F.col("Target").alias("_y")).filter(F.col("_y").isNotNull()), KEYS)
    lists = []
    for c in categorical:
        found = sorted(r[0] for r in data.select(F.col(c).cast("string")).distinct().limit(MAX_CATEGORIES + 2).collect() if r[0] is not None)
        if len(found) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} values")
        lists.append(found)
    model = BoostedTrees(list(columns), list(categorical), bin_edges(data, columns, bins), lists)
    sizes, width = model.sizes(), max(model.sizes())
    edges = [np.array(e) for e in model.edges]
    codes = [{v: i + 1 for i, v in enumerate(values)} for values in model.values]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, c in enumerate(model.columns):
                x = batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(float)
                found.append(np.where(np.isnan(x), 0, 1 + np.searchsorted(edges[i], x, side="left")))
            for i in range(len(codes)):
                found.append(np.array([codes[i].get(v, 0) for v in batch.column(f"c{i}").to_pylist()], dtype=np.int64))
            rows = np.stack(found, axis=1).astype(np.uint16) if found else np.zeros((batch.num_rows, 0), np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([r.tobytes() for r in rows], pa.binary())], ["y", "bins"])
    inputs = data.select(F.col("_y").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
                         *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(categorical)])
    rows = stage(inputs.mapInArrow(binned, "y double, bins binary"), "tree-rows")
    model.base = rows.agg(F.avg("y")).first()[0] or 0.0
    for _ in range(rounds):
        tree = _grow(rows, model, sizes, width, leaves, l1, l2, min_rows)
        for node in tree:
            if node.children is None:
                node.value = learning_rate * leaf_value(node.gradient, node.rows, l1, l2)
        if len(tree) == 1 and tree[0].value == 0.0:
            break  # no split gains anything any more
        model.trees.append(tree)
    return model


def _place(tree: list[Node], bins: np.ndarray) -> np.ndarray:
    """The deepest known node of every row."""
    at = np.zeros(len(bins), dtype=np.int64)
    for i, node in enumerate(tree):  # parents come before children
        if node.children is not None:
            here = np.flatnonzero(at == i)
            at[here] = np.where(node.left_bins[bins[here, node.feature]], *node.children)
    return at


def _histograms(rows: DataFrame, model: BoostedTrees, tree: list[Node], wanted: list[int], width: int) -> None:
    """Fills the histograms of some nodes of a growing tree."""
    columns, base, done = len(model.sizes()), model.base, model.trees
    slot = {node: i for i, node in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n = (np.zeros(len(wanted) * columns * width) for _ in range(2))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint16).reshape(batch.num_rows, columns).astype(np.int64)
            score = np.full(len(bins), base)
            for t in done:
                score += np.array([node.value for node in t])[_place(t, bins)]
            gradient = score - batch.column("y").to_numpy()
            at = np.array([slot.get(i, -1) for i in range(len(tree))])[_place(tree, bins)]
            keep = at >= 0
            cell = ((at[keep, None] * columns + np.arange(columns)) * width + bins[keep]).ravel()
            g += np.bincount(cell, np.repeat(gradient[keep], columns), minlength=len(g))
            n += np.bincount(cell, minlength=len(n))
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells // (columns * width), pa.int32()), pa.array(cells // width % columns, pa.int32()), pa.array(cells % width, pa.int32()),
                                          pa.array(g[cells]), pa.array(n[cells].astype(np.int64))], ["node", "feature", "bin", "g", "n"])
    sums = rows.mapInArrow(run, "node int, feature int, bin int, g double, n long").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).collect()
    gradients, counts = np.zeros((len(wanted), columns, width)), np.zeros((len(wanted), columns, width), dtype=np.int64)
    for r in sums:
        gradients[r.node, r.feature, r.bin], counts[r.node, r.feature, r.bin] = r.g, r.n
    for node, i in slot.items():
        tree[node].histogram = (gradients[i], counts[i])
        tree[node].gradient, tree[node].rows = float(gradients[i, 0].sum()), int(counts[i, 0].sum())


def _grow(rows: DataFrame, model: BoostedTrees, sizes: list[int], width: int, leaves: int, l1: float, l2: float, min_rows: int) -> list[Node]:
    """One tree: the open leaf with the largest gain is split until the limit.

    A job looks one level ahead: it measures the children of all open leaves at once, so a tree of 7 leaves takes about four jobs.
    """
    known, grown = [Node()], [Node()]  # all measured nodes; the tree itself, with numbers of its own
    _histograms(rows, model, known, [0], width)
    place = {0: 0}  # from a leaf of the tree to its measured node
    grown[0].gradient, grown[0].rows = known[0].gradient, known[0].rows

    def consider(i: int) -> None:
        node = known[i]
        found = best_split(node.histogram, sizes, len(model.columns), l1, l2, min_rows)
        if found:
            node.gain, node.feature, node.left_bins = found
    consider(0)
    while len(place) < leaves:
        leaf = max(place, key=lambda i: (known[place[i]].gain, -i))
        split = known[place[leaf]]
        if split.feature is None:
            break
        if split.children is None:
            ahead = [i for i in place.values() if known[i].feature is not None and known[i].children is None]
            for i in ahead:
                known[i].children = (len(known), len(known) + 1)
                known += [Node(known[i].depth + 1, i, True), Node(known[i].depth + 1, i, False)]
            new = [c for i in ahead for c in known[i].children]
            _histograms(rows, model, known, new, width)
            for c in new:
                consider(c)
        at = len(grown)
        grown[leaf].feature, grown[leaf].left_bins, grown[leaf].gain, grown[leaf].children = split.feature, split.left_bins, split.gain, (at, at + 1)
        for child in split.children:
            place[len(grown)] = child
            grown.append(Node(known[child].depth, leaf, child == split.children[0], known[child].gradient, known[child].rows))
        del place[leaf]
    return grown


def predict_leafwise(model: BoostedTrees, features: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """A prediction for every row, as one expression; ``Target`` next to it where it is given."""
    out = features.select(*KEYS, model.prediction().alias("Pred"))
    return out.join(target.select(*KEYS, "Target"), KEYS, "left") if target is not None else out


def split_table(model: BoostedTrees, spark) -> DataFrame:
    """``Tree, Node, Feature, Threshold, NullLeft, Categories, Gain, Rows, Value`` of every node; leaves have no feature."""
    rows = []
    for t, tree in enumerate(model.trees):
        for i, node in enumerate(tree):
            name = threshold = categories = null_left = None
            if node.children is not None:
                numeric = node.feature < len(model.columns)
                name = model.columns[node.feature] if numeric else model.categorical[node.feature - len(model.columns)]
                if numeric:
                    last = int(np.flatnonzero(node.left_bins[1:]).max(initial=-1))
                    threshold = float(model.edges[node.feature][last]) if 0 <= last < len(model.edges[node.feature]) else None
                    null_left = bool(node.left_bins[0])
                else:
                    categories = [v for v, left in zip(model.values[node.feature - len(model.columns)], node.left_bins[1:], strict=True) if left]
            rows.append((t, i, name, threshold, null_left, categories, float(node.gain), int(node.rows), float(node.value)))
    return spark.createDataFrame(rows, "Tree int, Node int, Feature string, Threshold double, NullLeft boolean, Categories array<string>, Gain double, Rows long, Value double")
