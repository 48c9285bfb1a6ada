"""Hard negatives by inner product from an R-tree packed by sort-tile-recursive order.

Vectors are ordered by label and then tile by tile of the coordinates that vary most, and cut into blocks; each block holds a small
tree of bounding boxes, and the blocks' own boxes form pages above them. A box bounds the inner products with a vector from below and
above, coordinate by coordinate. A search takes the best box first and leaves out boxes outside the score window and boxes strictly
below the k-th score found so far. It runs in two rounds: the most promising blocks of every vector first, which gives a bound, then all
blocks that the bound leaves open.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.session import stage

#: Rows in a block and in a leaf, children of an inner box.
BLOCK, LEAF, CHILDREN = 2048, 64, 8
#: Boxes of blocks in a page, and searched vectors in a bundle, about.
PAGE, BUNDLE = 512, 256
#: Slices of a coordinate across tiles, at most, so there are at most SLICES**2 tiles.
SLICES = 32
#: Blocks a vector searches in the first round.
FIRST = 4
#: Scores lie within this size, so that windows of hundredths stay in 64 bits.
LARGEST = 1 << 56
LOW, HIGH = -(1 << 62), 1 << 62


def scaled_rows(table: DataFrame, scale: int, label: Column) -> DataFrame:
    """``vec_id, label, v`` with v = floor(scale x) as integers.

    Rows with a null id, label or vector, or a null or non-finite component, are left out. Refuses vectors of different dimensions, and
    components so large that a score could pass 2**56. Of several rows of one vec_id the smallest label and vector count.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select("vec_id", label.cast("long").alias("label"), "embedding").filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    held = rows.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"), F.max(
        F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))).alias("most")).first()
    if held.high is not None and held.low != held.high:
        raise ValueError("vectors differ in dimension")
    most = scale * held.most + 1 if held.high else 0
    if held.high and held.high * most * most >= LARGEST:
        raise ValueError("components are too large for exact 64-bit scores")
    whole = rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("long")).alias("v"))
    if rows.groupBy("vec_id").count().filter("count > 1").limit(1).count():
        whole = whole.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.label", "s.v")
    return whole


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _exact(matrix: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Doubles where all products and sums are exact in them, which is faster, else integers."""
    return matrix.astype(np.float64) if exact_in_double else matrix


def bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every vector with any point of every box."""
    above, below = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return above @ low.T + below @ high.T, above @ high.T + below @ low.T


def tile_order(matrix: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Rows in sort-tile-recursive order over the three coordinates that vary most."""
    dims = np.argsort(-matrix.std(axis=0), kind="stable")[:3]
    parts = [np.arange(len(matrix))]
    for turn, dim in enumerate(dims):
        out = []
        for part in parts:
            part = part[np.argsort(matrix[part, dim], kind="stable")]
            leaves = -(-len(part) // leaf)
            slices = max(1, round(leaves ** (1 / (len(dims) - turn)))) if turn < len(dims) - 1 else 1
            width = -(-leaves // slices) * leaf
            out += [part[i : i + width] for i in range(0, len(part), width)]
        parts = out
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


class PackedTree:
    """A block's rows in tile order, with boxes and label ranges of every level, leaves first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, exact_in_double: bool):
        self.ids, self.labels, self.matrix = ids, labels, _exact(matrix, exact_in_double)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        low, high, first, last, step = self.matrix, self.matrix, labels, labels, LEAF
        while not self.levels or len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0)
            first, last, step = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at), CHILDREN
            self.levels.append((low, high, first, last))

    def search(self, key: int, label: int, vector: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, kth: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For every window the best ``(-score, id)``, k at most, of rows with the same (another) label, other than ``key``.

        ``kth`` are scores that k rows elsewhere reach already. Higher scores first, ties by smaller id.
        """
        kth = kth.copy()
        best: list[list[tuple[int, int]]] = [[] for _ in low]
        top = len(self.levels) - 1
        queue: list[tuple[float, int, int]] = []

        def push(level: int, start: int, stop: int) -> None:
            box_low, box_high, first, last = (x[start:stop] for x in self.levels[level])
            least, most = bounds(vector[None], box_low, box_high)
            most, least = most[0], least[0]
            fits = (first <= label) & (label <= last) if same else ~((first == label) & (last == label))
            reach = np.minimum(most[:, None], high)
            open_ = fits[:, None] & (most[:, None] >= low) & (least[:, None] <= high) & (reach >= kth)
            for i in np.flatnonzero(open_.any(axis=1)).tolist():
                heapq.heappush(queue, (-np.where(open_[i], reach[i], LOW).max().item(), level, start + i))

        push(top, 0, len(self.levels[top][0]))
        while queue:
            reach, level, node = heapq.heappop(queue)
            if not (-reach >= kth).any():
                break
            if level:
                push(level - 1, node * CHILDREN, min((node + 1) * CHILDREN, len(self.levels[level - 1][0])))
                continue
            at = slice(node * LEAF, (node + 1) * LEAF)
            scores = self.matrix[at] @ vector
            fits = ((self.labels[at] == label) == same) & (self.ids[at] != key)
            hits = fits & (scores >= np.maximum(low, kth)[:, None]) & (scores <= high[:, None])
            for window in np.flatnonzero(hits.any(axis=1)).tolist():
                some = np.flatnonzero(hits[window])
                found = best[window] + list(zip((-scores[some]).astype(np.int64).tolist(), self.ids[at][some].tolist(), strict=True))
                best[window] = sorted(found)[:k]
                if len(best[window]) == k:
                    kth[window] = max(kth[window], -best[window][-1][0])
        return best


def packed_blocks(rows: DataFrame, kind: str = "<i8") -> DataFrame:
    """The stored index of every row: ``block, page, n, first, last`` (labels), ``low, high`` (box), and ids, labels and rows as bytes.

    ``kind`` is an integer width that holds every component. Tiles come from quantiles of the two coordinates that vary most; rows are dealt by ranges of label, tile, a third coordinate and
    id, so neither a large label nor many equal vectors meet in one task.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, 0.0, 0.0
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v")).astype(np.float64)
                n, total, square = n + len(m), total + m.sum(axis=0), square + (m * m).sum(axis=0)
        if n:
            size = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, n), pa.int64()), pa.array(total), pa.array(square)], ["dim", "n", "total", "square"])
    spreads = rows.select("v").mapInArrow(moments, "dim int, n long, total double, square double").groupBy("dim").agg(
        F.sum("n").alias("n"), (F.sum("square") - F.sum("total") * F.sum("total") / F.sum("n")).alias("spread")).orderBy(F.desc("spread"), "dim").limit(3).collect()
    dims = [r.dim for r in spreads] or [0]
    total = spreads[0].n if spreads else 0
    slices = int(min(SLICES, max(1, round((total / (BLOCK * 4)) ** (1 / 3)))))
    cut = lambda values: sorted(set(values or []))
    x, y, z = (F.get("v", dims[min(i, len(dims) - 1)]) for i in range(3))
    shares = [i / slices for i in range(1, slices)]
    slab, tile = F.lit(0), F.lit(0)
    if shares:
        cuts = cut(rows.agg(F.percentile_approx(x, shares, 10_000)).first()[0])
        slab = sum((F.when(x >= c, 1).otherwise(0) for c in cuts), F.lit(0))
        inner = rows.groupBy(slab.alias("slab")).agg(F.percentile_approx(y, shares, 10_000).alias("cuts")).collect()  # SLICES rows at most
        for r in inner:
            place = sum((F.when(y >= c, 1).otherwise(0) for c in cut(r.cuts)), F.lit(0))
            tile = F.when(slab == r.slab, place).otherwise(tile)
    order = ["label", "_slab", "_tile", "_z", "vec_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block(ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            nonlocal turn
            at = tile_order(m)
            ids, labels, m = ids[at], labels[at], m[at]
            number = (part << 32) + turn
            turn += 1
            one = lambda v, kind: pa.array([v], kind)
            return pa.RecordBatch.from_arrays(
                [one(number, pa.int64()), one((part // (PAGE // 4) << 20) + turn // PAGE, pa.int64()), one(len(ids), pa.int64()), one(int(labels.min()), pa.int64()), one(int(labels.max()), pa.int64()),
                 one(m.min(axis=0).tobytes(), pa.binary()), one(m.max(axis=0).tobytes(), pa.binary()), one(ids.tobytes(), pa.binary()),
                 one(labels.tobytes(), pa.binary()), one(m.astype(kind).tobytes(), pa.binary())], ["block", "page", "n", "first", "last", "low", "high", "ids", "labels", "rows"])

        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("v"))))
            waiting += batch.num_rows
            while waiting >= BLOCK:
                every = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield block(*(c[:BLOCK] for c in every))
                held[:] = [tuple(c[BLOCK:] for c in every)]
                waiting -= BLOCK
        if waiting:
            yield block(*(np.concatenate(c) for c in zip(*held, strict=True)))
    dealt = rows.select("vec_id", "label", "v", slab.alias("_slab"), tile.alias("_tile"), z.alias("_z"))
    # About four blocks a task.
    dealt = dealt.repartitionByRange(max(1, -(-total // (4 * BLOCK))), *order).sortWithinPartitions(*order).select("vec_id", "label", "v")
    schema = "block long, page long, n long, first long, last long, low binary, high binary, ids binary, labels binary, rows binary"
    return stage(dealt.mapInArrow(pack, schema), "rtree-blocks")


def _ints(raw: bytes, width: int | None = None, kind: str = "<i8") -> np.ndarray:
    found = np.frombuffer(raw, dtype=kind).astype(np.int64, copy=False)
    return found if width is None else found.reshape(-1, width)


def window_search(queries: DataFrame, blocks: DataFrame, k: int, same: bool, exact_in_double: bool, kind: str = "<i8") -> DataFrame:
    """``vec_id, slot, rank, other, score``: for every window of every query the k best rows of the same (another) label.

    ``queries`` has one row a ``vec_id``, with ``label``, ``v`` and arrays ``low`` and ``high``, a window each. Exact: each pair of
    query and block is searched or left out by a bound.
    """
    bundles_held = max(1, -(-queries.count() // BUNDLE))
    bundle = F.pmod(F.xxhash64("vec_id"), F.lit(bundles_held)).cast("int")

    def bundled(rows: DataFrame, name: str) -> DataFrame:
        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("vec_id")
            flat = lambda c: np.concatenate([np.asarray(v, dtype=np.int64) for v in frame[c]]).tobytes()
            return pd.DataFrame([{
                "bundle": frame["bundle"].iloc[0], "qids": frame.vec_id.to_numpy(np.int64).tobytes(), "qlabels": frame.label.to_numpy(np.int64).tobytes(), "qv": flat("v"),
                "sizes": np.array([len(v) for v in frame["low"]], dtype=np.int64).tobytes(), "qlow": flat("low"), "qhigh": flat("high"), "qkth": flat("kth"),
                "qseen": np.array([[*v, *[-1] * (FIRST - len(v))] for v in frame["seen"]], dtype=np.int64).tobytes()}])
        schema = "bundle int, qids binary, qlabels binary, qv binary, sizes binary, qlow binary, qhigh binary, qkth binary, qseen binary"
        return stage(rows.withColumn("bundle", bundle).groupBy("bundle").applyInPandas(pack, schema), name)

    pages = blocks.groupBy("page").agg(F.collect_list(F.struct("block", "first", "last", "low", "high")).alias("boxes"))

    def unpacked(row: dict) -> tuple:
        ids, labels, sizes = (_ints(row[c]) for c in ("qids", "qlabels", "sizes"))
        ends = np.cumsum(sizes)
        windows = [tuple(_ints(row[c])[e - s : e] for c in ("qlow", "qhigh", "qkth")) for s, e in zip(sizes, ends, strict=True)]
        return ids, labels, _exact(_ints(row["qv"]).reshape(len(ids), -1), exact_in_double), windows, _ints(row["qseen"], FIRST)

    def open_boxes(row: dict) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """Query, its label and vector's place, and for each box of the page how far it reaches into a window; LOW where it is closed."""
        ids, labels, vectors, windows, seen = unpacked(row)
        boxes = row["boxes"]
        numbers, first, last = (np.array([b[c] for b in boxes], dtype=np.int64) for c in ("block", "first", "last"))
        low, high = (_exact(np.stack([_ints(b[c]) for b in boxes]), exact_in_double) for c in ("low", "high"))
        least, most = bounds(vectors, low, high)
        for i, key in enumerate(ids.tolist()):
            fits = (first <= labels[i]) & (labels[i] <= last) if same else ~((first == labels[i]) & (last == labels[i]))
            w_low, w_high, kth = (w[:, None] for w in windows[i])
            reach = np.minimum(most[i], w_high)
            ok = fits & (most[i] >= w_low) & (least[i] <= w_high) & (reach >= kth) & ~np.isin(numbers, seen[i])
            yield key, numbers, np.where(ok, reach, LOW).max(axis=0, initial=LOW)

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = []
                for key, numbers, reach in open_boxes(row):
                    best = [j for j in np.lexsort((numbers, -reach))[:FIRST] if reach[j] > LOW]
                    out += [(row["bundle"], key, int(numbers[j]), float(reach[j])) for j in best]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["bundle", "vec_id", "block", "reach"])

    def still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                wanted: dict[int, list[int]] = {}
                for key, numbers, reach in open_boxes(row):
                    for number in numbers[reach > LOW].tolist():
                        wanted.setdefault(number, []).append(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["bundle"]] * len(wanted), pa.int32()), pa.array(list(wanted), pa.int64()), pa.array(list(wanted.values()), pa.list_(pa.int64()))], ["bundle", "block", "wanted"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, number = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] != number:
                    ids, number = _ints(row["ids"]), row["block"]
                    tree = PackedTree(ids, _ints(row["labels"]), _ints(row["rows"], kind=kind).reshape(len(ids), -1), exact_in_double)
                keys, labels, vectors, windows, _ = unpacked(row)
                out = []
                for at in np.searchsorted(keys, np.sort(np.array(row["wanted"], dtype=np.int64))).tolist():
                    found = tree.search(int(keys[at]), int(labels[at]), vectors[at], same, *windows[at], k)
                    out += [(int(keys[at]), slot, other, -score) for slot, rows in enumerate(found) for score, other in rows]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["vec_id", "slot", "other", "score"])

    def paired(bundles: DataFrame) -> DataFrame:
        """Every bundle with every page of boxes."""
        return pages.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles_held - 1)))).join(bundles, "bundle")

    def searched(pairs: DataFrame, bundles: DataFrame) -> DataFrame:
        return pairs.join(bundles, "bundle").join(blocks.select("block", "ids", "labels", "rows"), "block").mapInArrow(
            visit, "vec_id long, slot int, other long, score long")

    def ranked(found: DataFrame) -> DataFrame:
        turn = Window.partitionBy("vec_id", "slot").orderBy(F.desc("score"), "other")
        return found.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)

    none = F.transform("low", lambda _: F.lit(LOW))
    start = bundled(queries.select("vec_id", "label", "v", "low", "high", none.alias("kth"), F.array().cast("array<long>").alias("seen")), "rtree-queries")
    near = paired(start).mapInArrow(promising, "bundle int, vec_id long, block long, reach double")
    turn = Window.partitionBy("vec_id").orderBy(F.desc("reach"), "block")
    near = stage(near.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= FIRST).select("bundle", "vec_id", "block"), "rtree-nearest")
    first = stage(ranked(searched(near.groupBy("bundle", "block").agg(F.collect_list("vec_id").alias("wanted")), start)).select("vec_id", "slot", "other", "score"), "rtree-first")
    full = first.groupBy("vec_id", "slot").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    full = full.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "worst"))).alias("_worst"))
    seen = near.groupBy("vec_id").agg(F.collect_list("block").alias("_seen"))  # FIRST at most
    bounded = queries.join(full, "vec_id", "left").join(seen, "vec_id", "left")
    kth = F.transform("low", lambda _, i: F.coalesce(F.try_element_at("_worst", i), F.lit(LOW)))
    bundles = bundled(bounded.select("vec_id", "label", "v", "low", "high", kth.alias("kth"), F.coalesce("_seen", F.array().cast("array<long>")).alias("seen")), "rtree-bounded")
    rest = stage(paired(bundles).mapInArrow(still_open, "bundle int, block long, wanted array<long>"), "rtree-open")
    return ranked(first.unionByName(searched(rest, bundles))).select("vec_id", "slot", "rank", "other", "score")


def _floor_hundredths(column: str, hundredths: int) -> Column:
    """The integer part, downwards, of so many hundredths of an integer column."""
    return F.expr(f"({hundredths} * {column} - pmod({hundredths} * {column}, 100L)) div 100L")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and each of its positives.

    ``rows`` and ``anchors`` are as ``scaled_rows`` makes them, anchors a part of the rows. An anchor's positives are its best other rows
    of the same label; the negatives are the best rows of other labels whose score lies between ``least`` and ``most`` hundredths of
    the positive's. Fewer, where there are fewer; none for a positive with a negative score. Ties go to the smaller id. An empty table
    gives no row; other columns are ignored.
    """
    held = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("most")).first()
    largest = int(held.most or 0)
    in_double = (held.dim or 0) * (largest + 1) ** 2 < 1 << 53
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if largest < (1 << bits) - 1)
    blocks = packed_blocks(rows, kind)
    every = F.array(F.lit(LOW)), F.array(F.lit(HIGH))
    best = stage(window_search(anchors.select("vec_id", "label", "v", every[0].alias("low"), every[1].alias("high")), blocks, positives, True, in_double, kind), "hard-positives")
    best = best.select("vec_id", (F.col("rank") - 1).cast("int").alias("slot"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    low, high = -_floor_hundredths("positive_score", -least), _floor_hundredths("positive_score", most)
    windows = best.select("vec_id", F.struct("slot", F.when(low <= high, low).otherwise(HIGH).alias("low"), F.when(low <= high, high).otherwise(LOW).alias("high")).alias("w"))
    windows = windows.groupBy("vec_id").agg(F.sort_array(F.collect_list("w")).alias("w")).select("vec_id", "w.low", "w.high")  # one a positive
    found = window_search(anchors.select("vec_id", "label", "v").join(windows, "vec_id"), blocks, negatives, False, in_double, kind)
    return best.join(found, ["vec_id", "slot"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every vector whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stage(scaled_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 256, label), "rtree-rows")
    return hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


OP13_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""
