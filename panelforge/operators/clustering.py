"""Similarity of items, grouping by distance, and recursive clustering."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import linalg as L
from panelforge.session import ensure_checkpoint_dir, stage

BLOCK_ROWS = 2000
#: Blocks of rows that are compared with each other: their number, until one holds BLOCK_BYTES as doubles; bytes of a stored piece.
BLOCKS, BLOCK_BYTES, PIECE_BYTES = 24, 1 << 24, 1 << 18
#: Tasks of a comparison of blocks, and pairs measured at once.
MOST_TASKS, PAIRS_AT_ONCE = 4096, 1 << 16


def agreement_matrix(labels: DataFrame, items: Sequence[str], run: str = "Run", item: str = "Item", label: str = "Label") -> DataFrame:
    """For every two items, in how many runs they carry the same label.

    One row per run with the labels in item order; each task adds up its comparison
    matrices and emits one, so neither a join nor a list of pairs is ever built.
    """
    items = sorted(items)
    k = L.check_dim(len(items))
    pos = F.element_at(F.create_map(*[F.lit(v) for i, n in enumerate(items) for v in (n, i)]), F.col(item))
    rows = labels.filter(F.col(item).isin(items)).groupBy(run).agg(
        F.map_from_entries(F.collect_list(F.struct(pos.alias("p"), F.col(label).cast("long").alias("l")))).alias("_m"))
    rows = rows.select(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.try_element_at("_m", i)).alias("_l"))

    def count(batches):
        total = np.zeros((k, k), dtype="int64")
        for pdf in batches:
            for row in pdf["_l"]:
                x = np.array([np.nan if v is None else v for v in row], dtype=float)
                total += x[:, None] == x[None, :]
        i, j = np.indices((k, k))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": total.ravel()})

    counts = rows.mapInPandas(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("Agreement"))
    names = F.array(*[F.lit(n) for n in items])
    return counts.select(F.get(names, F.col("i").cast("int")).alias("A"), F.get(names, F.col("j").cast("int")).alias("B"), "Agreement")


def mean_agreement(agreement: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean agreement of each item with the other members of its cluster."""
    a = clusters.select(F.col("Item").alias("A"), F.col("Cluster").alias("_ca"))
    b = clusters.select(F.col("Item").alias("B"), F.col("Cluster").alias("_cb"))
    rows = agreement.join(a, "A").join(b, "B").filter((F.col("_ca") == F.col("_cb")) & (F.col("A") != F.col("B")))
    return rows.groupBy(F.col("A").alias("Item"), F.col("_ca").alias("Cluster")).agg(F.avg("Agreement").alias("MeanAgreement"))


def distinct_vectors(items: DataFrame, vec: str = "vector", key: str = "id") -> DataFrame:
    """Exact copies collapse to their smallest id, with their number."""
    return items.groupBy(vec).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def _unpacked(rows) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the stored pieces of one block, along the first coordinate; rows that are not finite are near nothing."""
    ids = np.concatenate([np.asarray(r.ids) for r in rows])
    v = np.concatenate([np.frombuffer(r.v, r.kind).reshape(len(r.ids), -1).astype(float) for r in rows])
    whole = np.isfinite(v).all(1)
    ids, v = ids[whole], v[whole]
    order = np.argsort(v[:, 0], kind="stable") if v.shape[1] else np.arange(len(v))
    return ids[order], v[order]


def _near(left: list, right: list, limit: float):
    """Tables ``a, b, distance`` of the pairs of two blocks, or of one where ``right`` is empty.

    With x' = (x, -|x|^2/2, 1) and y' = (y, 1, -|y|^2/2) the product x'y' is -|x - y|^2/2: one matrix product and one
    comparison a tile, in single precision where its rounding is small beside the limit; what it lets through is
    measured exactly.  Tiles too far apart along the first coordinate are passed over.
    """
    same = not right
    (ids, x), (jds, y) = _unpacked(left), _unpacked(right or left)
    if not len(x) or not len(y) or not x.shape[1]:
        return
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    scale = (x.shape[1] + 8) * (xx.max() + yy.max() + 1)
    kind = "f4" if scale * 2.0 ** -23 <= 0.01 * limit * limit and scale < 1e30 else "f8"
    slack = scale * (2.0 ** -23 if kind == "f4" else 2.0 ** -52)
    xs = np.column_stack([x, -xx / 2, np.ones(len(x))]).astype(kind)
    ys = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), -yy / 2]).astype(kind).T)
    least = -limit * limit / 2 - slack
    for s in range(0, len(x), 512):
        part, far = xs[s:s + 512], x[min(s + 512, len(x)) - 1, 0] + limit
        for t in range(s if same else 0, len(y), 2048):
            if y[t, 0] > far + slack:
                break
            if y[min(t + 2048, len(y)) - 1, 0] < x[s, 0] - limit - slack:
                continue
            at, width = np.flatnonzero(part @ ys[:, t:t + 2048] >= least), min(2048, len(y) - t)
            for k in range(0, len(at), PAIRS_AT_ONCE):
                i, j = np.divmod(at[k:k + PAIRS_AT_ONCE], width)
                i, j = i + s, j + t
                d = np.sqrt(((x[i] - y[j]) ** 2).sum(1))
                ok = (d <= limit) & ((i < j) if same else True)
                if ok.any():
                    a, b = ids[i[ok]], jds[j[ok]]
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "distance": d[ok]})


def pairs_within(items: DataFrame, threshold: float, vec: str = "vector", key: str = "id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of vectors at Euclidean distance up to ``threshold``.

    Spark's range partitioning cuts the rows into blocks along one coordinate direction:
    of about ``block_rows``, but BLOCKS of them at most until a block holds BLOCK_BYTES,
    as every block is sent once to each block it may meet.  Two rows within the
    threshold differ by no more than it in that coordinate, so a block meets the blocks
    after it only as far as the threshold reaches; the pairs of blocks are a table, found
    by one pass over the blocks' ends, and nothing of them passes through the driver.  A
    block travels as packed pieces; a pair of blocks is compared in tiles and its pairs
    leave as they are found.  Where the coordinate separates nothing, the comparisons are
    as many as the pairs of rows, and what is sent is the rows times the blocks.
    """
    rows = items.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v")).filter("v is not null").withColumn("p", F.get("v", 0))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    held = max(1, BLOCK_BYTES // (8 * max(1, size.dim or 1)))
    n_blocks = max(1, min(math.ceil(size.n / block_rows), max(BLOCKS, math.ceil(size.n / held))))
    kind = dict(rows.dtypes)["id"]
    piece = max(1, PIECE_BYTES // (8 * max(1, size.dim or 1)))

    def pack(batches):
        for pdf in batches:
            for s in range(0, len(pdf), piece):
                part = pdf.iloc[s:s + piece]
                v = np.stack([np.asarray(x, dtype=float) for x in part["v"]])
                with np.errstate(over="ignore"):
                    short = v.astype("f4")
                kind = "f4" if np.array_equal(short, v, equal_nan=True) else "f8"
                yield pd.DataFrame({"b": [part["b"].iloc[0]], "lo": [part["p"].min()], "hi": [part["p"].max()], "kind": [kind],
                                    "ids": [part["id"].tolist()], "v": [v.astype(kind).tobytes()]})

    # Stored, so that every later read sees the same blocks.
    ranged = rows.repartitionByRange(n_blocks, "p", "id").withColumn("b", F.spark_partition_id())
    ranged = stage(ranged.mapInPandas(pack, f"b int, lo double, hi double, kind string, ids array<{kind}>, v binary"), "distance-blocks")
    spans = ranged.groupBy("b").agg(F.min("lo").alias("lo"), (F.max("hi") + F.lit(float(threshold) * (1 + 1e-9) + 1e-9)).alias("hi"))
    ends = spans.select(F.inline(F.array(
        F.struct(F.col("lo").alias("at"), F.lit(0).alias("end"), "b"), F.struct(F.col("hi").alias("at"), F.lit(1).alias("end"), "b"))))
    # Two rows a block.
    last = F.max(F.when(F.col("end") == 0, F.col("b"))).over(Window.orderBy("at", "end").rowsBetween(Window.unboundedPreceding, 0))
    near = ends.withColumn("last", last).filter("end = 1").select(F.col("b").alias("x"), F.explode(F.sequence("b", "last")).alias("y"))
    near = near.join(spans.select(F.col("b").alias("y")), "y", "left_semi")
    sides = F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("b")), F.struct(F.lit(1).alias("side"), F.col("y").alias("b"))))
    plan = near.select("x", "y", F.concat_ws("|", "x", "y").alias("pair"), sides).filter("side = 0 or x <> y").drop("x", "y")
    # A task a pair of blocks, on average; which of them are due is dealt as tasks end.
    tasks = min(MOST_TASKS, n_blocks * (n_blocks + 1) // 2)
    routed = ranged.select("b", "kind", "ids", "v").join(plan, "b").drop("b").repartition(tasks, "pair").sortWithinPartitions("pair", "side")
    limit = float(threshold)

    def compare(batches):
        pair, sides = None, ([], [])
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.pair != pair:
                    if pair is not None:
                        yield from _near(*sides, limit)
                    pair, sides = r.pair, ([], [])
                sides[r.side].append(r)
        if pair is not None:
            yield from _near(*sides, limit)

    return routed.mapInPandas(compare, f"a {kind}, b {kind}, distance double")


def connected_groups(nodes: DataFrame, edges: DataFrame, key: str = "id", max_rounds: int = 50) -> DataFrame:
    """Smallest reachable id of every node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): edges are
    rewired towards the smallest neighbour, which keeps hubs from growing and needs
    few rounds.  Lineage is cut with a checkpoint each round.
    """
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct().checkpoint()

    def signature(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = signature(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        kept = down.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
        e = kept.select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).filter("u <> v").distinct().checkpoint()
        after = signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("u").alias(key)).agg(F.min("v").alias("_root"))
    return nodes.select(key).join(roots, key, "left").select(key, F.coalesce("_root", F.col(key)).alias("group"))


def best_clustering(points: DataFrame, candidates: Sequence[int] = (5, 10, 15), vec: str = "vector", seed: int = 42) -> tuple[DataFrame, int]:
    """Cluster for each candidate count and keep the best silhouette."""
    data = points.withColumn("features", array_to_vector(F.col(vec).cast("array<double>"))).persist()
    best, best_score, best_k = None, -2.0, 0
    for k in candidates:
        model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="Cluster").fit(data)
        labelled = model.transform(data)
        if model.summary.k <= 1:
            continue
        score = ClusteringEvaluator(featuresCol="features", predictionCol="Cluster").evaluate(labelled)
        if score > best_score:
            best, best_score, best_k = labelled, score, k
    if best is None:
        best = data.withColumn("Cluster", F.lit(0))
    return best.drop("features"), best_k


def attach_listing(labels: DataFrame, listing: DataFrame) -> DataFrame:
    info = ["CompanyName", "MarketCodeName", "Sector33CodeName", "Sector17CodeName", "ScaleCategory", "Listing"]
    extra = [c for c in labels.columns if c != "Code"]
    return labels.join(listing, "Code", "left").select("Code", *info, *extra)
