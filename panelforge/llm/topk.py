"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more coordinate that brings them all to the same length, so the largest inner product is the nearest neighbour.
Each vector is keyed by its nearest pivot and the ring of its distance to it. A query first looks into the ring it falls into
itself; the k-th best score found bounds the distance of all that can still enter. All rings are then sorted by the least distance
the triangle inequality allows, and searched outwards in three rounds, until no ring can hold a better row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.session import stage

#: Pivots: the vectors with the smallest hashed ids, at most so many.
PIVOTS = 32
#: Rings for each pivot, between its smallest and largest distance over all vectors.
RINGS = 8
#: How many rings, nearest first, are searched after each round; the bounds are drawn tighter in between.
REACH = (1, 16, 64, PIVOTS * RINGS)
#: Vectors in a block of a ring, and queries in a bundle, at most.
BLOCK, BUNDLE = 2048, 256


def scaled_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` with v = floor(1024 x) as integers; vectors that are null or hold a null or non-finite component are left out.

    Rows of another dimension than the most frequent one are refused later by the search.
    """
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 1024.0))
    sound = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(sound & F.col("vec_id").isNotNull()).select("vec_id", x.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _whole(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _distances(rows: np.ndarray, pivots: np.ndarray, longest: float) -> np.ndarray:
    """Distances in the space with the extra coordinate; ``pivots`` have it already."""
    square = (rows**2).sum(axis=1)
    extra = np.sqrt(np.maximum(longest - square, 0.0))
    inner = rows @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]
    return np.sqrt(np.maximum(2 * longest - 2 * inner, 0.0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` the k best other rows of ``vectors``, ties to the smaller id.

    Both have ``vec_id`` and an integer array ``v``. Exact: scores are whole numbers, multiplied in 64 bits where a double could round,
    and bounds are widened by more than rounding. Vectors so long that a score could leave 64 bits are refused, as are vectors of
    different dimensions. Fewer rows than k give fewer results. Repeated rows of ``vectors`` count once each and share their id; a
    query of a repeated id counts once, with the smallest vector.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    stats = vectors.agg(
        F.max(F.aggregate("v", F.lit(0).cast("double"), lambda a, c: a + c.cast("double") * c)).alias("longest"),
        F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high"), F.count(F.lit(1)).alias("n"), F.max(
            F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c.cast("double"))))).alias("most")).first()
    if not stats["n"]:
        return empty
    if stats["low"] != stats["high"]:
        raise ValueError("vectors differ in dimension")
    largest = stats["high"] * (stats["most"] + 1) ** 2
    if largest >= 1 << 62:
        raise ValueError("components are too large for exact 64-bit scores")
    product = _matrix if largest < 1 << 53 else _whole  # exact in doubles, or in integers
    longest = float(stats["longest"]) + 1.0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    base = np.unique(np.array([r.v for r in sample], dtype=np.float64), axis=0)
    pivots = np.hstack([base, np.sqrt(longest - (base**2).sum(axis=1))[:, None]])
    slack = 1e-6 * np.sqrt(longest) + 1e-3

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("v")), pivots, longest)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])],
                    ["vec_id", "v", "pivot", "d"])
    keyed = stage(vectors.mapInArrow(key, "vec_id long, v array<long>, pivot int, d double"), "topk-index")
    span = keyed.groupBy("pivot").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).collect()  # one row a pivot
    low, width, held = np.zeros(len(pivots)), np.ones(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
    for r in span:
        low[r.pivot], width[r.pivot], held[r.pivot] = r.lo, max((r.hi - r.lo) / RINGS, 1e-9), r.n
    table = F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("width")) for a, b in zip(low, width, strict=True)])
    place = F.element_at(table, F.col("pivot") + 1)
    ring = F.least(F.floor((F.col("d") - place["low"]) / place["width"]), F.lit(RINGS - 1)).cast("int")
    # A crowded ring is cut into parts by the hash of the id, so blocks stay small even where many vectors are equal.
    spread = keyed.withColumn("ring", ring)
    crowd = spread.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"))
    parts = {(r.pivot, r.ring): max(1, -(-r.n // BLOCK)) for r in crowd.collect()}  # at most PIVOTS x RINGS rows
    counts = F.create_map(*[F.lit(x) for (p, g), c in sorted(parts.items()) for x in (p * RINGS + g, c)])
    cell = F.col("pivot") * RINGS + F.col("ring")
    blocks = stage(spread.withColumn("_part", F.pmod(F.xxhash64("vec_id", "d"), F.element_at(counts, cell)).cast("int")).groupBy(cell.alias("cell"), "_part").agg(
        F.collect_list(F.struct("vec_id", "v")).alias("rows")).drop("_part"), "topk-blocks")

    def best(frame_queries: pa.Array, frame_rows: pa.Array) -> pd.DataFrame:
        """The k best of one block for one bundle of queries."""
        qid, q = frame_queries.field("vec_id").to_numpy(), product(frame_queries.field("v"))
        rid, r = frame_rows.field("vec_id").to_numpy(), product(frame_rows.field("v"))
        score = (q @ r.T).astype(np.int64)
        score[qid[:, None] == rid[None, :]] = np.iinfo(np.int64).min
        out = []
        for i in range(len(qid)):
            order = np.lexsort((rid, -score[i]))[:k] if len(rid) <= 4 * k else None
            if order is None:
                cut = np.partition(score[i], len(rid) - k)[len(rid) - k]
                few = np.flatnonzero(score[i] >= cut)
                order = few[np.lexsort((rid[few], -score[i][few]))[:k]]
            order = order[score[i][order] > np.iinfo(np.int64).min]
            out.append(pd.DataFrame({"query_id": qid[i], "vec_id": rid[order], "score": score[i][order]}))
        return pd.concat(out, ignore_index=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pandas(best(batch.column("queries")[i].values, batch.column("rows")[i].values), preserve_index=False)

    def visit(wanted: DataFrame) -> DataFrame:
        """Bundles of queries against the blocks of the rings they ask for."""
        bundles = wanted.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(per_cell)).alias("_bundle")).agg(
            F.collect_list(F.struct(F.col("query_id").alias("vec_id"), "v")).alias("queries"))
        found = bundles.join(blocks, "cell").select("queries", "rows").mapInArrow(search, "query_id long, vec_id long, score long")
        return found

    def ranked(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    per_cell = max(1, -(-asked.count() // BUNDLE))

    def nearest_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("v")), pivots, longest)
                gap = np.where(held > 0, np.maximum(0, d - (low + width * RINGS)), np.inf)
                p = np.where(held > 0, d + gap, np.inf).argmin(axis=1)
                own = d[np.arange(len(d)), p]
                g = np.clip((own - low[p]) // width[p], 0, RINGS - 1).astype(int)
                cells = [_filled(int(a), int(b)) for a, b in zip(p, g, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), pa.array(cells, pa.int32())], ["query_id", "v", "cell"])

    filled = np.zeros((len(pivots), RINGS), dtype=bool)
    for p, g in parts:
        filled[p, g] = True

    def _filled(p: int, g: int) -> int:
        """The nearest ring of the pivot that holds anything."""
        there = np.flatnonzero(filled[p])
        return int(p * RINGS + there[np.argmin(np.abs(there - g))])

    start = stage(asked.mapInArrow(nearest_cell, "query_id long, v array<long>, cell int"), "topk-start")
    best_yet = stage(ranked(visit(start)).select("query_id", "vec_id", "score"), "topk-first")

    def annuli(nearest: int, furthest: int) -> DataFrame:
        """The cells of these places in each query's order of distance that the triangle inequality leaves open."""
        edge_lo = low[:, None] + width[:, None] * np.arange(RINGS) - slack
        edge_hi = low[:, None] + width[:, None] * (np.arange(RINGS) + 1) + slack

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _matrix(batch.column("v"))
                square = (q**2).sum(axis=1)
                # The query lies in the plane where the extra coordinate is 0.
                inner = q @ pivots[:, :-1].T
                d = np.sqrt(np.maximum(square[:, None] + longest - 2 * inner, 0.0))[:, :, None]
                gap = np.where(filled[None], np.maximum(np.maximum(edge_lo[None] - d, d - edge_hi[None]), 0.0), np.inf).reshape(len(q), -1)
                gap[np.arange(len(q)), batch.column("cell").to_numpy()] = -1.0  # searched already
                order = np.argsort(gap, axis=1, kind="stable")[:, nearest:furthest]
                worst = batch.column("worst").to_numpy(zero_copy_only=False).astype(float)
                radius = np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum(square + longest - 2 * worst, 0.0))) + slack
                reached = np.take_along_axis(gap, order, axis=1)
                i, at = np.nonzero(np.isfinite(reached) & (reached <= radius[:, None]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array(i)), batch.column("v").take(pa.array(i)), pa.array(order[i, at].astype(np.int32))], ["query_id", "v", "cell"])
        bound = best_yet.groupBy("query_id").agg(F.min("score").alias("_worst"), F.count(F.lit(1)).alias("_n"))
        bounded = start.join(bound, "query_id", "left").withColumn("worst", F.when(F.col("_n") >= k, F.col("_worst"))).select("query_id", "v", "cell", "worst")
        return bounded.mapInArrow(run, "query_id long, v array<long>, cell int")

    for nearest, furthest in zip(REACH[:-1], REACH[1:], strict=True):
        wider = stage(annuli(nearest, furthest), "topk-annuli")
        if not wider.limit(1).count():
            break  # what lies further out is closed as well
        best_yet = stage(ranked(visit(wider).unionByName(best_yet)).select("query_id", "vec_id", "score"), "topk-best")
    return ranked(best_yet).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for every vector whose id is divisible by 100."""
    vectors = scaled_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
