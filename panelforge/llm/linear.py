"""What both classifiers share: a bounded sample of labelled documents, and scores computed where the documents are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.columns import put_back, set_aside
from panelforge.llm.grams import sliced


def fold(key: str, folds: int) -> Column:
    """Remainder of the checksum of a key's text; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int) -> DataFrame:
    """``text`` and ``y`` of at most ``limit`` labelled documents, those with the smallest hashed id among all that ``keep`` allows.

    Rows without id or label are left out; contradicting labels of one id count as their larger one. The chosen labels are few
    by construction, so the documents are not shuffled. Of several rows of one id the smallest text counts, so the bound holds
    however often an id is repeated.
    """
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).filter(keep)
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def int_bytes(features: np.ndarray) -> bytes:
    return features.astype(np.int32).tobytes()


def feature_rows(sample: DataFrame, features: Callable[[bytes], np.ndarray], pack: Callable[[np.ndarray], bytes] = int_bytes,
                 slice_rows: int | None = None) -> DataFrame:
    """``y`` and the feature numbers of each sampled document, as bytes; ``slice_rows`` texts are Python objects at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, slice_rows) if slice_rows else batches:
            found = [pack(features(t or b"")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "features"])
    return sample.select("doc_id", F.col("text").cast("binary").alias("text"), "y").mapInArrow(
        run, "doc_id long, y int, features binary")


def fit_in_one_task(rows: DataFrame, fit: Callable[[list[np.ndarray], np.ndarray], dict[str, np.ndarray]],
                    kind: type = np.int32) -> dict[str, np.ndarray]:
    """Train on the bounded sample in one task; only the arrays of the model come back."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id"], kind="stable")
        model = fit([np.frombuffer(b, kind) for b in frame.features], frame.y.to_numpy())
        return pd.DataFrame({"name": list(model), "kind": [str(v.dtype) for v in model.values()], "value": [v.tobytes() for v in model.values()]})
    got = rows.groupBy().applyInPandas(run, "name string, kind string, value binary").collect()
    return {r.name: np.frombuffer(r.value, r.kind) for r in got}


def score_documents(docs: DataFrame, score: Callable[[bytes], float]) -> DataFrame:
    """Adds ``score`` to every row of ``docs``; a null text is scored as the empty one. The model travels with the function.

    Other columns stay, whatever their names; a column ``score`` is replaced.
    """
    plain = set_aside(docs, ["text"])
    rest = plain.columns
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            scores = pa.array([score((t or "").encode()) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [scores], [*rest, "score"])
    return put_back(plain.mapInArrow(run, schema), docs.columns, ["text"], ["score"])
