"""Document fingerprints by consistent weighted sampling.

For each of 64 samples a term's weight gives a gamma-distributed score and the term with the smallest one is taken, together with
the level its weight reaches. Two texts agree in a sample with a probability equal to their generalised Jaccard similarity.
The gamma and uniform variates of a term are looked up in three tables, each by other bits of the term's hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.grams import mix, rolled, word_hashes

SAMPLES = 64
#: Words in a term; the weight of a term is the number of times it occurs.
SHINGLE = 5
_ROWS = 4096
#: Documents in a range of ids, on average, and ranges at most.
RANGE, RANGES = 512, 65_536


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2010)
    shape = (_ROWS, SAMPLES)
    return (rng.gamma(2.0, 1.0, shape).astype(np.float32), np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32),
            rng.random(shape).astype(np.float32))


def weighted_terms(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of five words (of all words, if there are fewer), and how often each occurs."""
    words = word_hashes(raw)
    if not len(words):
        return words, np.zeros(0, dtype=np.int64)
    return np.unique(mix(rolled(words, min(SHINGLE, len(words)))), return_counts=True)


def signature(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The 64 samples of a weighted set as 16-bit numbers; none for the empty set."""
    if not len(terms):
        return np.zeros(0, dtype=np.uint16)
    rate, log_c, shift = _tables()
    best, chosen = np.full(SAMPLES, np.inf, dtype=np.float32), np.zeros(SAMPLES, dtype=np.uint64)
    for at in range(0, len(terms), 4096):
        h = terms[at : at + 4096]
        r = rate[(h & np.uint64(_ROWS - 1)).astype(np.int64)]
        b = shift[((h >> np.uint64(24)) & np.uint64(_ROWS - 1)).astype(np.int64)]
        score = log_c[((h >> np.uint64(12)) & np.uint64(_ROWS - 1)).astype(np.int64)] - r * (1 - b)
        more = np.flatnonzero(weights[at : at + 4096] > 1)
        level = np.floor(np.log(weights[at : at + 4096][more])[:, None] / r[more] + b[more])
        score[more] -= r[more] * level
        low = score.argmin(axis=0)
        value = score[low, np.arange(SAMPLES)]
        levels = np.zeros(len(h), dtype=np.int64)[low]
        if len(more):
            place = np.searchsorted(more, low)
            hit = (place < len(more)) & (more[np.minimum(place, len(more) - 1)] == low)
            levels[hit] = level[place[hit], np.flatnonzero(hit)].astype(np.int64)
        better = value < best
        best = np.where(better, value, best)
        chosen = np.where(better, mix(h[low] ^ (levels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), chosen)
    return (chosen >> np.uint64(48)).astype(np.uint16)


def fingerprint(raw: bytes) -> np.ndarray:
    return signature(*weighted_terms(raw))


def as_text(samples: np.ndarray) -> str:
    """Four hex digits a sample; the empty string for a text without words."""
    return samples.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples; two texts without words are alike, one without and one with words are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as many first code points of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """``id, text, bucket, peek`` dealt to ranges of doc_id: every row once, and the first of a range also to the range before.

    Only the ranges' bounds and first ids pass through the driver, 65,536 at most; the texts are shuffled once.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).cast("long").alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = keyed.count()
    ranges = max(1, min(RANGES, -(-n // RANGE)))
    bounds = np.zeros(0, dtype=np.int64)
    if ranges > 1:
        bounds = np.unique(np.array(keyed.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0], dtype=np.int64))

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))

    heads = keyed.select("id").withColumn("bucket", bucket("id")).groupBy("bucket").agg(F.min("id").alias("id")).toPandas().sort_values("bucket")
    first = dict(zip(heads["id"].tolist(), np.roll(heads["bucket"].to_numpy(), 1).tolist(), strict=True))

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, ids.to_numpy(), side="right")
        return pd.Series([[int(b), first[i]] if i in first else [int(b)] for b, i in zip(own, ids.tolist(), strict=True)])

    return keyed.select("id", "doc_id", "text", F.posexplode(places("id")).alias("peek", "bucket"))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The next document is the one of the following doc_id, nulls first and rows of one id in order of their texts' hash; the first
    follows the last, and a single document follows itself. Null texts are empty. Equal texts have equal fingerprints. Other
    columns are dropped.
    """
    dealt = with_next(docs).withColumn("tie", F.xxhash64("text")).repartition("bucket").sortWithinPartitions("bucket", "peek", "id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # bucket, doc_id, text, fingerprint of the row that waits for its next
        for batch in batches:
            out: list[tuple] = []
            for bucket, peek, key, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "peek", "doc_id", "text")), strict=True):
                if before is None and peek:
                    continue  # only the first row of the next range is needed
                mark = fingerprint(text.encode())
                if before is not None:
                    _, last_key, last_text, last_mark = before
                    new = edited(last_text, text)
                    new_mark = last_mark if new == last_text else fingerprint(new.encode())
                    out.append((last_key, len(last_text), hashlib.sha256(new.encode()).hexdigest(), as_text(last_mark), as_text(new_mark),
                                likeness(last_mark, new_mark), likeness(last_mark, mark)))
                before = None if peek else (bucket, key, text, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES)
    NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return dealt.select("bucket", "peek", "doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
