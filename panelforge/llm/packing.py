"""Packing of tokenised documents into sequences: best fit, then swaps and moves between underfull bins.

Pieces are packed in groups of a few thousand that Spark deals out evenly, so the work is spread and no task's share grows.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.session import stage

CAPACITY = 2048
#: Pieces packed together, on average.
GROUP = 4096
#: Appended to every document.
SEPARATOR = 0


@lru_cache(maxsize=2)
def _encoders(vocabulary: str, ranks: str | None, pattern: str | None):
    """The tokenizer, its special strings, and a faster encoder with the same ranks for texts without those strings."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if ranks is None:
        return tokenizer, special, None
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tokenizer, special, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_ids(text: str, vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> np.ndarray:
    """Ids of a text without added special tokens, then the separator."""
    tokenizer, special, fast = _encoders(vocabulary, ranks, pattern)
    if fast is None or any(s in text for s in special):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
    else:
        ids = np.asarray(fast.encode_to_numpy(text), dtype="<u4")
    return np.append(ids, np.array([SEPARATOR], dtype="<u4"))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full length but perhaps the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for every piece of every row; null texts are empty and give one separator."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = token_ids(text or "", vocabulary, ranks, pattern)
                out += [(key, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, KINDS, strict=True)], schema=SCHEMA)
    KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    SCHEMA = pa.schema(list(zip(["doc_id", "piece", "start", "length", "ids_crc32"], KINDS, strict=True)))
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indexes: longest first, each into the fullest bin it fits."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s: some bin has s left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
            bins[b].append(i)
        else:
            b, space = len(bins), capacity
            bins.append([i])
        by_space[space - size].append(b)
        spaces |= 1 << (space - size)
    return bins


def empty_bins(bins: list[list[int]], lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Local search: take weight out of the emptiest bin until it is empty, then go on with the next.

    A step moves a piece to a bin with room, or exchanges one or two pieces of a bin for a shorter one elsewhere; the emptiest bin
    that has such a step takes it, which gathers the room. Every step increases the sum of squared fills, so the search ends: when
    no step of any bin increases it, or when the pieces cannot fit into fewer bins.
    """
    bins = [list(b) for b in bins]
    size = np.asarray(lengths)
    fill = np.array([int(size[b].sum()) for b in bins], dtype=np.int64)
    least = -(-int(size.sum()) // capacity)
    while int((fill > 0).sum()) > least and _step(bins, size, fill, capacity):
        pass
    return [b for b in bins if b]


def _step(bins: list[list[int]], size: np.ndarray, fill: np.ndarray, capacity: int) -> bool:
    """One move or exchange that increases the sum of squared fills; full bins can have no part in one."""
    bare = np.flatnonzero((fill > 0) & (fill < capacity))
    bare = bare[np.argsort(fill[bare], kind="stable")]
    if not len(bare):
        return False
    held = np.concatenate([np.asarray(bins[b]) for b in bare])
    home = np.repeat(bare, [len(bins[b]) for b in bare])
    width, room, level = size[held], capacity - fill[home], fill[home]
    for e in bare.tolist():
        kinds, at, often = np.unique(size[bins[e]], return_index=True, return_counts=True)
        places = [[i for i in bins[e] if size[i] == v][:2] for v in kinds[often > 1]]
        for i in (bins[e][k] for k in at[::-1]):  # the longest piece that fits somewhere, into the tightest place
            fits = bare[(capacity - fill[bare] >= size[i]) & (fill[bare] + size[i] > fill[e]) & (bare != e)]
            if len(fits):
                _exchange(bins, size, fill, e, int(fits[-1]), [i])
                return True
        # Equal pieces stand for each other, so a bin has few offers: at most 63 lengths, and their pairs.
        offers = [(bins[e][k],) for k in at] + [(bins[e][at[i]], bins[e][at[j]]) for i in range(len(at)) for j in range(i)] + [tuple(p) for p in places]
        weights, which = np.unique([sum(int(size[i]) for i in offer) for offer in offers], return_index=True)
        heaviest = np.searchsorted(weights, width + room, "right") - 1
        gain = np.where(heaviest >= 0, weights[heaviest], 0) - width
        gain[(home == e) | (level + gain <= fill[e])] = 0
        best = int(np.argmax(gain))
        if gain[best] > 0:
            _exchange(bins, size, fill, e, int(home[best]), list(offers[which[heaviest[best]]]), int(held[best]))
            return True
    return False


def _exchange(bins: list[list[int]], size: np.ndarray, fill: np.ndarray, e: int, b: int, given: list[int], taken: int | None = None) -> None:
    """Pieces of bin ``e`` go to bin ``b``, at most one comes back."""
    for i in given:
        bins[e].remove(i)
        bins[b].append(i)
    if taken is not None:
        bins[b].remove(taken)
        bins[e].append(taken)
    gain = sum(int(size[i]) for i in given) - (int(size[taken]) if taken is not None else 0)
    fill[e] -= gain
    fill[b] += gain


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 .. ``capacity``; every row is a piece of its own.

    Full pieces are sequences of their own (negative ids). ``pieces`` should be a stored table, as rows are dealt by their place.
    """
    numbered = pieces.withColumn("_at", F.monotonically_increasing_id())
    full = numbered.filter(F.col("length") >= capacity).select(*pieces.columns, (-1 - F.col("_at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = numbered.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group))
    dealt = short.withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    columns = pieces.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_at", kind="stable").reset_index(drop=True)
        lengths = frame["length"].to_numpy()
        sequence, offset = np.zeros(len(frame), dtype=np.int64), np.zeros(len(frame), dtype=np.int64)
        for b, members in enumerate(empty_bins(best_fit(lengths, capacity), lengths, capacity)):
            sequence[members] = int(frame["_group"].iloc[0]) * (1 << 24) + b
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return frame.assign(sequence_id=sequence, offset=offset)[[*columns, "sequence_id", "offset"]]
    return dealt.groupBy("_group").applyInPandas(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """All rows of ``docs`` in sequences of at most 2048 tokens, one row a piece.

    Null and empty texts give one piece of one separator. Repeated rows, also of one doc_id, are packed as often as they occur.
    Other columns are dropped. An empty table gives no piece.
    """
    return pack_pieces(stage(token_pieces(docs, vocabulary, ranks, pattern), "pieces"))


def public_vocabulary() -> dict[str, str]:
    """Where the public 50k byte-level tokenizer is installed."""
    import public_tokenizers

    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), **public_vocabulary())
