"""Repeated passages of a corpus, found by prefix-free parsing.

A text is cut at rolling-hash triggers into phrases that overlap by one window less a symbol, so every window of the given length
lies in exactly one phrase, and the phrases of equal texts are equal. Equal phrases are settled by their digests alone: all but the
earliest occurrence repeat. What is left is the dictionary, the distinct phrases; those that share a trigger with another one are
compared window by window in ``settle``, which each operator supplies.

Triggers so frequent that they would fill a task are cut into single windows, each a phrase under its own digest. No text is
shuffled but once, by document; the exchange serves the dictionary and the final pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.grams import mix, phrases
from panelforge.llm.sharding import number_rows
from panelforge.session import stage

#: A trigger with more than this share of all phrases is cut into windows (so there are few of them, at any size).
HOT_SHARE = 2.0**-12
#: Distinct phrases with one trigger that are compared in one place, at most; more are cut into windows.
LARGEST_GROUP = 4096
#: Symbols parsed at a time.
PART = 1 << 22

Symbols = Callable[[bytes], np.ndarray]
#: Text of ``count`` symbols of a document from a start; takes what ``Cutter`` made of the whole text.
Cutter = Callable[[bytes], Callable[[int, int], bytes]]
_OUT = pa.schema([("part", pa.int64()), ("h", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_OUT_SQL = "part long, h long, id long, start long, n long"


def identified(docs: DataFrame) -> DataFrame:
    """Adds ``_id``, a long that orders the documents: doc_id itself where it is unique.

    Otherwise the distinct pairs of doc_id (nulls first) and text hash are numbered in order; rows equal in both are one document.
    """
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
    if not odd.limit(1).count():
        return docs.withColumn("_id", F.col("doc_id").cast("long"))
    tied = docs.withColumn("_tie", F.xxhash64("text"))
    keys = stage(tied.select("doc_id", "_tie").distinct(), "document-keys")
    bounds = keys.agg(F.percentile_approx("doc_id", [i / 64 for i in range(1, 64)], 10_000)).first()[0] or []
    bucket = sum((F.when(F.col("doc_id") >= b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    numbered = number_rows(keys, ["doc_id", "_tie"], bucket).withColumnsRenamed({"doc_id": "_key", "_tie": "_key_tie", "row": "_id"})
    return tied.join(numbered, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("_tie") == F.col("_key_tie"))).drop("_key", "_key_tie", "_tie")


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as maximal runs, in order; spans that touch are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    first = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((first[1:], [True]))
    return start[first], end[last]


def _merged_by_document(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((start, ids))
    ids, start, end = ids[order], start[order], end[order]
    if not len(ids):
        return ids, start, end
    edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
    parts = [(merged(start[a:b], end[a:b]), ids[a]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return (np.concatenate([np.full(len(s), i) for (s, _), i in parts]), np.concatenate([s for (s, _), _ in parts]),
            np.concatenate([e for (_, e), _ in parts]))


def _parts(symbols: np.ndarray, length: int, k: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    for at in range(0, max(len(symbols) - length + 1, 0), PART):
        yield at, phrases(symbols[at : at + PART + length - 1], length, k)


def hot_triggers(texts: DataFrame, symbols: Symbols, length: int, k: int) -> np.ndarray:
    """Triggers with more than about ``HOT_SHARE`` of all phrases, 2 / HOT_SHARE at most.

    Every task reports what has half that share of its own phrases; a trigger above the share is above half of it somewhere.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t for raw in batch.column("raw").to_pylist() for _, (_, _, t) in _parts(symbols(raw or b""), length, k)]
            every = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
            values, counts = np.unique(every, return_counts=True)
            often = counts >= max(8, len(every) * HOT_SHARE / 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(values[often].view(np.int64), 0)), pa.array(np.append(counts[often], 0)),
                 pa.array(np.append(np.zeros(int(often.sum()), dtype=np.int64), len(every)))], ["trigger", "n", "seen"])
    counted = stage(texts.mapInArrow(run, "trigger long, n long, seen long"), "hot-triggers")
    total = counted.agg(F.sum("seen")).first()[0] or 0
    least = max(64.0, total * HOT_SHARE / 2)
    kept = counted.filter(F.col("seen") == 0).groupBy("trigger").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(np.array([r.trigger for r in kept.select("trigger").collect()], dtype=np.int64))


def _digests(piece: Callable[[int, int], bytes], starts: list[int], counts: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(piece(s, c)) for s, c in zip(starts, counts, strict=True)), dtype=np.int64).reshape(-1, 2)


def parse(texts: DataFrame, symbols: Symbols, cutter: Cutter, length: int, k: int, hot: np.ndarray) -> DataFrame:
    """Phrases as ``part, h, id, start, n`` (n windows from symbol ``start``).

    What repeats within one batch is settled at once: those rows come out as spans of -n symbols under a ``part`` of their own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = []
            for key, raw in zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                raw = raw or b""
                values = symbols(raw)
                piece = cutter(raw) if len(values) >= length else None
                for at, (starts, counts, triggers) in _parts(values, length, k):
                    starts, triggers = starts + at, triggers.view(np.int64)
                    common = hot[np.minimum(np.searchsorted(hot, triggers), len(hot) - 1)] == triggers if len(hot) else np.zeros(len(triggers), dtype=bool)
                    if common.any():
                        single = np.concatenate([np.arange(s, s + c) for s, c in zip(starts[common], counts[common], strict=True)])
                        d = _digests(piece, single.tolist(), [length] * len(single))
                        rows.append(np.stack([d[:, 0], d[:, 1], np.full(len(d), key), single, np.ones(len(d), dtype=np.int64)]))
                        starts, counts, triggers = starts[~common], counts[~common], triggers[~common]
                    d = _digests(piece, starts.tolist(), (counts + length - 1).tolist())
                    rows.append(np.stack([triggers, d[:, 1], np.full(len(d), key), starts, counts]))
            if not rows:
                continue
            part, h, ids, start, n = np.concatenate(rows, axis=1)
            order = np.lexsort((start, ids, h, part))
            part, h, ids, start, n = part[order], h[order], ids[order], start[order], n[order]
            first = np.concatenate(([True], (part[1:] != part[:-1]) | (h[1:] != h[:-1])))[: len(part)]
            origin = np.flatnonzero(first)[np.cumsum(first) - 1]
            again = ~first & ((ids != ids[origin]) | (start != start[origin]))
            i, a, b = _merged_by_document(ids[again], start[again], start[again] + n[again] + length - 1)
            spread = mix(i.astype(np.uint64) + np.uint64(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                np.concatenate([part[first], spread]), np.concatenate([h[first], np.zeros(len(i), dtype=np.int64)]),
                np.concatenate([ids[first], i]), np.concatenate([start[first], a]), np.concatenate([n[first], a - b]))], schema=_OUT)
    return texts.mapInArrow(run, _OUT_SQL)


def settle_equal_phrases(parsed: DataFrame, length: int) -> DataFrame:
    """Spans (n < 0) that repeat a phrase met earlier, and the distinct phrases (n > 0) whose trigger has several."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_part = at_h = at_id = at_start = None
        waiting: list[np.ndarray] = []  # the only phrase so far of the last trigger
        for batch in batches:
            part, h, ids, start, n = (batch.column(c).to_numpy() for c in ("part", "h", "id", "start", "n"))
            ready = n < 0
            out = [np.stack([part[ready], h[ready], ids[ready], start[ready], n[ready]])]
            part, h, ids, start, n = part[~ready], h[~ready], ids[~ready], start[~ready], n[~ready]
            if len(part):
                head = at_part is not None and part[0] == at_part and h[0] == at_h
                first = np.concatenate(([not head], (part[1:] != part[:-1]) | (h[1:] != h[:-1])))
                origin = np.cumsum(first) - 1
                places = np.flatnonzero(first)
                from_id = np.concatenate((ids[places], [at_id if head else 0]))[origin]
                from_start = np.concatenate((start[places], [at_start if head else 0]))[origin]
                again = ~first & ((ids != from_id) | (start != from_start))
                out.append(np.stack([part[again], h[again], ids[again], start[again], -(n[again] + length - 1)]))
                reps = np.stack([part[first], h[first], ids[first], start[first], n[first]])
                if reps.shape[1]:
                    same = reps[0] == at_part if at_part is not None else np.zeros(reps.shape[1], dtype=bool)
                    if same.any():
                        if waiting:
                            out.append(waiting.pop())
                    values, inverse, counts = np.unique(reps[0], return_inverse=True, return_counts=True)
                    out.append(reps[:, same | (counts[inverse] > 1)])
                    last = reps[0] == reps[0][-1]
                    if not (same.any() and reps[0][-1] == at_part):
                        waiting = [reps[:, last]] if last.sum() == 1 else []
                    at_id, at_start = int(ids[places[-1]]), int(start[places[-1]])
                at_part, at_h = part[-1], h[-1]
            found = np.concatenate(out, axis=1)
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=_OUT)
    return parsed.repartition("part").sortWithinPartitions("part", "h", "id", "start").mapInArrow(run, _OUT_SQL)


_BODY = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])


def phrase_texts(texts: DataFrame, rivals: DataFrame, cutter: Cutter, length: int) -> DataFrame:
    """The text of the dictionary's phrases, ``part, id, start, n, body``; those of overfull triggers as windows by their digests."""
    full = rivals.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGEST_GROUP).select("part", F.lit(True).alias("full"))
    wanted = rivals.join(full, "part", "left").groupBy("id").agg(
        F.collect_list(F.struct("part", "start", "n", F.coalesce("full", F.lit(False)).alias("full"))).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            single: dict[bytes, tuple[int, int, bytes]] = {}
            for key, raw, wanted_here in zip(*(batch.column(c).to_pylist() for c in ("id", "raw", "wanted")), strict=True):
                piece = cutter(raw)
                for w in wanted_here:
                    start, n = w["start"], w["n"]
                    if not w["full"]:
                        out.append((w["part"], key, start, n, piece(start, n + length - 1)))
                        continue
                    for s in range(start, start + n):
                        body = piece(s, length)
                        digest = xxhash.xxh3_128_digest(body)
                        known = single.get(digest)
                        if known is None or (key, s) < known[:2]:
                            single[digest] = (key, s, body)
                            key_known = known
                        else:
                            key_known = (key, s)
                        if key_known is not None and key_known[:2] != single[digest][:2]:
                            out.append((int.from_bytes(digest[:8], "little", signed=True), key_known[0], key_known[1], -length, b""))
            out += [(int.from_bytes(d[:8], "little", signed=True), i, s, 1, body) for d, (i, s, body) in single.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _BODY, strict=True)], schema=_BODY)
    return texts.join(wanted, "id").mapInArrow(run, "part long, id long, start long, n long, body binary")


#: Takes phrases in order (trigger, document, start) as ids, starts, numbers of windows and texts; returns the repeated windows'
#: ids, starts. All phrases of a trigger come together.
Settle = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray]]


def settle_dictionary(bodies: DataFrame, settle: Settle, length: int, chunk: int = 8_000) -> DataFrame:
    """Spans of the windows that an earlier phrase has too, ``id, start, end``."""
    def spans(rows: list[tuple]) -> pa.RecordBatch:
        ready = [r for r in rows if r[3] < 0]
        rows = [r for r in rows if r[3] > 0]
        part, ids, start, n = (np.array([r[c] for r in rows], dtype=np.int64) for c in range(4))
        i, s = settle(part, ids, start, n, [r[4] for r in rows])
        i = np.concatenate([i, np.array([r[1] for r in ready], dtype=np.int64)])
        s = np.concatenate([s, np.array([r[2] for r in ready], dtype=np.int64)])
        i, a, b = _merged_by_document(i, s, s + length)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (i, a, b)], ["id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "start", "n", "body")), strict=True):
                if len(held) >= chunk and row[0] != held[-1][0]:
                    yield spans(held)
                    held = []
                held.append(row)
        if held:
            yield spans(held)
    return bodies.repartition("part").sortWithinPartitions("part", "id", "start").mapInArrow(run, "id long, start long, end long")


def repeated_spans(docs: DataFrame, symbols: Symbols, cutter: Cutter, settle: Settle, length: int, k: int) -> DataFrame:
    """``docs`` with ``_id``, their bytes as ``_raw`` and ``_spans``: what lies in a window of ``length`` symbols that also starts earlier.

    Earlier means in a document before, in order of doc_id, or before in the same one. ``_spans`` may overlap and is null where
    nothing repeats.
    """
    known = identified(docs)
    texts = known.select(F.col("_id").alias("id"), F.col("text").cast("binary").alias("raw"))
    hot = hot_triggers(texts, symbols, length, k)
    settled = stage(settle_equal_phrases(parse(texts, symbols, cutter, length, k, hot), length), "phrases")
    # One exchange of the texts, used twice.
    dealt = known.withColumn("_raw", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))).withColumn(
        "id", F.coalesce(F.col("_id"), F.lit(0))).drop("text", "_id").repartition("id")
    bodies = phrase_texts(dealt.withColumnRenamed("_raw", "raw"), settled.filter("n > 0"), cutter, length)
    spans = settled.filter("n < 0").select("id", "start", (F.col("start") - F.col("n")).alias("end")).unionByName(
        settle_dictionary(bodies, settle, length))
    listed = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    return dealt.join(listed, "id", "left").drop("id")
