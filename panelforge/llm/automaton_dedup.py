"""Removal of repeated word windows by suffix automata of reference shards.

The corpus is its own reference. Its distinct passages are dealt to shards by their triggers (see ``repeats``), so a text meets
only the shards that can match it. The automaton of a shard grows in document order: each passage is first streamed through it for
its matching statistics, and where the longest match reaches the threshold the window has started earlier; then it is added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.columns import put_back, set_aside
from panelforge.llm.grams import word_hashes, word_spans
from panelforge.llm.repeats import merged, repeated_spans

#: Words in a window, and in a trigger.
LENGTH, TRIGGER = 20, 4


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def matches(self, symbols: list, least: int) -> list[int]:
        """Ends (exclusive) of the positions where the longest match that ends there has ``least`` symbols or more."""
        step, link, length = self.step, self.link, self.length
        state, size, found = 0, 0, []
        for i, c in enumerate(symbols):
            while c not in step[state] and state:
                state = link[state]
                size = length[state]
            if c in step[state]:
                state, size = step[state][c], size + 1
            if size >= least:
                found.append(i + 1)
        return found

    def add(self, symbols: list) -> None:
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _extend(self, last: int, c: object) -> int:
        step, link, length = self.step, self.link, self.length
        if c in step[last]:
            q = step[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return new

    def _split(self, p: int, q: int, c: object) -> int:
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy


def settle_words(part: np.ndarray, ids: np.ndarray, start: np.ndarray, n: np.ndarray, bodies: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Windows that an earlier passage of the same trigger has; the passages of a trigger come together and in order.

    A document of several rows sends each of its passages once a row; only the first of them counts.
    """
    found_ids, found_starts, shard = [], [], SuffixAutomaton()
    for k, body in enumerate(bodies):
        if k and part[k] == part[k - 1] and ids[k] == ids[k - 1] and start[k] == start[k - 1]:
            continue
        alone = k + 1 == len(bodies) or part[k + 1] != part[k]
        if k and part[k] != part[k - 1]:
            shard = SuffixAutomaton()
        words = body.split(b" ")
        for end in shard.matches(words, length):
            found_ids.append(ids[k])
            found_starts.append(start[k] + end - length)
        if not alone:
            shard.add(words)
    return np.array(found_ids, dtype=np.int64), np.array(found_starts, dtype=np.int64)


def word_cutter(raw: bytes) -> Callable[[int, int], bytes]:
    words = raw.split()
    return lambda start, count: b" ".join(words[start : start + count])


def kept_words(raw: bytes, spans: list[dict] | None) -> tuple[int, np.ndarray]:
    """Number of words, and which stay."""
    n = len(word_spans(raw)[0])
    keep = np.ones(n, dtype=bool)
    if spans:
        for a, b in zip(*merged(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans])), strict=True):
            keep[a:b] = False
    return n, keep


def _original(raw: bytes, keep: np.ndarray) -> bytes:
    """The text itself where all words stay, else its kept stretches as they stand, joined by one space."""
    if keep.all():
        return raw
    starts, ends = word_spans(raw)
    edge = np.diff(np.concatenate(([False], keep, [False])).astype(np.int8))
    return b" ".join(raw[starts[a] : ends[b - 1]] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))


def remove_repeated_windows(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, with_text: bool = True) -> DataFrame:
    """Adds ``n_words, n_removed, kept_sha256`` to every row of ``docs`` and, on demand, replaces ``text`` by what stays of it.

    Every word goes that a window of ``length`` words covers which also starts earlier, in a document of smaller doc_id (nulls come
    first) or before in the same one; words are separated by ASCII white space and compared unchanged. A null text has no words
    and stays null. Rows equal in doc_id and text are one document and share a result; rows of one doc_id with different texts
    are ordered by the texts' hash. The digest is over the kept words joined by one space; the new text keeps the
    white space inside each kept stretch. Other columns stay, whatever their names; one that has the name of an output is replaced.
    """
    plain = set_aside(docs, ["doc_id", "text"]) if with_text else docs.select("doc_id", "text")
    spans = repeated_spans(plain.withColumn("_null", F.col("text").isNull()), word_hashes, word_cutter,
                           lambda p, i, s, n, b: settle_words(p, i, s, n, b, length), length, trigger)
    rest = [c for c in plain.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column("_raw").to_pylist()
            done = [kept_words(raw, found) for raw, found in zip(raws, batch.column("_spans").to_pylist(), strict=True)]
            digests = [hashlib.sha256(b" ".join(np.array(raw.split(), dtype=object)[keep].tolist() if not keep.all() else raw.split())).hexdigest()
                       for raw, (_, keep) in zip(raws, done, strict=True)]
            arrays = [batch.column(c) for c in rest] + [
                pa.array([n for n, _ in done], pa.int64()), pa.array([n - int(keep.sum()) for n, keep in done], pa.int64()),
                pa.array(digests, pa.string())]
            if with_text:
                arrays.append(pa.array([None if none else _original(raw, keep).decode() for raw, none, (_, keep) in zip(
                    raws, batch.column("_null").to_pylist(), done, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*rest, "n_words", "n_removed", "kept_sha256", *["text"] * with_text])
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), *[("text", T.StringType())] * with_text]
    schema = T.StructType([plain.schema[c] for c in rest] + [T.StructField(*field) for field in added])
    done = spans.select(*rest, "_raw", "_spans", "_null").mapInArrow(run, schema)
    return put_back(done, docs.columns, ["doc_id", "text"], ["n_words", "n_removed", "kept_sha256"]) if with_text else done


def op6_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that start earlier."""
    return remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 20], ' ')) AS s FROM d, unnest(range(greatest(len(w) - 19, 0))) AS t(p)),
f AS (SELECT s, min((doc_id, p)) AS first FROM g GROUP BY s HAVING count(*) > 1),
m AS (SELECT DISTINCT g.doc_id, g.p + i AS p FROM g JOIN f USING (s), unnest(range(20)) AS t(i) WHERE (g.doc_id, g.p) <> f.first),
e AS (SELECT doc_id, p, w[p + 1] AS word FROM d, unnest(range(len(w))) AS t(p)),
k AS (SELECT e.doc_id, count(*) AS n_words, count(m.p) AS n_removed, string_agg(CASE WHEN m.p IS NULL THEN word END, ' ' ORDER BY e.p) AS kept
      FROM e LEFT JOIN m ON e.doc_id = m.doc_id AND e.p = m.p GROUP BY e.doc_id)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
