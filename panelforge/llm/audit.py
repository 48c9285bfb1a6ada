"""How the filters of a corpus interact: what each removes at each place of each order, from one pass over the texts.

Every document becomes a word of 32 bits, one for each subset of up to five filters; a bit is set where the document survives all
filters of the subset. Positional popcounts of these words, by carry-save addition, give the survivors of every subset in every part
of the corpus and for every label. All figures of all orders are differences of those counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.spread import join_spread
from panelforge.session import stage

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Words of all groups that a task holds before it counts them, and groups whose counters it holds.
HELD_WORDS, HELD_GROUPS = 1 << 20, 1 << 14
#: Fixed values of the thresholds: words, share of distinct words, share of capitals, and the marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails each filter that looks at one text alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(MARKS)}


def failed_filters(docs: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, failed``: the filters a document fails, as bits in the order of ``FILTERS``.

    The last one fails where a row with a smaller doc_id has the same text (by the 256-bit digest). A null text is empty, a null part
    the empty string; a row without doc_id has no earlier copy and is none. Equal rows count once each.
    """
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(fails, 1 << FILTERS.index(name)).otherwise(0) for name, fails in text_failures(text).items()), F.lit(0))
    rows = stage(docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("failed"),
                             F.sha2(text.cast("binary"), 256).alias("digest")), "filter-failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return join_spread(rows, first, ["digest"], rows.count(), "left").select("doc_id", "part", (F.col("failed") + copy).alias("failed"))


def survival_word(failed: Column) -> Column:
    """Bit s is set where none of the failed filters is in subset s."""
    words = [sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)]
    return F.element_at(F.array(*[F.lit(np.uint32(w).view(np.int32).item()) for w in words]), failed + 1)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set.

    A carry-save adder turns three words of one weight into a sum of that weight and a carry of twice the weight; what is left of a
    weight, two words at most, is counted bit by bit.
    """
    counts, places, weight = np.zeros(32, dtype=np.int64), np.arange(32, dtype=np.uint32), 1
    words = words.astype(np.uint32)
    while len(words):
        carries = []
        while (third := len(words) // 3) > 0:
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        counts += weight * ((words[:, None] >> places) & 1).sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def subset_survivors(rows: DataFrame) -> DataFrame:
    """``part, every, good, toxic``: arrays of the survivors of each subset, from rows ``part, good, toxic, word``.

    Tasks add up their words and send 32 counters a group; a part that holds most rows is no larger than others after that.
    """
    names = ["part", "good", "toxic", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        totals: dict[tuple, np.ndarray] = {}
        waiting = 0

        def count() -> None:
            for key, words in held.items():
                totals[key] = totals.get(key, 0) + positional_popcount(np.concatenate(words))
            held.clear()

        def emit() -> pa.RecordBatch:
            keys = list(totals)
            flat = pa.array(np.concatenate([totals[k] for k in keys]) if keys else np.zeros(0, dtype=np.int64))
            counts = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * 32, pa.int32()), flat)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), *(pa.array([bool(k[1] & bit) for k in keys], pa.bool_()) for bit in (1, 2)), counts], names)
            totals.clear()
            return out

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            flags = batch.column("good").to_numpy(zero_copy_only=False) + 2 * batch.column("toxic").to_numpy(zero_copy_only=False)
            group = parts.indices.to_numpy() * 4 + flags
            words = batch.column("word").to_numpy().view(np.uint32)
            order = np.argsort(group, kind="stable")
            values, at = np.unique(group[order], return_index=True)
            for value, some in zip(values.tolist(), np.split(words[order], at[1:]), strict=False):
                held.setdefault((parts.dictionary[value // 4].as_py(), value % 4), []).append(some)
            waiting += len(words)
            if waiting >= HELD_WORDS or len(held) >= HELD_GROUPS:
                count()
                waiting = 0
                if len(totals) >= HELD_GROUPS:
                    yield emit()
        count()
        if totals:
            yield emit()

    counted = rows.select("part", "good", "toxic", "word").mapInArrow(run, "part string, good boolean, toxic boolean, counts array<long>")
    tally = lambda when: F.array(*[F.sum(F.when(when, F.get("counts", s)).otherwise(0)) for s in range(SUBSETS)])
    return counted.groupBy("part").agg(
        tally(F.lit(True)).alias("every"), tally(F.col("good")).alias("good"), tally(F.col("toxic")).alias("toxic"))


def order_figures(survivors: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row for every part, order of the filters and step, from ``subset_survivors``."""
    n, whole = len(filters), (1 << len(filters)) - 1
    steps = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order):
            steps.append(F.struct(
                F.lit("".join(filters[i] for i in order)).alias("filter_order"), F.lit(step + 1).alias("step"), F.lit(f).alias("_f"),
                F.lit(before).alias("_before"), F.lit(before | 1 << f).alias("_after")))
            before |= 1 << f
    at = lambda column, subset: F.get(column, subset if isinstance(subset, Column) else F.lit(subset))

    def shapley(f: int) -> Column:
        """A filter comes after just the filters of a subset in |subset|! (n - 1 - |subset|)! orders."""
        rest = [s for s in range(1 << n) if not s >> f & 1]
        return sum((factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) * (at("every", s) - at("every", s | 1 << f)) for s in rest), F.lit(0))
    per_filter = lambda make: F.array(*[make(f) for f in range(n)])
    rows = survivors.select("*", per_filter(shapley).alias("_shapley"), per_filter(lambda f: at("every", 0) - at("every", 1 << f)).alias("_fails"),
                            per_filter(lambda f: at("every", whole ^ 1 << f) - at("every", whole)).alias("_alone"))
    rows = rows.select("*", F.inline(F.array(*steps)))
    lost = lambda column: at(column, F.col("_before")) - at(column, F.col("_after"))
    return rows.select(
        "part", "filter_order", "step", at("every", F.col("_after")).alias("kept"), lost("every").alias("removed"),
        (F.get("_fails", "_f") - lost("every")).alias("redundant"), F.get("_alone", "_f").alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("_shapley", "_f").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The figures of every part, order and step over whole tables.

    ``labels`` has ``doc_id, quality, toxic``; where an id has several rows, one with the mark is enough, and null ids and marks count
    as none. Rows without a label are in all counts but those of labels. Extra columns of either table are ignored. An empty table
    gives no row. A doc_id or text that holds a third of all rows is spread over the tasks.
    """
    rows = stage(failed_filters(docs, part).select("doc_id", "part", survival_word(F.col("failed")).alias("word")), "filter-words")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    often = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    marked = join_spread(rows, marks.join(often, "doc_id"), ["doc_id"], rows.count(), "left")
    return order_figures(subset_survivors(marked.select("part", "word", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, in every order, and what good and toxic documents go with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return filter_audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed FROM d),
m AS MATERIALIZED (SELECT part, failed, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
                   FROM f LEFT JOIN l USING (doc_id) GROUP BY part, failed),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
             list_sum([CASE WHEN i < step THEN 1 << (ascii(filter_order[i]) - 65) ELSE 0 END for i in range(1, 6)])::BIGINT AS before
      FROM o, unnest(range(1, 6)) AS t(step)),
r AS MATERIALIZED (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (failed & (before | own) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (failed & before = 0 AND failed & own <> 0), 0) AS removed,
             coalesce(sum(n) FILTER (failed & before <> 0 AND failed & own <> 0), 0) AS redundant,
             coalesce(sum(n) FILTER (failed = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER (failed & before = 0 AND failed & own <> 0), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & own <> 0), 0) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, own, before)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
