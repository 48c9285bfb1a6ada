"""Near-duplicate documents by a size-aware join of their shingle sets.

Two sets are linked when their Jaccard similarity reaches a threshold. Sets up to a boundary are light: each enumerates its subsets
of exactly the size that it must share with a partner of a given size, and equal subsets are links at once. Larger sets are heavy:
the lists of their rarest shingles are scanned and candidates compared in full. The boundary minimises the cost of both over the
sizes that occur. Sets that are equal are joined by their digests first.

Only connectedness is wanted, so a list is first linked to its most central member; afterwards only members of different
components are compared, all of them, so no link that matters is lost and crowded lists cost no square.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.columns import put_back, set_aside
from panelforge.llm.grams import BASE, mix, rolled, sliced, word_hashes
from panelforge.llm.repeats import identified
from panelforge.llm.spread import components, heavy_limit, join_spread
from panelforge.session import stage

SHINGLE = 3
#: Similarity as a fraction.
LEAST = (90, 100)
#: Counters of the sketch that orders shingles by frequency, and counters sent together.
SLOTS, BLOCK = 1 << 22, 1 << 14
#: Places of the filter that keeps texts without a candidate out of the shuffle; a row of it holds 64, so there are 2**20 rows at most.
PLACES = 1 << 26
#: Parities that a set keeps at least; a larger set keeps one a member, rounded up to a power of two.
MARKS = 512
#: Rows of the lists that leave a worker together.
LISTED = 1 << 14
#: Sets larger than this are never light.
LARGEST_LIGHT = 40


def shingles(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``width`` words, A-Z lower-cased; of the whole sequence if there are fewer words."""
    words = word_hashes(raw.lower())
    if len(words) >= width:
        return np.unique(mix(rolled(words, width)))
    return mix(rolled(words, len(words)) + np.uint64(len(words))) if len(words) else words


def slots(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(42)).astype(np.int64)


def marks(values: np.ndarray) -> np.ndarray:
    """Whether the members at each place are odd in number, 64 places to an integer. Where two sets differ in d members, d places do at most."""
    n = max(MARKS, 1 << max(len(values) - 1, 0).bit_length())
    odd = np.bincount((values & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def odd_places(left: str, right: str) -> Column:
    """Places at which two columns of ``marks`` differ; one of twice the length is folded first, null for other lengths."""
    def folded(x: Column, size: Column) -> Column:
        return F.when(F.size(x) == size, x).when(F.size(x) == 2 * size, F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda u, v: u.bitwiseXOR(v)))
    size = F.least(F.size(left), F.size(right))
    differ = F.zip_with(folded(F.col(left), size), folded(F.col(right), size), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(differ, F.lit(0), lambda total, x: total + x)


def overlap(a: Column | int, b: Column | int, least: tuple[int, int] = LEAST):
    """Smallest common part of sets of two sizes that are linked: s / (1 + s) of both sizes, rounded up."""
    up, down = least
    total = up * (a + b)
    return F.ceil(total / F.lit(up + down)) if isinstance(total, Column) else -(-total // (up + down))


def prefix(n: int, least: tuple[int, int] = LEAST) -> int:
    """Rarest members of a set of ``n`` of which a linked set has at least one."""
    return n - -(-least[0] * n // least[1]) + 1


def partners(n: int, least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """Sizes a set of ``n`` can be linked to, and the members of its own that a link may lack; equal sets are left out."""
    up, down = least
    found = [(t, n - overlap(n, t, least)) for t in range(-(-up * n // down), n * down // up + 1)]
    return [(t, lack) for t, lack in found if lack >= 0 and (lack or t != n) and overlap(n, t, least) <= t]


def light_cost(n: int, least: tuple[int, int] = LEAST) -> int:
    return sum(comb(n, lack) for _, lack in partners(n, least))


def boundary(sizes: dict[int, int], least: tuple[int, int] = LEAST) -> int:
    """The largest light size: subsets written against list entries written and one comparison of all members, over all sets."""
    costs, total = {0: 0}, 0
    for n in range(1, LARGEST_LIGHT + 1):
        total += sizes.get(n, 0) * (light_cost(n, least) - prefix(n, least) - n)
        costs[n] = total
    return min(costs, key=lambda n: (costs[n], -n))


def subset_keys(values: np.ndarray, light: int, least: tuple[int, int] = LEAST) -> tuple[list[int], list[int]]:
    """Hashes of a light set's subsets under the sizes of both partners, and this set's role: 0 smaller, 1 larger, 2 of equal size."""
    n, keys, roles = len(values), [], []
    every = int(values.sum(dtype=np.uint64))
    members = values.tolist()
    for t, lack in partners(n, least):
        if t > light:
            continue
        left = np.array([(every - sum(gone)) % 2**64 for gone in combinations(members, lack)], dtype=np.uint64)
        low, high = min(n, t), max(n, t)
        keys += mix(left * BASE + np.uint64(low * 4096 + high)).view(np.int64).tolist()
        roles += [2 if n == t else int(n > t)] * len(left)
    return keys, roles


def set_sizes(texts: DataFrame, width: int = SHINGLE) -> tuple[DataFrame, np.ndarray]:
    """``id, n, s1, s2, marks`` (size, digest and parities of the set) of every document, and the sketch of all shingles' frequencies.

    The sketch has 2**22 counters whatever the input.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int32)  # of one task
        for batch in sliced(batches):
            sets = [shingles(raw or b"", width) for raw in batch.column("raw").to_pylist()]
            values, times = np.unique(slots(np.concatenate(sets)), return_counts=True)
            counts[values] += times.astype(np.int32)
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                 pa.array([marks(s) for s in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], NAMES)
        n = SLOTS // BLOCK
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.list_(pa.int64())), pa.array(np.arange(n, dtype=np.int32)), pa.array([zlib.compress(c.tobytes(), 1) for c in counts.reshape(n, BLOCK)], pa.binary())], NAMES)
    NAMES = ["id", "n", "s1", "s2", "marks", "block", "counts"]
    found = stage(texts.mapInArrow(run, "id long, n long, s1 long, s2 long, marks array<long>, block int, counts binary"), "shingle-sets")

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BLOCK, dtype=np.int64)
        for frame in frames:
            for c in frame["counts"]:
                total += np.frombuffer(zlib.decompress(c), dtype=np.int32)
        yield pd.DataFrame({"block": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})
    blocks = found.filter("block is not null").groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    sketch = np.zeros(SLOTS, dtype=np.uint32)
    for b in blocks:
        sketch[b.block * BLOCK : (b.block + 1) * BLOCK] = np.minimum(np.frombuffer(zlib.decompress(b.counts), dtype=np.int64), 2**32 - 1)
    return found.filter("block is null").select("id", "n", "s1", "s2", "marks"), sketch


def postings(texts: DataFrame, sketch: np.ndarray, light: int, least: tuple[int, int] = LEAST, width: int = SHINGLE) -> DataFrame:
    """``key, id, n, pos, role``: rarest shingles of heavy sets (role -1, pos from 0) and subsets of light ones.

    Of equal sets in one batch only the first is listed. Sets light enough to match a heavy one are listed in both ways.
    """
    low = -(-least[0] * (light + 1) // least[1])
    # In 64 steps an octave, which keeps small counts apart: any order that all sets share will do, and two bytes a counter travel lightly.
    rare = np.minimum(np.round(64 * np.log2(1.0 + sketch)), 65535).astype(np.uint16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            keys, ids, sizes, places, roles = [], [], [], [], []
            for key, raw in sorted(zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist(), strict=True), key=lambda r: r[0]):
                found = shingles(raw or b"", width)
                n, digest = len(found), xxhash.xxh3_128_digest(found.tobytes())
                if not n or digest in seen:
                    continue
                seen.add(digest)
                if n <= light:
                    k, r = subset_keys(found, light, least)
                    keys.append(np.array(k, dtype=np.int64))
                    roles.append(np.array(r, dtype=np.int32))
                    places.append(np.zeros(len(k), dtype=np.int32))
                    ids.append(np.full(len(k), key))
                    sizes.append(np.full(len(k), n))
                if n >= low:
                    p = prefix(n, least)
                    order = (rare[slots(found)].astype(np.uint64) << np.uint64(48)) | (found >> np.uint64(16))
                    first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                    first = first[np.argsort(order[first], kind="stable")]
                    keys.append(found[first].view(np.int64))
                    roles.append(np.full(len(first), -1, dtype=np.int32))
                    places.append(np.arange(len(first), dtype=np.int32))
                    ids.append(np.full(len(first), key))
                    sizes.append(np.full(len(first), n))
            if keys:  # short texts have many subsets a byte
                found = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, ids, sizes, places, roles)], ["key", "id", "n", "pos", "role"])
                yield from sliced([found], LISTED)
    return texts.mapInArrow(run, "key long, id long, n long, pos int, role int")


def light_links(listed: DataFrame) -> DataFrame:
    """``a, b``: every light set with the first partner of its subset; sets that share a subset of the needed size are linked."""
    light = listed.filter("role >= 0").select("key", "id", "role").repartition("key")  # one shuffle for the groups and the join
    first = light.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("id"))).alias(f"_{r}") for r in range(3)])
    mate = F.when(F.col("role") == 0, F.col("_1")).when(F.col("role") == 1, F.col("_0")).otherwise(F.col("_2"))
    return light.join(first, "key").select(F.col("id").alias("a"), mate.alias("b")).filter("b is not null and a <> b")


def _may_link(n: str, pos: str, m: str, other: str, least: tuple[int, int]) -> Column:
    """Sizes fit, and enough members follow the shared one in both sets."""
    up, down = least
    n, pos, m, other = map(F.col, (n, pos, m, other))
    return (down * F.least(n, m) >= up * F.greatest(n, m)) & (F.least(n - pos, m - other) >= overlap(n, m, least))


def paired(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``a, b, left, right`` with ``column`` of both documents, ordered by ``a`` in runs; ``table`` has one row an ``id``, ``pairs`` is stored.

    Rows that no pair needs on a side are kept out of its shuffle by the places of the ids needed there, of which there are 2**26; what
    passes in error is dropped by the joins. The pairs of an ``a`` with many come in parts of a few hundred, each with its row once more.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(PLACES))

    def needed(side: str) -> DataFrame:
        places = pairs.select(F.col(side).alias("id")).select(F.shiftright(place, 6).alias("_word"), F.pmod(place, F.lit(64)).cast("int").alias("_bit"))
        words = places.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
        return table.join(F.broadcast(words), F.shiftright(place, 6) == F.col("_word")).filter(
            F.getbit("_bits", F.pmod(place, F.lit(64)).cast("int")) == 1).select(F.col("id").alias(side), column)

    limit = heavy_limit(pairs.count())
    hubs = F.broadcast(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)  # 2**12 at most
                       .select("a", F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = needed("a").join(hubs, "a", "left").select("a", F.col(column).alias("left"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    right = needed("b").withColumnRenamed(column, "right")
    split = pairs.select("a", "b").join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("_part"))
    return split.join(right, "b").join(left, ["a", "_part"]).select("a", "b", "left", "right")


def not_apart(pairs: DataFrame, sets: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The pairs whose parities differ at no more places than linked sets may differ in members, and those whose parities do not tell."""
    both = paired(pairs, sets.select("id", F.struct("n", "marks").alias("held")), "held")
    n, m = F.col("left.n"), F.col("right.n")
    return both.filter(F.coalesce(odd_places("left.marks", "right.marks"), F.lit(0)) <= n + m - 2 * overlap(n, m, least)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, least: tuple[int, int] = LEAST, width: int = SHINGLE) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough; ``pairs`` is a stored table, ``sets`` and ``texts`` have one row an id.

    Texts travel only for pairs that are not ruled out by the parities of their sets. The last join sorts by ``a``, so a set is made once a run.
    """
    up, down = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = None, None
        for batch in sliced(batches, 64):
            kept = []
            for i, (key, left, right) in enumerate(zip(*(batch.column(c) for c in ("a", "left", "right")), strict=True)):
                if key.as_py() != known:
                    known, last = key.as_py(), shingles(left.as_py() or b"", width)
                other = shingles(right.as_py() or b"", width)
                common = len(np.intersect1d(last, other, assume_unique=True))
                if down * common >= up * (len(last) + len(other) - common):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(kept, pa.int64())), batch.column("b").take(pa.array(kept, pa.int64()))], ["a", "b"])
    return paired(stage(not_apart(pairs, sets, least), "near-pairs"), texts, "raw").mapInArrow(run, "a long, b long")


def _labels(links: DataFrame) -> DataFrame:
    """An id of the same component for every linked document, after two rounds of taking the smallest neighbour's."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
    two = both.join(one.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("label"))
    return one.withColumnRenamed("label", "_one").join(two, "a").select(F.col("a").alias("id"), F.least("_one", "label").alias("label"))


def heavy_links(listed: DataFrame, sets: DataFrame, texts: DataFrame, least: tuple[int, int] = LEAST, width: int = SHINGLE) -> DataFrame:
    """Links ``a, b`` among sets that share a rare shingle; what is left out lies in one component already."""
    up, down = least
    lists = listed.filter("role = -1").select("key", "id", "n", "pos").repartition("key")
    # Counted by a column of the join below, so that both read the same shuffle.
    heads = lists.groupBy("key").agg(F.min(F.struct("pos", "id")).alias("head"), F.count("n").alias("_n")).filter("_n > 1")
    several = stage(lists.join(heads, "key").select("key", "id", "n", "pos", F.col("head.id").alias("hid")), "shared-shingles")
    star = several.filter("id <> hid").groupBy("id", "n", "hid").agg(F.count(F.lit(1)).alias("_m"))
    star = star.join(sets.select(F.col("id").alias("hid"), F.col("n").alias("hn")).distinct(), "hid")
    # Of two linked sets one has so many of its rarest members in common with the other.
    common = overlap(F.col("n"), F.col("hn"), least) - F.ceil(F.lit(up / down) * F.greatest("n", "hn") - 1e-9) + 1
    star = star.filter((down * F.least("n", "hn") >= up * F.greatest("n", "hn")) & (F.col("_m") >= common))
    turn = Window.partitionBy("id").orderBy(F.desc("_m"), "hid")
    star = stage(star.withColumn("_turn", F.row_number().over(turn)).filter("_turn <= 2").select(F.col("hid").alias("a"), F.col("id").alias("b")), "star-pairs")
    first = stage(verified(star, sets, texts, least, width), "star-links")
    # What is still in several components is compared without regard to the above.
    marked = several.join(_labels(first), "id", "left").select("key", "id", "n", "pos", F.coalesce("label", "id").alias("label"))
    largest = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("_m")).groupBy("key").agg(
        F.max(F.struct("_m", "label")).alias("top"), F.count(F.lit(1)).alias("_labels")).filter("_labels > 1")
    mixed = stage(marked.join(largest.select("key", F.col("top.label").alias("top")), "key"), "mixed-lists")
    x = mixed.filter("label <> top").select("key", F.col("id").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("label").alias("xl"))
    y = mixed.select("key", F.col("id").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("label").alias("yl"), "top")
    small = F.struct("xn", "x") < F.struct("yn", "y")
    # Of two linked sets the smaller one shares one of still fewer, rarer members.
    n, pos = F.when(small, F.col("xn")).otherwise(F.col("yn")), F.when(small, F.col("xp")).otherwise(F.col("yp"))
    near = pos < n - F.ceil(2 * up * n / F.lit(up + down)) + 1
    rest = x.join(y, "key").filter((F.col("xl") != F.col("yl")) & ((F.col("yl") == F.col("top")) | (F.col("x") < F.col("y"))))
    rest = rest.filter(_may_link("xn", "xp", "yn", "yp", least) & near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return first.unionByName(verified(stage(rest, "rest-pairs"), sets, texts, least, width))


def near_duplicates(docs: DataFrame, least: tuple[int, int] = LEAST, width: int = SHINGLE) -> DataFrame:
    """``docs`` with ``_id``, ``n_shingles`` and ``component``: the smallest ``_id`` reachable by links.

    ``_id`` orders documents by doc_id, nulls first (see ``identified``). Null and empty texts, and texts of white space, have no
    shingle and no link. Rows equal in doc_id and text are one document. An empty table gives an empty result. Other columns stay,
    whatever their names; a column that has one of the three names is replaced.
    """
    known = identified(set_aside(docs, ["doc_id", "text"]))
    texts = known.select(F.col("_id").alias("id"), F.col("text").cast("binary").alias("raw"))
    sets, sketch = set_sizes(texts, width)
    held = sets.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids")).first()
    if held.rows > held.ids:  # repeated rows
        texts, sets = texts.groupBy("id").agg(F.first("raw").alias("raw")), sets.dropDuplicates(["id"])
    sizes = {r.n: r["count"] for r in sets.filter(F.col("n").between(1, LARGEST_LIGHT)).groupBy("n").count().collect()}
    listed = stage(postings(texts, sketch, boundary(sizes, least), least, width), "shingle-lists")
    full = sets.filter("n > 0")
    first = full.groupBy("n", "s1", "s2").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    equal = join_spread(full, first, ["n", "s1", "s2"], held.ids).filter("id <> a").select("a", F.col("id").alias("b"))
    links = equal.unionByName(light_links(listed)).unionByName(heavy_links(listed, sets, texts, least, width))
    wide = stage(sets.join(components(sets, links), "id").select(F.col("id").alias("_of"), F.col("n").alias("n_shingles"), "component"), "near-duplicates")
    return put_back(known.join(wide, known["_id"] == wide["_of"]), docs.columns, ["doc_id", "text"], ["_id", "n_shingles", "component"])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 90 % of word triples."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_duplicates(docs).select("doc_id", "_id", "n_shingles", "component")
    return with_component_id(found).select("doc_id", "n_shingles", "component_id")


def with_component_id(found: DataFrame) -> DataFrame:
    """Adds ``component_id``, the doc_id of the component's first document."""
    heads = found.filter("_id = component").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(heads, "component")


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'),
             lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[p + 1:p + 3], ' ')) AS g
       FROM d, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 2, 1) END)) AS t(p)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.v = d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
