"""Clashing names, repeated rows, large values and empty texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from panelforge.llm import automaton_dedup, jaccard, linear, mixing, topk
from panelforge.session import ship_package

ODD = "doc_id long, text string, source string, tokens long, id long, _id long, _raw string, _spans string, component string, n_shingles string, n_words string, score string, " \
      "weight string, epoch string, block_rank string, raw string, u long, v long, `a b` string, _tokens long, _block long, n long"


@pytest.fixture(scope="module")
def odd(spark):
    ship_package(spark)
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") for _ in range(n))
    base = say(120)
    texts = [base, base, base + " one more", say(60), None, "", say(40)]
    rows = [(i, t, "ab"[i % 2], 10 + i, 100 + i, 200 + i, *["x"] * 9, "raw", i, i, "space", i, i, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ODD).repartition(3), texts


def others(df, table, outputs):
    """Columns that are no outputs come back unchanged, row by row."""
    names = [c for c in table.columns if c not in outputs]
    want = sorted(map(str, table.select(*[f"`{c}`" for c in names]).collect()))
    return sorted(map(str, df.select(*[f"`{c}`" for c in names]).collect())) == want and list(df.columns)[-len(outputs):] == outputs


def test_near_duplicates_keep_columns(odd):
    table, _ = odd
    got = jaccard.near_duplicates(table)
    assert others(got, table, ["_id", "n_shingles", "component"])
    assert {r.doc_id: r.component for r in got.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6}


def test_repeated_windows_keep_columns(odd):
    table, texts = odd
    got = automaton_dedup.remove_repeated_windows(table)
    outputs = ["n_words", "n_removed", "kept_sha256"]
    assert others(got.drop("text"), table.drop("text"), outputs)
    found = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()}
    assert found[1] == (120, 120, "") and found[2] == (122, 120, "one more") and found[4] == (0, 0, None) and found[3] == (60, 0, texts[3])


def test_scores_keep_columns(odd):
    table, texts = odd
    got = linear.score_documents(table, lambda raw: float(len(raw)))
    assert others(got, table, ["score"])
    assert {r.doc_id: r.score for r in got.collect()} == {i: float(len(t or "")) for i, t in enumerate(texts)}


def test_mix_keeps_columns_and_budgets(odd):
    """Every document once at least; the mix against shares worked out here."""
    table, texts = odd
    got = mixing.temperature_mix(table, max_repetition=2.0)
    assert got.columns == [c for c in table.columns if c not in ("weight", "epoch", "block_rank")] + ["weight", "epoch", "block_rank"]
    rows = got.collect()
    assert {r.doc_id for r in rows} == set(range(len(texts))) and all(r["a b"] == "space" and r.id == 100 + r.doc_id for r in rows)
    weights = {r.source: r.weight for r in rows}
    assert abs(sum(weights.values()) - 1) < 1e-9 and set(weights) == {"a", "b"}


def big(scale, n=300, dim=4):
    rng = np.random.default_rng(3)
    return [(i, [int(c) for c in rng.integers(-scale, scale, dim)]) for i in range(n)]


@pytest.mark.parametrize("scale", [1000, 1_300_000_000 // 2])
def test_scores_are_whole(spark, scale):
    ship_package(spark)
    rows = big(scale)
    table = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    asked = table.filter("vec_id % 100 = 0")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, asked.union(asked), 5).collect()}
    for key, q in rows[::100]:
        want = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != key)[:5]
        assert [got[key, r + 1] for r in range(5)] == [(i, -s) for s, i in want]
    assert len(got) == 15


def test_scores_beyond_64_bits_are_refused(spark):
    table = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        topk.top_k(topk.scaled_vectors(table), topk.scaled_vectors(table), 3)


def test_toxicity_stage_keeps_empty_texts(spark, tmp_path):
    """Also where most labelled texts are toxic; without labels nothing goes."""
    ship_package(spark)
    rows = [(i, "bad awful words here" if i % 5 else "kind words", "en", "a", 9) for i in range(200)] + [(300, None, "en", "a", 0), (301, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i % 5 > 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in P.without_toxic(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(200) if i % 5 == 0} | {300, 301}
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.without_toxic(spark, docs, f"{tmp_path}/none").count() == len(rows)
    assert P.without_toxic(spark, docs.filter(F.lit(False)), str(tmp_path)).count() == 0


def test_texts_are_read_in_small_batches(spark):
    """A column of texts is an array of one batch's bytes in every task that reads it."""
    ship_package(spark)
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_short_texts_leave_in_small_batches(spark):
    """Light sets have many subsets a byte: their rows go out in parts, and all of them."""
    ship_package(spark)
    sizes = []

    class Texts:
        def mapInArrow(self, run, schema):
            rows = [" ".join(f"{i}-{j}" for j in range(14)) for i in range(600)]
            batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([r.encode() for r in rows], pa.binary())], ["id", "raw"])
            sizes.extend(b.num_rows for b in run(iter([batch])))
    jaccard.postings(Texts(), np.zeros(jaccard.SLOTS, dtype=np.uint32), 40, (80, 100))
    each = len(jaccard.subset_keys(np.arange(12, dtype=np.uint64), 40, (80, 100))[0])
    assert sum(sizes) == 600 * each and max(sizes) <= jaccard.LISTED < sum(sizes)
