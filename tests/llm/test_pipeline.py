"""The corpus pipeline stage by stage on planted cases, and held-out quality of the classifiers."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from panelforge.llm import packing, quality, toxicity
from panelforge.session import ARROW_CONF, ship_package

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """200 clean texts, 20 toxic ones, 12 copies, 4 near copies, 6 texts with one passage, empty and null texts."""
    ship_package(spark)
    rng = random.Random(9)
    say = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(3, 9))) for _ in range(n))
    rows = {i: say(rng.randrange(40, 200)) for i in range(200)}
    rows |= {300 + i: say(20) + " vilefool rotten " + say(20) + " vilefool" for i in range(20)}
    copied, near, passage = say(150), say(200).split(), say(60)
    rows |= {400 + i: copied for i in range(12)}
    rows |= {500 + i: " ".join(near[: 20 * i] + ["changed"] + near[20 * i + 1 :]) for i in range(4)}
    rows |= {600 + i: say(30) + " " + passage + " " + say(30) for i in range(6)}
    rows |= {700: "", 701: None, 702: say(9000)}
    folder = str(tmp_path_factory.mktemp("corpus"))
    table = [(i, t, "en", "abc"[i % 3] if i % 7 else None, len(t or "")) for i, t in rows.items()]
    table += [table[3], table[3]]  # a row three times over
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(300 <= i < 320)) for i in rows if i < 320], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, passage


def test_stages_on_planted_cases(spark, planted):
    folder, rows, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(P.STAGES)
    assert list(steps) == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "packing"]
    clean = steps["toxicity"](spark, docs, folder).cache()
    ids = {r.doc_id for r in clean.select("doc_id").collect()}
    assert ids == {i for i in rows if not 300 <= i < 320} and clean.columns == docs.columns
    one = steps["near_duplicates"](spark, clean, folder).cache()
    kept = Counter(r.doc_id for r in one.select("doc_id").collect())
    assert set(kept) == ids - set(range(401, 412)) - set(range(501, 504)) and set(kept.values()) == {1}
    cut = steps["repeated_passages"](spark, one, folder).cache()
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert set(texts) == set(kept) and sum(passage in (t or "") for t in texts.values()) == 1 and passage in texts[600]
    assert all(len((texts[600 + i]).split()) == 60 for i in range(1, 6)) and texts[701] is None and texts[5] == rows[5]
    assert all(r.n_chars == len(r.text) for r in cut.collect() if r.text is not None)
    mixed = steps["mixing"](spark, cut, folder).cache()
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert set(times) == set(kept) and max(times.values()) <= 2 and mixed.columns == docs.columns
    packed = steps["packing"](spark, mixed, folder).collect()
    check_packing(packed, {r.doc_id: r.text for r in cut.collect()}, times)


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_a_step_alone_has_small_batches(spark, planted, name):
    """A step that is called by itself, in a session that nobody prepared, gives its workers few texts at a time as well."""
    other = spark.newSession()
    for key in ARROW_CONF:
        other.conf.set(key, 1 << 30 if "Bytes" in key else 100_000)
    docs = other.read.parquet(f"{planted[0]}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    dict(P.STAGES)[name](other, docs, planted[0])
    rows = other.range(0, 20_000, 1, 1).withColumn("text", F.repeat(F.lit("word "), 400)).mapInArrow(
        lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long")
    most = rows.agg(F.max("n").alias("n"), F.max("size").alias("size")).first()
    assert most.n <= 1024 and most.size < 2 << 20
    assert int(other.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def check_packing(pieces, texts, times):
    """Every copy of every document whole, every sequence gapless and within its capacity."""
    sizes, lengths, places = defaultdict(int), defaultdict(list), defaultdict(list)
    for p in pieces:
        sizes[p.doc_id] += p.length
        lengths[p.doc_id].append(p.length)
        places[p.sequence_id].append((p.offset, p.length))
    vocabulary = packing.public_vocabulary()
    for key, n in times.items():
        assert sizes[key] == n * len(packing.token_ids(texts[key] or "", **vocabulary))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(sizes.values())
    assert len(places) <= 1.2 * -(-total // packing.CAPACITY) + 1


def test_whole_run(spark, planted):
    folder, rows, _ = planted
    found = P.run(spark, folder).collect()
    ids = {r.doc_id for r in found}
    assert ids == set(rows) - set(range(300, 320)) - set(range(401, 412)) - set(range(501, 504))


def test_encoder_is_the_library(spark):
    """The faster encoder against the tokenizers library, also on odd Unicode."""
    vocabulary = packing.public_vocabulary()
    tokenizer, _, _ = packing._encoders(*(vocabulary[k] for k in ("vocabulary", "ranks", "pattern")))
    rng = random.Random(4)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "é", "ß", "中", "한", "🙂", "‍", "1", "²", "…", "<|endoftext|>", "<|", "_", "\x00", "\x85", "\xa0"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    for text in texts:
        assert packing.token_ids(text, **vocabulary)[:-1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def held_out(spark, query, label, keep):
    """Predicted and labelled classes of the fold that is not trained on."""
    found = {r.doc_id: r for r in query(spark, "/root/testdata/sf0.1").select("doc_id", "held_out", "predicted").collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if r[label] is not None}
    pairs = [(found[i].predicted, y) for i, y in labels.items() if i in found and found[i].held_out]
    assert all(found[i].held_out == keep(zlib.crc32(str(i).encode())) for i in list(found)[:500])
    return Counter(pairs)


def test_held_out_toxicity(spark):
    """A fifth of the labelled toxic texts hold none of the marks that the others share, so no text model finds them."""
    ship_package(spark)
    got = held_out(spark, toxicity.op2_toxicity_ftrl, "toxic", lambda c: c % 5 == 0)
    assert got[1, 1] / (got[1, 1] + got[0, 1]) > 0.75 and got[1, 0] <= 0.01 * (got[1, 0] + got[0, 0])


def test_held_out_quality(spark):
    ship_package(spark)
    got = held_out(spark, quality.op4_quality_nbsvm, "quality", lambda c: c % 3 == 1)
    assert got[1, 1] / (got[1, 1] + got[0, 1]) > 0.95 and got[0, 0] / (got[0, 0] + got[1, 0]) > 0.75


def test_ftrl_against_a_plain_walk():
    """The same updates, one coordinate at a time."""
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 12)).astype(np.int32) for _ in range(80)]
    y = np.array([int(3 in r or 7 in r) for r in rows])
    got = toxicity.ftrl([np.frombuffer(toxicity.packed(r), np.uint8) for r in rows], y, alpha=1.0, l1=0.5, epochs=3)
    z, n, bias, order = Counter(), Counter(), 0.0, np.random.default_rng(0)
    base = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    weight = lambda i: 0.0 if abs(z[i]) <= 0.5 else (np.sign(z[i]) * 0.5 - z[i]) / ((1.0 + np.sqrt(n[i])) / 1.0 + 1.0)
    for _ in range(3):
        for r in order.permutation(len(rows)):
            w = {i: weight(i) for i in rows[r].tolist()}
            g = 1 / (1 + np.exp(-(base + bias + sum(w.values())))) - y[r]
            bias -= 0.01 * g
            for i, v in w.items():
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) * v
                n[i] += g * g
    want = {i: weight(i) for i in range(50) if weight(i)}
    assert got["index"].tolist() == sorted(want) and np.allclose(got["weight"], [want[i] for i in sorted(want)])
    assert np.isclose(got["bias"][0], base + bias)
