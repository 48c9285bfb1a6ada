"""The corpus operators against brute force, on small tables with the odd cases in them."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import automaton_dedup, fingerprints, jaccard, mixing, packing, quality, sharding, suffix_dedup, topk, toxicity
from panelforge.session import ship_package

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rng = random.Random(7)
    words = [a + b for a in ("an", "er", "th", "ou", "é", "st", "ing") for b in ("a", "on", "re", "ß", "ly", "nd", "ti", "o")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = say(45)
    texts = [None, "", "   \n", "one", "two words", say(30), say(300), "la " * 200, "x" * 500, say(6000)]
    texts += [say(20) + " " + shared + " " + say(25) for _ in range(6)]
    base = say(120).split()
    texts += [" ".join(base[:i] + ["new"] + base[i + 1 :]) for i in (0, 3, 60, 119)] + [" ".join(base)] * 3
    small = say(18).split()
    texts += [" ".join(small), " ".join(small[:-1]), " ".join(small + ["more"]), "Two Words", "two words"]
    rows = [(i * 3, t, None if i % 5 == 0 else "en", [None, "a", "b"][min(i % 7, 2)], len(t or ""), 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Null and repeated ids, repeated rows."""
    more = spark.createDataFrame([(None, "a null id", "en", "a", 9, 0.1), (None, "a null id", "en", "a", 9, 0.1), (6, "another text of this id", "en", "b", 9, 0.1)], DOCS)
    return docs.union(more)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_strings_against_brute_force(docs):
    seen, want = set(), {}
    for key, text in sorted(texts_of(docs).items()):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(raw[i : i + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        want[key] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeated_strings(docs).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 500


@pytest.mark.parametrize("share,group", [(2.0**-12, 4096), (0.001, 4096), (2.0**-12, 1)])
def test_words_against_brute_force(docs, monkeypatch, share, group):
    """Also with triggers that count as hot, and with groups that count as overfull."""
    from panelforge.llm import repeats
    monkeypatch.setattr(repeats, "HOT_SHARE", share)
    monkeypatch.setattr(repeats, "LARGEST_GROUP", group)
    seen, want = set(), {}
    for key, text in sorted(texts_of(docs).items()):
        words = text.encode().split()
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want[key] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    got = automaton_dedup.remove_repeated_windows(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    for r in got:
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == r.kept_sha256
        assert r.score == 0.5


@pytest.mark.parametrize("group", [4096, 1])
def test_words_of_repeated_rows_against_brute_force(spark, docs, monkeypatch, group):
    """Rows of one id and text, also of a null id, are one document; near copies share their triggers."""
    from panelforge.llm import repeats
    monkeypatch.setattr(repeats, "LARGEST_GROUP", group)
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    near = lambda *at: " ".join("new" + w if i in at else w for i, w in enumerate(base))
    rows = [(5, near()), (5, near()), (5, near()), (9, near(60, 200, 333)), (9, near(60, 200, 333)), (12, near(100)), (7, near(17, 250))]
    rows += [(None, near(40, 300)), (None, near(40, 300))]
    table = spark.createDataFrame([(i, t, None, None, len(t), 0.5) for i, t in rows], DOCS).repartition(3)
    seen, want = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        words = text.split()
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        want[key] = (len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())
    got = automaton_dedup.remove_repeated_windows(table).collect()
    assert sorted((str(r.doc_id), (r.n_words, r.n_removed, r.kept_sha256)) for r in got) == sorted((str(k), want[k]) for k, _ in rows)
    assert want[None][1] == 0 and want[9][1] > 300


def test_components_against_brute_force(docs):
    def grams(text):
        w = text.encode().lower().split()
        return frozenset(tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))) if w else frozenset()
    sets = {k: grams(t) for k, t in texts_of(docs).items()}
    root = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and sets[b]]
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    found = jaccard.with_component_id(jaccard.near_duplicates(docs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {k: (len(s), root[k]) for k, s in sets.items()}
    assert len(links) > 8


def test_parities_keep_every_link_and_spare_the_texts(spark):
    """Pairs that only share some shingle are ruled out before their texts travel; no linked pair is, nor one of many pairs of a hub."""
    rng = np.random.default_rng(3)
    sets = {}
    for i in range(40):
        n = int(rng.choice([3, 60, 480, 510, 530, 1000, 3000]))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets[3 * i] = np.unique(base)
        for j, gone in ((1, n // 25), (2, n // 3)):  # a set that is linked, one that is not
            other = rng.integers(0, 2**64, gone, dtype=np.uint64)
            sets[3 * i + j] = np.unique(np.concatenate((base[gone:], other[: gone // 2])))
    rows = [(k, len(s), jaccard.marks(s).tolist()) for k, s in sets.items()]
    pairs = [(a, b) for a in sets for b in sets if a < b and 8 * min(len(sets[a]), len(sets[b])) >= len(sets[a])]
    common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b in pairs}
    linked = {p for p in pairs if 100 * common[p] >= 90 * (len(sets[p[0]]) + len(sets[p[1]]) - common[p])}
    table = spark.createDataFrame(rows, "id long, n long, marks array<long>")
    asked = spark.createDataFrame(pairs, "a long, b long")
    near = (0.9, 10 / 9)
    kept = {(r.a, r.b) for r in jaccard.not_apart(asked, table).collect()}
    alike = {p for p in kept if near[0] <= len(sets[p[0]]) / len(sets[p[1]]) <= near[1] and len(sets[p[0]]) > 3}
    assert linked <= kept and len(linked) >= 40
    assert len(alike) <= 1.1 * len(linked)
    wide = spark.createDataFrame([(0, i) for i in range(1, 3 * jaccard.heavy_limit(0))], "a long, b long")
    held = spark.range(3 * jaccard.heavy_limit(0) + 9).selectExpr("id", "cast(id as string) as raw")
    got = jaccard.paired(wide, held, "raw").collect()
    assert sorted((r.a, r.b, r.left, r.right) for r in got) == [(0, i, "0", str(i)) for i in range(1, 3 * jaccard.heavy_limit(0))]


def test_lists_are_dealt_once(spark, tmp_path):
    """Groups and join of the lists read one shuffle of them."""
    rows = [(k, 10 * k + i, 5, i, r) for k in range(50) for i in range(3) for r in (-1, 2)]
    listed = spark.createDataFrame(rows, "key long, id long, n long, pos int, role int")
    listed.write.parquet(str(tmp_path / "listed"))
    found = jaccard.light_links(spark.read.parquet(str(tmp_path / "listed")))
    assert sorted((r.a, r.b) for r in found.collect()) == [(10 * k + i, 10 * k) for k in range(50) for i in (1, 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) == 2 and len({line.split("Repartition")[1].split("[")[0] for line in dealt}) == 1


def test_light_sets_meet_every_partner():
    for n in range(1, 41):
        for t, lack in jaccard.partners(n):
            assert jaccard.overlap(n, t) == n - lack
    assert jaccard.boundary({n: 10 for n in range(1, 41)}) >= 10


def test_fingerprints(docs):
    texts = texts_of(docs)
    keys = sorted(texts)
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(docs).collect()}
    assert sorted(got) == keys
    marks = {}
    for a, b in zip(keys, keys[1:] + keys[:1], strict=True):
        half = len(texts[a]) // 2
        new = texts[a][: len(texts[a]) - half] + texts[b][:half]
        assert got[a].n_chars == len(texts[a]) and got[a].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert marks.setdefault(texts[a], got[a].fingerprint) == got[a].fingerprint
        assert 0 <= got[a].near_next <= 1 and 0 <= got[a].near_edited <= 1


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(3)
    terms = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    error = []
    for _ in range(40):
        a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        error.append(fingerprints.likeness(fingerprints.signature(terms[a > 0], a[a > 0]), fingerprints.signature(terms[b > 0], b[b > 0])) - want)
    assert abs(np.mean(error)) < 0.05


def test_packing(docs):
    paths = packing.public_vocabulary()
    got = packing.pack_documents(docs, **paths).collect()
    for key, text in texts_of(docs).items():
        ids = packing.token_ids(text, paths["vocabulary"])
        mine = sorted((r for r in got if r.doc_id == key), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in mine] == packing.cut(len(ids))
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048


def test_local_search_empties_a_bin():
    sizes = np.array([6, 4, 4, 3, 3])  # one bin of 10 each: 6+4 and 4+3+3
    assert len(packing.empty_bins([[0, 3], [1, 2], [4]], sizes, 10)) == 2
    assert packing.cut(1) == [(0, 1)] and packing.cut(4096) == [(0, 2048), (2048, 2048)] and packing.cut(2049) == [(0, 1), (1, 2048)]


@pytest.mark.parametrize("low,high,n", [(25, 50, 60), (2, 60, 45), (30, 37, 80)])
def test_local_search_ends_where_no_exchange_raises_squared_fill(low, high, n):
    from itertools import combinations
    stuck = 0
    for seed in range(6):
        sizes = np.random.default_rng(seed).integers(low, high, n)
        bins = packing.empty_bins(packing.best_fit(sizes, 100), sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(n))
        fill = [int(sizes[b].sum()) for b in bins]
        assert max(fill) <= 100
        if len(bins) == -(-int(sizes.sum()) // 100):
            continue
        stuck += 1
        for a, own in enumerate(bins):
            gives = [int(sizes[i]) for i in own] + [int(sizes[i] + sizes[j]) for i, j in combinations(own, 2)]
            for b, others in enumerate(bins):
                if a != b:
                    gains = [g - t for g in gives for t in (0, *(int(sizes[i]) for i in others)) if g > t]
                    assert not any(fill[b] + g <= 100 and fill[b] + g > fill[a] for g in gains)
    assert stuck or low == 2


def test_special_strings_are_encoded_as_the_tokenizer_does():
    paths = packing.public_vocabulary()
    for text in ("a <|endoftext|> b", "plain text  with\n\nspaces", ""):
        assert packing.token_ids(text, **paths).tolist() == packing.token_ids(text, paths["vocabulary"]).tolist()


@pytest.mark.parametrize("n", [1, 2, 5, 16, 97])
def test_permutation(spark, n):
    got = [r.position for r in sharding.permute_rows(spark.range(n).withColumnRenamed("id", "row"), "row", n, 5).collect()]
    assert sorted(got) == list(range(n))


def test_shards(odd):
    got = sharding.feistel_shards(odd, ["doc_id", "text"], 4).collect()
    assert len(got) == odd.count()
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(got) / 4) < 1
    again = sharding.feistel_shards(odd.repartition(5), ["doc_id", "text"], 4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_targets(spark, docs):
    rows = [(i, "big" if i < 900 else "mid" if i < 980 else None, 10) for i in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    got = mixing.temperature_mix(table, max_repetition=3.0).collect()
    seen = Counter(r.doc_id for r in got)
    assert len(seen) == 1000 and max(seen.values()) == 3
    total = sum(r.tokens for r in got)
    for source in ("big", "mid", None):
        mine = [r for r in got if r.source == source]
        assert sum(r.tokens for r in mine) / total == pytest.approx(mine[0].weight, abs=0.02)
    shares = mixing.source_shares(table)
    alpha = mixing.find_exponent(shares, target_entropy=0.9)
    p = np.array([0.9, 0.08, 0.02]) ** alpha
    p /= p.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(0.9, abs=1e-6)
    assert mixing.temperature_mix(table, target_entropy=0.9, budget=5000).count() > 300


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(120)]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1000, [float("nan")] * 6)]
    vectors = topk.scaled_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    held = {r.vec_id: np.array(r.v) for r in vectors.collect()}
    assert len(held) == 420
    got = topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10).collect()
    for q in (0, 100, 200, 300, 400):
        want = sorted((-int(v @ held[q]), i) for i, v in held.items() if i != q)[:10]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_classifiers_learn(spark):
    rng = random.Random(2)
    words = ["the", "of", "and", "river", "stone", "light", "house", "tree"]
    rows, labels = [], []
    for i in range(400):
        toxic, low = int(i % 4 == 0), int(i % 3 == 0)
        w = [rng.choice(words) for _ in range(40)] + ["moron"] * toxic
        rng.shuffle(w)
        rows.append((i, " ".join(x + "###" if low else x for x in w), "en", "a", 1, 0.0))
        labels.append((i, 1 - low, toxic))
    table = spark.createDataFrame(rows, DOCS)
    truth = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = table.drop("score")
    for model, score, label in ((toxicity.fit_toxicity(plain, truth), toxicity.toxicity_scores, "toxic"), (quality.fit_quality(plain, truth), quality.quality_scores, "quality")):
        got = score(plain, model).join(truth, "doc_id").collect()
        assert sum((r.score >= 0.5) == r[label] for r in got) > 390
        odd_texts = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 50_000)], "doc_id long, text string")
        assert all(0 <= r.score <= 1 for r in score(odd_texts, model).collect())
        none = (toxicity.fit_toxicity if label == "toxic" else quality.fit_quality)(plain, truth.limit(0))
        assert {r.score for r in score(odd_texts, none).collect()} == {0.5}


def test_skip_grams_reach_over_two_words():
    """Two texts of the same words differ in what stands three apart alone."""
    grams = lambda text: set(toxicity.gram_features(text).tolist())
    assert len(grams(b"one two three four")) == 4 + 3 + 2 + 1
    assert len(grams(b"one x y four") & grams(b"one p q four")) == 3
    found = toxicity.gram_features(b"one two three four")
    assert toxicity.unpacked(np.frombuffer(toxicity.packed(found), np.uint8)).tolist() == found.tolist()


def test_odd_ids_and_extra_columns(odd):
    n = odd.count()
    assert suffix_dedup.remove_repeated_strings(odd).count() == n
    assert automaton_dedup.remove_repeated_windows(odd).count() == n
    assert fingerprints.fingerprint_pairs(odd).count() == n
    found = jaccard.near_duplicates(odd).collect()
    assert len(found) == n and len({r._id for r in found if r.doc_id is None}) == 1


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert suffix_dedup.remove_repeated_strings(none).count() == 0
    assert automaton_dedup.remove_repeated_windows(none).count() == 0
    assert jaccard.near_duplicates(none).count() == 0
    assert fingerprints.fingerprint_pairs(none).count() == 0
    assert packing.pack_documents(none, **packing.public_vocabulary()).count() == 0
    assert sharding.feistel_shards(none, ["doc_id"], 8).count() == 0
    assert mixing.temperature_mix(none.withColumn("tokens", mixing.word_count(none.text)), max_repetition=2.0).count() == 0
    empty = topk.scaled_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(empty, empty).count() == 0


def test_training_sample_is_bounded_under_repeated_ids(spark):
    from panelforge.llm.linear import fold, labelled_sample
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)] * 50 + [(2, "c"), (None, "d")], "doc_id long, text string")
    truth = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, toxic int")
    got = labelled_sample(rows, truth, "toxic", fold("doc_id", 1) == 0, 5).collect()
    assert sorted((r.doc_id, r.text, r.y) for r in got) == [(1, "a", 1), (2, "c", 0)]


def test_top_k_stops_at_closed_rings(spark, monkeypatch):
    """Two far clusters: bounds close rings, and results stay exact whatever the rounds."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4) + (40 if i % 2 else -40)]) for i in range(400)]
    vectors = topk.scaled_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    held = {r.vec_id: np.array(r.v) for r in vectors.collect()}
    queries = vectors.filter("vec_id % 100 = 0")
    for reach in (topk.REACH, (1, topk.PIVOTS * topk.RINGS)):
        monkeypatch.setattr(topk, "REACH", reach)
        got = topk.top_k(vectors, queries, 5).collect()
        for q in (0, 100, 200, 300):
            want = sorted((-int(v @ held[q]), i) for i, v in held.items() if i != q)[:5]
            assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
