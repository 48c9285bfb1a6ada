"""Wavelet matrix files: exact round trips, and lookups against plain scans."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import token_files as T
from panelforge.llm.wavelet import TokenFile, write_file
from panelforge.session import ship_package

DOCS = "doc_id long, text string, n long, ids string, place long"


def in_memory(ids, lengths, keys, bits):
    out = io.BytesIO()
    write_file(out, np.array(ids, dtype="<u2"), lengths, keys, bits)
    return TokenFile(io.BytesIO(out.getvalue()), len(out.getvalue()))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=300))
def test_lookups_in_a_file(ids):
    file = in_memory(ids, [len(ids)], [3], 4)
    assert file.decode().tolist() == ids
    assert [file.access(i) for i in range(len(ids))] == ids
    for token in range(17):
        places = [i for i, t in enumerate(ids) if t == token]
        assert file.rank(token) == len(places)
        assert [file.select(token, k) for k in range(len(places))] == places
        for end in range(0, len(ids) + 1, 37):
            assert file.rank(token, end) == sum(p < end for p in places)
        with pytest.raises(IndexError):
            file.select(token, len(places))


def test_lookups_across_blocks():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.geometric(0.02, 200_000), 49_407).astype("<u2")
    file = in_memory(ids, [150_000, 0, 50_000], [None, 4, 5], 16)
    assert np.array_equal(file.decode(), ids)
    lengths, keys, null = file.documents()
    assert lengths.tolist() == [150_000, 0, 50_000] and keys.tolist() == [0, 4, 5] and null.tolist() == [True, False, False]
    for token in (1, 2, 60, 300, 40_000):
        places = np.flatnonzero(ids == token)
        assert file.rank(token) == len(places) and file.rank(token, 70_001) == int((places < 70_001).sum())
        for k in (0, len(places) // 2, len(places) - 1):
            if len(places):
                assert file.select(token, k) == places[k]
    for i in (0, 65_535, 65_536, 131_072, 199_999):
        assert file.access(i) == ids[i]
    with pytest.raises(ValueError):
        write_file(io.BytesIO(), ids, [3], [1], 16)


def test_words_encode_as_whole_texts():
    """The library's own result for the whole text, also with odd Unicode, contractions and special strings."""
    tokenizer = T._tokenizer(T.public_word_vocabulary())
    rng = random.Random(3)
    alphabet = ["a", "B", "'s", "'LL", "é", "é", "́", "ß", "İ", "Σ", "ς", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " ", "　", "中", "한",
                "ᄒ", "ᅡ", "1", "²", "…", "<|endoftext|>", "<|startoftext|>", "<|", "_", "🙂", "‍", "\x00"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["", " ", "x" * 5000]
    encode = T.word_encoder(T.public_word_vocabulary())
    for some in (texts, texts[:1], ["<|endoftext|>"], ["\x01 a\x01b"], [""], []):
        ids, ends = encode(pa.array(some, pa.string()), T.END)
        assert len(ends) == len(some)
        for text, start, end in zip(some, [0, *ends.tolist()], ends.tolist(), strict=False):
            assert ids[start:end].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, T.END]


def table(spark):
    ship_package(spark)
    rows = [(7, "two words"), (1, None), (3, ""), (None, "no id"), (5, "la " * 9000), (7, "another of seven"), (2, "É école\x0b\tTWO  words"), (7, "two words"), (-4, "minus")]
    rows += [(100 + i, " ".join(f"w{j % 11}" for j in range(i))) for i in range(60)]
    return rows, spark.createDataFrame([(k, t, 9, "x", 1) for k, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize("file_ids", [1, 500, 1 << 20])
def test_files_against_the_library(spark, file_ids):
    rows, docs = table(spark)
    tokenizer = T._tokenizer(T.public_word_vocabulary())
    ids = lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END]
    folder = T.write_token_files(docs, T.public_word_vocabulary(), file_ids=file_ids)
    got = sorted(T.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    want = sorted((str(k), zlib.crc32(np.array(ids(t), "<u4").tobytes()), len(ids(t))) for k, t in rows)
    assert sorted((str(r.doc_id), zlib.crc32(bytes(r.ids)), r.n_tokens) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    every = [t for r in got for t in np.frombuffer(bytes(r.ids), "<u4").tolist()]
    token = ids("words")[0]
    counts = {r.token: r.n for r in T.count_tokens(spark, folder, [T.END, token, 49_999]).collect()}
    assert counts == {T.END: every.count(T.END), token: every.count(token), 49_999: 0}
    found = sorted(r.start + r.position for r in T.find_token(spark, folder, token).collect())
    assert found == [i for i, t in enumerate(every) if t == token]


def test_empty_table(spark):
    docs = table(spark)[1].limit(0)
    folder = T.write_token_files(docs, T.public_word_vocabulary())
    assert T.read_token_files(spark, folder).count() == 0 and T.count_tokens(spark, folder, [1]).count() == 0
