"""Token ids of a corpus in wavelet matrix files: written in order of doc_id, read back, counted and searched in place."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.wavelet import TokenFile, write_file
from panelforge.session import shared_folder, stage

#: Appended to every document.
END = 1
#: Ids in a file, at most; a longer document has a file of its own.
FILE_IDS = 1 << 23
#: Words whose ids a task remembers, at most, and bytes of such a word.
KNOWN_WORDS, LONGEST_KNOWN = 1 << 19, 64
#: Bytes of text that are encoded at a time, about.
TOGETHER = 1 << 24
#: Stands between words that are encoded together; a boundary that every such vocabulary makes.
MARK, AFTER_LETTERS = "\x01", r"([a-z])([!-@\[-`{-~])"
#: Sums of files that pass through the driver, at most.
GROUPS = 1024


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def id_kind(vocabulary: str) -> str:
    """The narrowest of two widths that holds every id."""
    return "<u2" if max(_tokenizer(vocabulary).get_vocab_size(), END + 1) <= 1 << 16 else "<u4"


@lru_cache(maxsize=1)
def word_encoder(vocabulary: str) -> Callable[[pa.Array, int | None], tuple[np.ndarray, np.ndarray]]:
    """Encodes an array of texts to ids without added special tokens, ``end`` after each text if given: all ids, and where each text's end.

    For vocabularies that drop white space and case, part letters from what follows them, and merge only within a run of letters: a
    text's ids are then those of its pieces in order, cut at ASCII white space and after an ASCII letter before an ASCII mark or
    digit. Texts that may hold a special string go through the library whole. A piece goes through it once while it is remembered,
    many pieces at a time with a mark between them; a Python worker remembers from task to task.
    """
    tokenizer, kind = _tokenizer(vocabulary), np.dtype(id_kind(vocabulary))
    known: dict[str, bytes] = {"": b""}
    again: set[str] = set()
    plain = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    mark = plain([MARK])[0]
    opening = sorted({t.content[:2] for t in tokenizer.get_added_tokens_decoder().values()})

    def learn(words: list[str]) -> None:
        safe = [w for w in words if MARK not in w] if len(mark) == 1 else []
        for at in range(0, len(safe), 256):
            some = safe[at : at + 256]
            ids = np.array(plain([f" {MARK} ".join(some)])[0], dtype=kind)
            ends = np.append(np.flatnonzero(ids == mark[0]), len(ids)) * kind.itemsize
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not keep words apart")
            raw, start = ids.tobytes(), 0
            for word, stop in zip(some, ends.tolist(), strict=True):
                known[word] = raw[start:stop]
                start = stop + kind.itemsize
        rest = words if len(mark) != 1 else [w for w in words if MARK in w]
        for word, ids in zip(rest, plain(rest), strict=True):
            known[word] = np.array(ids, dtype=kind).tobytes()

    def of_words(words: list[str]) -> list[bytes]:
        nonlocal again
        if len(known) + len(words) > KNOWN_WORDS:  # words that came in several batches stay
            kept = {w: known[w] for w in again if len(w) <= LONGEST_KNOWN} if len(again) < KNOWN_WORDS // 2 else {}
            known.clear()
            known.update(kept)
            again = set()
        new = [w for w in words if w not in known]
        again.update(set(words).difference(new))
        learn(new)
        found = [known[w] for w in words]
        for word in new:
            if len(word) > LONGEST_KNOWN:
                del known[word]
        return found

    def encode(texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(len(texts), dtype=bool)
        for o in opening:
            whole |= pc.match_substring(texts, o).to_numpy(zero_copy_only=False)
        apart = pc.replace_substring_regex(pc.ascii_lower(pc.if_else(pa.array(whole), "", texts)), AFTER_LETTERS, r"\1 \2")
        lists = pc.ascii_split_whitespace(apart)
        coded = lists.flatten().dictionary_encode()
        parts = of_words(coded.dictionary.to_pylist())
        special = np.flatnonzero(whole)
        parts += [np.array(ids, dtype=kind).tobytes() for ids in plain(texts.take(pa.array(special)).to_pylist())]
        first_special = len(coded.dictionary)
        parts.append(b"" if end is None else np.array([end], dtype=kind).tobytes())
        # Word numbers of all texts in order; a text taken whole is one word more, and every text has its end.
        starts = lists.offsets.to_numpy()[1:] - lists.offsets.to_numpy()[0]
        order = np.insert(coded.indices.to_numpy(), np.concatenate([starts[special], starts]),
                          np.concatenate([first_special + np.arange(len(special)), np.full(len(starts), len(parts) - 1)]).astype(np.int32))
        sizes = np.array([len(p) // kind.itemsize for p in parts], dtype=np.int64)
        table = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)])), pa.array(np.frombuffer(b"".join(parts), dtype=kind)))
        ids = table.take(pa.array(order)).flatten().to_numpy()
        ends = np.cumsum(sizes[order])[np.flatnonzero(order == len(parts) - 1)] if len(order) else np.zeros(0, dtype=np.int64)
        return ids, ends
    return encode


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``TOGETHER`` bytes, so that fewer of a batch's words have come before."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= TOGETHER:
            yield pa.concat_batches(held)
            held = []
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def encoded(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """``doc_id, tie, n, ids`` of every row: the ids and the end as bytes of ``id_kind``; ``tie`` orders rows of one doc_id by their text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width = word_encoder(vocabulary), np.dtype(id_kind(vocabulary)).itemsize
        for batch in _gathered(batches):
            ids, ends = encode(batch.column("text"), end)
            places = np.concatenate([[0], ends])
            raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer((places * width).tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(np.diff(places)), raw], ["doc_id", "tie", "n", "ids"])
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(
        run, "doc_id long, tie long, n long, ids binary")


def _open(path: str):
    from pyarrow import fs

    system, local = fs.FileSystem.from_uri(path)
    return system, local


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = END, file_ids: int = FILE_IDS) -> str:
    """Writes every document's ids to files ``part-<place>-<turn>.wm`` whose names sort as the documents do; returns their folder.

    Documents come in ascending doc_id, nulls first, rows of one doc_id by the hash of their text; null texts are empty and have the
    end alone. Rows are dealt by ranges of doc_id, hash and place, so rows of one doc_id need not meet in one task; a task streams its
    rows and holds one file's ids. A file gets its name when it is whole, and a task that runs again writes the same files. An empty
    table gives an empty folder. Columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    bits = max(int(max(_tokenizer(vocabulary).get_vocab_size() - 1, end)).bit_length(), 1)
    kind = id_kind(vocabulary)
    rows = stage(encoded(docs, vocabulary, end), "token-ids").withColumn("place", F.monotonically_increasing_id())
    total = rows.agg(F.sum("n")).first()[0] or 0
    tasks = max(-(-total // file_ids), int(spark.conf.get("spark.sql.shuffle.partitions")))
    system, local = _open(folder)
    system.create_dir(local, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, local = _open(folder)
        part, turn = TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        lengths: list[int] = []
        keys: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal turn
            name, draft = f"{local}/part-{part:08d}-{turn:06d}.wm", f"{local}/draft-{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                write_file(out, np.frombuffer(b"".join(ids), dtype=kind), lengths, keys, bits)
            system.move(draft, name)
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(lengths)])], ["path", "n"])
            turn += 1
            for held in (ids, lengths, keys):
                held.clear()
            return done

        waiting = 0
        for batch in batches:
            for key, n, raw in zip(*(batch.column(c) for c in ("doc_id", "n", "ids")), strict=True):
                n = n.as_py()
                if ids and waiting + n > file_ids:
                    yield flush()
                    waiting = 0
                ids.append(raw.as_py())
                lengths.append(n)
                keys.append(key.as_py())
                waiting += n
        if ids:
            yield flush()
    order = ["doc_id", "tie", "place"]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids")
    dealt.mapInArrow(run, "path string, n long").agg(F.sum("n")).first()
    return folder


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of every file; their content is not read here."""
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option(
        "pathGlobFilter", "*.wm").load(folder).select("path")


def _one_a_task(files: DataFrame) -> DataFrame:
    """Files are dealt out anew, as their table is far smaller than what is read from them."""
    return files.repartition(max(1, min(files.count(), 1 << 16)))


def _over_files(files: DataFrame, read: Callable[[TokenFile, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``read`` makes of every file, given the file and its row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, local = _open(row["path"])
                with system.open_input_file(local) as source:
                    yield from read(TokenFile(source, source.size()), row)
    return files.mapInArrow(run, schema)


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``path, first`` of every file: the ids in all files before it. Sums of at most ``GROUPS`` runs of files reach the driver."""
    def read(file: TokenFile, row: dict) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([file.n], pa.int64())], ["path", "n"])
    sizes = _over_files(_files(spark, folder), read, "path string, n long").withColumn(
        "_part", F.regexp_extract("path", r"part-(\d+)-\d+\.wm$", 1).cast("long"))
    last = sizes.agg(F.max("_part")).first()[0]
    width = -(-((last or 0) + 1) // GROUPS)
    grouped = stage(sizes.withColumn("_group", F.floor(F.col("_part") / width).cast("int")), "file-sizes")
    before, bases = 0, {}
    for row in sorted(grouped.groupBy("_group").agg(F.sum("n").alias("n")).collect()):
        bases[row["_group"]] = before
        before += row.n
    turn = Window.partitionBy("_group").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.create_map(*[F.lit(v) for g, b in bases.items() for v in (g, b)]), F.col("_group")) if bases else F.lit(0)
    return grouped.select("path", (base.cast("long") + F.coalesce(F.sum("n").over(turn), F.lit(0))).alias("first"))


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files alone; ``ids`` as unsigned little-endian 32-bit integers."""
    def read(file: TokenFile, row: dict) -> Iterator[pa.RecordBatch]:
        lengths, keys, null = file.documents()
        ids = pa.py_buffer(file.decode().tobytes())
        ends = np.cumsum(lengths)
        some = max(1, (1 << 20) // max(int(lengths.max(initial=1)), 1))
        for at in range(0, len(lengths), some):
            a, b = ends[at : at + some] - lengths[at : at + some], ends[at : at + some]
            places = pa.py_buffer((np.append(a, b[-1]) * 4).astype(np.int64).tobytes())
            found = pa.Array.from_buffers(pa.large_binary(), len(a), [None, places, ids]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[at : at + some], mask=null[at : at + some]), pa.array(row["first"] + a), pa.array(lengths[at : at + some]), found],
                ["doc_id", "start", "n_tokens", "ids"])
    return _over_files(_one_a_task(file_starts(spark, folder)), read, "doc_id long, start long, n_tokens long, ids binary")


def count_tokens(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """``token, n``: how often each of a few tokens occurs, by two ranks a plane and file; nothing is decoded."""
    def read(file: TokenFile, row: dict) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([file.rank(t) for t in tokens], pa.int64())], ["token", "n"])
    return _over_files(_one_a_task(_files(spark, folder)), read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """``doc_id, start, position``: every occurrence of a token, as the document's first id in the corpus and the place in it, by select."""
    def read(file: TokenFile, row: dict) -> Iterator[pa.RecordBatch]:
        lengths, keys, null = file.documents()
        ends, n = np.cumsum(lengths), file.rank(token)
        for at in range(0, n, 4096):
            places = np.array([file.select(token, k) for k in range(at, min(at + 4096, n))], dtype=np.int64)
            doc = np.searchsorted(ends, places, side="right")
            first = ends[doc] - lengths[doc]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[doc], mask=null[doc]), pa.array(row["first"] + first), pa.array(places - first)], ["doc_id", "start", "position"])
    return _over_files(_one_a_task(file_starts(spark, folder)), read, "doc_id long, start long, position long")


def public_word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum of ids, from the files read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = read_token_files(spark, write_token_files(docs, public_word_vocabulary()))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
