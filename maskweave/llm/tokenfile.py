"""Token ids in binary files: a Spark data source ``tokenfile`` of Simple-8b blocks, and the query that uses it.

    spark.dataSource.register(TokenFiles)
    rows.write.format("tokenfile").mode("append").save(folder)     # rows: doc_id long, ids binary (unsigned 32-bit)
    texts.write.format("tokenfile").option("vocabulary", path).option("end_id", 0).mode("append").save(folder)
    spark.read.format("tokenfile").load(folder)                    # doc_id, start, ids

Rows of doc_id and text are encoded where they are written, so that their ids need not travel.

One file is written a partition, in its rows' order; the folder's ``_manifest.json``, written when all tasks have
ended, names the files in the order of their partitions. Files that no manifest names (of tasks that were run again)
are not read. A folder is written once.

A file is: 8 bytes of magic; the words of all ids, block after block; then the footer's arrays (the word at which each
block begins, exceptions, each document's number of ids as Simple-8b words of its own, doc_ids, which doc_ids are
null); then seven 64-bit lengths and the magic again. All numbers are little-endian.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from ..sources.scratch import file_system, shared_dir
from . import simple8b
from .bpe import byte_letters
from .common import map_batches, texts

MAGIC = b"TOKS8B01"
#: Ids that a task encodes or decodes at once; a longer document is held by itself when it is read.
CHUNK = 256 * simple8b.BLOCK
MANIFEST = "_manifest.json"
END_ID = 0


# ---- the format ----------------------------------------------------------------------------------------------------


class FileWriter:
    """One file: ids are encoded as soon as whole chunks of blocks are there; the documents' places wait for the footer."""

    def __init__(self, out):
        self.out, self.waiting, self.held = out, [], 0
        self.offsets, self.exceptions, self.words, self.ids = [], [], 0, 0
        self.doc_ids, self.lengths = [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= CHUNK:
            self._encode(last=False)

    def _encode(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // simple8b.BLOCK * simple8b.BLOCK
        for at in range(0, whole, CHUNK):
            words, offsets, exceptions = simple8b.encode(ids[at : min(at + CHUNK, whole)])
            escaped = words >> np.uint64(60) == simple8b.ESCAPE
            words[escaped] += np.uint64(sum(map(len, self.exceptions)))
            self.out.write(words.astype("<u8").tobytes())
            self.offsets.append(offsets + self.words)
            self.exceptions.append(exceptions)
            self.words += len(words)
        self.ids += whole
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        """Writes the footer; (documents, ids)."""
        self._encode(last=True)
        n = len(self.doc_ids)
        lengths, _, long = simple8b.encode(np.array(self.lengths, np.uint64), max(n, 1))
        nulls = np.array([d is None for d in self.doc_ids], bool)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        exceptions = np.concatenate([*self.exceptions, long]) if self.exceptions else long
        offsets = np.concatenate(self.offsets) if self.offsets else np.zeros(0, np.int64)
        for a in (offsets.astype("<u8"), exceptions.astype("<u8"), lengths.astype("<u8"), ids, np.packbits(nulls)):
            self.out.write(a.tobytes())
        self.out.write(np.array([self.words, len(offsets), len(exceptions), len(lengths), n, self.ids, simple8b.BLOCK], "<u8").tobytes() + MAGIC)
        self.out.close()
        return n, self.ids


class FileReader:
    """One file; ``ids`` decodes just the blocks that hold a range of ids."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = self._at(size - 64, 64)
        if tail[56:] != MAGIC:
            raise ValueError("not a whole token file")
        self.words, blocks, exceptions, coded, self.n, self.total, self.block = np.frombuffer(tail[:56], "<u8").astype(int).tolist()
        at = 8 + 8 * self.words
        foot, views, here = self._at(at, size - 64 - at), [], 0
        for n in (blocks, exceptions, coded, self.n):
            views.append(np.frombuffer(foot, "<u8", n, here))
            here += 8 * n
        self.offsets, self.exceptions = views[0].astype(np.int64), views[1]
        # Documents' lengths fit 60 bits, so exceptions are those of ids alone.
        lengths = simple8b.decode(views[2], self.exceptions).astype(np.int64)
        self.ends = np.cumsum(lengths)
        nulls = np.unpackbits(np.frombuffer(foot, np.uint8, -(-self.n // 8), here), count=self.n).astype(bool)
        self.doc_ids = pa.array(views[3].view("<i8"), pa.int64(), mask=nulls)

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, begin: int, end: int) -> np.ndarray:
        if begin >= end:
            return np.zeros(0, np.uint64)
        first, last = begin // self.block, -(-end // self.block)
        words = self.offsets[first], self.offsets[last] if last < len(self.offsets) else self.words
        coded = np.frombuffer(self._at(8 + 8 * int(words[0]), 8 * int(words[1] - words[0])), "<u8")
        return simple8b.decode(coded, self.exceptions)[begin - first * self.block : end - first * self.block]

    def batches(self, base: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Documents with the place of their first id, ``base`` ids lying before the file, about CHUNK ids at a time."""
        i = 0
        while i < self.n:
            begin = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, begin + CHUNK, "right")))
            ids = self.ids(begin, int(self.ends[j - 1])).astype("<u4")
            starts = np.concatenate([[begin], self.ends[i : j - 1]])
            bounds = np.concatenate([starts, self.ends[j - 1 : j]]) - begin
            column = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((4 * bounds).astype("<i8").tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([self.doc_ids.slice(i, j - i), pa.array(starts + base), column.cast(pa.binary())], schema=schema)
            i = j


# ---- the data source -----------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str
    documents: int
    ids: int


@dataclass
class OneFile(InputPartition):
    name: str
    base: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, vocabulary: str | None, end_id: str | None):
        self.folder, self.vocabulary = folder, vocabulary
        self.end = b"" if end_id is None else np.array([int(end_id)], "<u4").tobytes()

    def _ids(self, batch: pa.RecordBatch) -> Iterator[bytes]:
        if self.vocabulary is None:
            return (x.as_py() or b"" for x in batch.column("ids"))
        encoder = _encoder(self.vocabulary)
        return (encoder.encode(x.as_py() or "") + self.end for x in batch.column("text"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.folder)
        system.create_dir(path, recursive=True)
        name = f"part-{uuid.uuid4().hex}.toks"  # of its own for each attempt
        file = FileWriter(system.open_output_stream(f"{path}/{name}"))
        for batch in iterator:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), self._ids(batch), strict=True):
                file.add(doc_id, np.frombuffer(ids, "<u4"))
        return Written(TaskContext.get().partitionId(), name, *file.close())

    def commit(self, messages: list[Written]) -> None:
        system, path = file_system(self.folder)
        files = [{"name": m.name, "documents": m.documents, "ids": m.ids} for m in sorted((m for m in messages if m), key=lambda m: m.partition)]
        with system.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written]) -> None:
        system, path = file_system(self.folder)
        for m in messages:
            if m:
                system.delete_file(f"{path}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[OneFile]:
        """A partition a file; one row a file comes to the driver, from the manifest."""
        system, path = file_system(self.folder)
        with system.open_input_stream(f"{path}/{MANIFEST}") as file:
            files = json.loads(file.read())
        bases = np.cumsum([0, *(f["ids"] for f in files)]).tolist()
        return [OneFile(f["name"], base) for f, base in zip(files, bases) if f["documents"]]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's only partition where there are none
            return
        system, path = file_system(self.folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])
        with system.open_input_file(f"{path}/{partition.name}") as file:
            yield from FileReader(file).batches(partition.base, schema)


class TokenFiles(DataSource):
    """``spark.dataSource.register(TokenFiles)`` makes the format ``tokenfile`` known to a session."""

    @classmethod
    def name(cls) -> str:
        return "tokenfile"

    def schema(self) -> str:
        return "doc_id long, start long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a folder of token files is written once, in mode append")
        return _Writer(self.options["path"], self.options.get("vocabulary"), self.options.get("end_id"))


# ---- encoding ------------------------------------------------------------------------------------------------------

# The pieces that the vocabulary's splitter cuts text into, and characters that every Unicode version of
# the last years has in the same class.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COMMON = regex.compile(r"[\t\n\r -~\xa1-ͷΑ-ՖḀ-ἕ‐-‧₠-₽←-⏠☀-⛿ぁ-ゖァ-ヾ一-龥가-힣]*+")
#: Texts with so much white space in a row are left to the library: the other's splitter goes deep in it.
LONG_SPACE = re.compile(r"\s{1000}")


class ByteEncoder:
    """Texts to ids, as the tokenizers library encodes them with a byte-level vocabulary file.

    Most texts are merged by tiktoken, four times as fast, over the same file's vocabulary: there a merge's rank is the
    id of what it makes, which is checked. Texts with special tokens, characters that Unicode versions may class in
    different ways, or very long white space go to the library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, byte = path, {c: b for b, c in enumerate(byte_letters())}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)")
        ids = spec["model"]["vocab"]
        made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        ranks = {bytes(byte[c] for c in t): i for t, i in ids.items() if t not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None

    @cached_property
    def library(self) -> Tokenizer:
        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.fast is None or LONG_SPACE.search(text) or self.special.search(text) or not COMMON.fullmatch(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by ranges and sorted in ascending doc_id order; to be written as it lies.

    Null texts are empty; null doc_ids come first. Rows of one doc_id follow in the order of a hash of their texts, so
    repeated rows are neighbours. They are told apart by their place in the scan, so that a doc_id of any number of
    rows is dealt to as many tasks as it fills.
    """
    order = ("doc_id", "_hash", "_place")
    rows = texts(docs).select("*", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_place"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """docs' token ids, each document's with the end id last, as files in ``folder``; and those files as a DataFrame.

    Texts shuffle once, and are encoded where they arrive.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    ordered(docs).write.format("tokenfile").option("vocabulary", path).option("end_id", end_id).mode("append").save(folder)
    return spark.read.format("tokenfile").load(folder)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs(doc_id, text), from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before, in the order of ordered(). Empty and null texts have the end id
    alone; an empty table gives an empty result. The files lie in the shared folder.
    """
    where = shared_dir(docs.sparkSession).rstrip("/")
    files = write_tokens(docs, path, f"{where}/scratch/tokens-{uuid.uuid4().hex}")

    def digest(batches):
        for batch in batches:
            yield {
                "doc_id": batch["doc_id"],
                "start": batch["start"],
                "n_tokens": [len(x) // 4 for x in batch["ids"]],
                "ids_crc32": [zlib.crc32(x) for x in batch["ids"]],
            }

    return map_batches(files, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
