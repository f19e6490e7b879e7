"""A dictionary of terms as blocks of bytes that workers map into memory: sorted hashes, and the terms they stand for.

A block has the terms, and the first words of terms, whose hashes begin with the same bits. A look-up is a binary search
among hashes and a comparison of the term itself, so nothing is unpacked and a host's workers share a block's pages.
Small dictionaries are one block, broadcast; others are built by the executors, a file a block in the shared folder,
and each host fetches the files once. Both are looked up alike.
"""

from __future__ import annotations

import mmap
import uuid
from bisect import bisect_left
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import file_system, shared_dir

#: Bytes of terms up to which a dictionary is one block, made on the driver and broadcast.
BROADCAST_BYTES = 4_000_000
#: Bytes of terms in one block of a larger one; a task that builds a block holds so many.
BLOCK_BYTES = 16_000_000


def term_hash(term: str) -> int:
    """As Spark's xxhash64 of one string, without a sign."""
    return xxhash.xxh64_intdigest(term.encode(), seed=42)


def pack(terms: Iterable[tuple[str, str]], heads: Iterable[tuple[str, int]]) -> bytes:
    """(normalised term, spelling) and (first word, most words of terms that begin with it) as one block."""
    named = sorted((term_hash(n), f"{n}\0{raw}".encode()) for n, raw in terms)
    firsts = sorted((term_hash(h), words) for h, words in heads)
    ends = np.cumsum([0, *(len(b) for _, b in named)])
    parts = [np.array([len(named), len(firsts)], "<u8"), np.array([h for h, _ in named], "<u8"), ends.astype("<u8"), np.array([h for h, _ in firsts], "<u8"), np.array([n for _, n in firsts], "<u8")]
    return b"".join(p.tobytes() for p in parts) + b"".join(b for _, b in named)


class Block:
    """A packed block, read in place."""

    def __init__(self, buffer):
        view = memoryview(buffer)
        n, k = view[:16].cast("Q").tolist()
        at, self.parts = 16, []
        for size in (n, n + 1, k, k):
            self.parts.append(view[at : at + 8 * size].cast("Q"))
            at += 8 * size
        self.hashes, self.ends, self.head_hashes, self.head_words = self.parts
        self.blob = view[at:]

    def get(self, term: str, key: int) -> str | None:
        i, wanted = bisect_left(self.hashes, key), term.encode() + b"\0"
        while i < len(self.hashes) and self.hashes[i] == key:
            entry = bytes(self.blob[self.ends[i] : self.ends[i + 1]])
            if entry.startswith(wanted):
                return entry[len(wanted) :].decode()
            i += 1
        return None

    def words(self, key: int) -> int:
        i = bisect_left(self.head_hashes, key)
        return self.head_words[i] if i < len(self.head_hashes) and self.head_hashes[i] == key else 0


class Terms:
    """All blocks of a dictionary; there is a power of two of them, by the first bits of the hash."""

    def __init__(self, blocks: list[Block]):
        self.blocks, self.shift = blocks, 64 - (len(blocks) - 1).bit_length()

    def get(self, term: str) -> str | None:
        key = term_hash(term)
        return self.blocks[key >> self.shift].get(term, key)

    def words(self, first: str) -> int:
        """The most words of a term that begins with a word; 0 if none does. A chance equality of hashes only costs time."""
        key = term_hash(first)
        return self.blocks[key >> self.shift].words(key)


@lru_cache(maxsize=4)
def _mapped(names: tuple[str, ...]) -> Terms:
    """Blocks of files that this host has fetched; null where no term has those bits."""
    blocks = []
    for name in names:
        if name:
            with open(SparkFiles.get(name), "rb") as f:
                blocks.append(Block(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
        else:
            blocks.append(Block(pack([], [])))
    return Terms(blocks)


@lru_cache(maxsize=4)
def _unpacked(block: bytes) -> Terms:
    return Terms([Block(block)])


class Dictionary:
    """A dictionary's blocks as tasks find them: a broadcast block, or the names of files."""

    def __init__(self, most: int, block=None, names: tuple[str, ...] = ()):
        self.most, self.block, self.names = most, block, names

    def open(self) -> Terms:
        return _mapped(self.names) if self.block is None else _unpacked(self.block.value)


def build(terms: DataFrame, most_words: int, broadcast_bytes: int | None = None, block_bytes: int = BLOCK_BYTES) -> Dictionary:
    """The Dictionary of (norm, raw, n_words) rows, one a norm.

    Only sizes, a small dictionary's terms, and the names of a large one's files come to the driver.
    """
    spark = terms.sparkSession
    size = terms.agg(F.sum(F.octet_length("norm") + F.octet_length("raw") + 40).alias("bytes"), F.max("n_words").alias("most")).first()
    total, most = size["bytes"] or 0, min(size["most"] or 0, most_words)
    head = F.split_part("norm", F.lit(" "), F.lit(1))
    heads = terms.groupBy(head.alias("norm")).agg(F.max("n_words").alias("n_words"))
    if total <= (BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes):
        rows, firsts = terms.select("norm", "raw").collect(), {}
        for r in terms.select("norm", "n_words").collect():
            first = r.norm.partition(" ")[0]
            firsts[first] = max(firsts.get(first, 0), r.n_words)
        return Dictionary(most, spark.sparkContext.broadcast(pack(rows, firsts.items())))

    bits = max(1, (total // block_bytes).bit_length())
    folder = f"{shared_dir(spark).rstrip('/')}/terms-{uuid.uuid4().hex}"
    place = F.shiftrightunsigned(F.expr("xxhash64(norm)"), 64 - bits)
    both = terms.select("norm", "raw", "n_words").unionByName(heads.withColumn("raw", F.lit(None).cast("string")).select("norm", "raw", "n_words"))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        is_term = pdf["raw"].notna()
        own, firsts = pdf[is_term], pdf[~is_term]
        block = pack(zip(own["norm"], own["raw"]), zip(firsts["norm"], firsts["n_words"].astype(int)))
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        name = f"terms-{uuid.uuid4().hex}.bin"  # of its own for each attempt; only the names that come back are read
        with system.open_output_stream(f"{path}/{name}") as out:
            out.write(block)
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "name": [name]})

    made = both.withColumn("block", place.cast("long")).groupBy("block").applyInPandas(write, "block long, name string").collect()
    by_block = {r["block"]: r["name"] for r in made}
    for name in by_block.values():
        spark.sparkContext.addFile(f"{folder}/{name}")
    return Dictionary(most, None, tuple(by_block.get(i, "") for i in range(1 << bits)))
