"""Packing token sequences by best-fit decreasing, with a segment tree over remaining capacities."""

from __future__ import annotations

import zlib
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import map_batches, staged, texts

if TYPE_CHECKING:  # workers that encode need not load it
    import pandas as pd

WINDOW = 2048
END_ID = 1
#: Pieces that one task packs; windows are closed at its end, so more of them waste less.
SHARD_PIECES = 12_000
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
#: A piece with its document's place in the scan, which tells repeated rows apart.
PLACED = (*PIECE, "place")


class CapacityTree:
    """A segment tree over capacities 0..size: how many open windows have each, and the least capacity that fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = self.leaves + capacity
        while i:
            self.counts[i] += n
            i >>= 1

    def push(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def pop(self, capacity: int) -> int:
        self._add(capacity, -1)
        return self.windows[capacity].pop()

    def tightest(self, need: int) -> int:
        """The least capacity of at least ``need`` that an open window has, or -1."""
        i, counts = self.leaves + need, self.counts
        if counts[i]:
            return need
        while i > 1:  # up, until a subtree to the right has a window; then down to its leftmost leaf
            if not i & 1 and counts[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if counts[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of pieces of at most ``window`` tokens, longest first, each in the tightest open window."""
    numbers, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree, opened = CapacityTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        capacity = tree.tightest(need)
        if capacity < 0:
            number, capacity, opened = opened, window, opened + 1
        else:
            number = tree.pop(capacity)
        numbers[i], offsets[i] = number, window - capacity
        if capacity > need:
            tree.push(capacity - need, number)
    return numbers, offsets


def _cutter(path: str, window: int):
    def cut(batches):
        """Each document's ids and the end id, as full windows and one remainder."""
        encode, end = encoder(path).encode_packed, np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text, place in zip(batch["doc_id"], batch["text"], batch["place"], strict=True):
                ids = encode(text) + end
                for at in range(0, len(ids), 4 * window):
                    piece = ids[at : at + 4 * window]
                    rows.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, place))
            yield dict(zip(PLACED, zip(*rows), strict=True)) if rows else dict.fromkeys(PLACED, [])

    return cut


def _packer(window: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32", "place"], kind="stable", ignore_index=True)
        numbers, offsets = best_fit_decreasing(pdf["length"].to_numpy(), window)
        # Shards take turns in the numbering: unique without counting how many windows each has.
        pdf["sequence_id"] = numbers * pdf["shards"] + pdf["shard"]
        pdf["offset"] = offsets
        return pdf[[*PIECE, "sequence_id", "offset"]]

    return pack


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (null text: none) and one end id are cut into full windows; the remainder goes whole into the
    tightest open window of its shard. Equal lengths are packed by doc_id. Rows that repeat, or have a null doc_id, are
    packed each on its own; an empty table gives an empty result.

    Ids stay in the task that made them; only the pieces' numbers shuffle. A piece's shard is a hash of its row's place
    in the scan and its own in the document, so that no shard is larger than others, whatever the documents' lengths and
    however many rows have one doc_id or none.
    """
    rows = texts(docs).withColumn("place", F.monotonically_increasing_id())
    pieces = map_batches(rows, _cutter(path, window), ", ".join(f"{c} long" for c in PLACED), keep="encoder")
    pieces = staged(pieces, "pieces")
    shards = max(1, round(pieces.count() / SHARD_PIECES))
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("place", "start"), F.lit(shards))).withColumn("shards", F.lit(shards))
    return sharded.groupBy("shard").applyInPandas(_packer(window), ", ".join(f"{c} long" for c in (*PIECE, "sequence_id", "offset")))
