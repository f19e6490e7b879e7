"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Chunks of the table send each owner of a fingerprint range their sorted fingerprints, Golomb-Rice coded. The owner
answers every chunk with a bitmap of those that other chunks have too. Only rows under such suspect fingerprints have
their texts compared, byte by byte; all other rows are known to be single.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, texts, whole_row

FP_BITS = 48
#: Fingerprints that one owner decodes at once, and rows of one chunk: 8 bytes each in a task.
OWNER_ROWS = 250_000
CHUNK_ROWS = 1_000_000
#: Suspect fingerprints up to here are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def fingerprint(norm: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - FP_BITS)


def golomb_encode(values: np.ndarray, k: int) -> bytes:
    """Sorted distinct integers as gaps: unary quotients (zeros, then a one), followed by remainders of k bits."""
    gaps = np.diff(values, prepend=np.int64(0))
    quotients = gaps >> k
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k - 1, -1, -1)) & 1).astype(np.uint8)
    head = np.packbits(unary)
    return len(head).to_bytes(4, "little") + head.tobytes() + np.packbits(rest).tobytes()


def golomb_decode(blob: bytes, n: int, k: int) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, size, 4)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(blob, np.uint8, offset=4 + size), count=n * k).reshape(n, k)
    rest = bits.astype(np.int64) @ (np.int64(1) << np.arange(k - 1, -1, -1, dtype=np.int64))
    return np.cumsum((quotients << k) | rest)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    held, rows = [], 0
    for pdf in batches:
        held.append(pdf["fp"].to_numpy(np.int64))
        rows += len(pdf)
        if rows >= CHUNK_ROWS:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def _sender(owner_bits: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each chunk and owner: the coded distinct fingerprints, and a bitmap of those that repeat in the chunk."""
        part, shift = TaskContext.get().partitionId(), FP_BITS - owner_bits
        for i, fps in enumerate(_chunks(batches)):
            values, counts = np.unique(fps, return_counts=True)
            owners = values >> shift
            cuts = np.flatnonzero(np.diff(owners, prepend=-1))
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True):
                own = values[a:b] & ((1 << shift) - 1)
                k = max(1, ((1 << shift) // len(own)).bit_length() - 1)
                rows.append((f"{part}.{i}", int(owners[a]), len(own), k, golomb_encode(own, k), np.packbits(counts[a:b] > 1).tobytes()))
            yield pd.DataFrame(rows, columns=["chunk", "owner", "n", "k", "blob", "local"])

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps, one for each chunk: which of its fingerprints other chunks have too."""
    sent = [golomb_decode(b, n, k) for b, n, k in zip(pdf["blob"], pdf["n"], pdf["k"], strict=True)]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    seen = [np.packbits(counts[np.searchsorted(values, own)] > 1).tobytes() for own in sent]
    return pd.DataFrame({"chunk": pdf["chunk"], "owner": pdf["owner"], "seen": seen})


def _suspects(owner_bits: int):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A chunk's fingerprints that its own bitmap or the owner's answer marks."""
        for pdf in batches:
            found = [np.empty(0, np.int64)]
            for owner, n, k, blob, local, seen in zip(*(pdf[c] for c in ("owner", "n", "k", "blob", "local", "seen")), strict=True):
                bits = np.unpackbits(np.frombuffer(local, np.uint8) | np.frombuffer(seen, np.uint8), count=n)
                found.append(golomb_decode(blob, n, k)[bits > 0] + (owner << (FP_BITS - owner_bits)))
            yield pd.DataFrame({"fp": np.concatenate(found)})

    return mark


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, and row_id.

    Texts are equal when identical after each run of ASCII white space is one space; null is the empty text. The row
    with the smallest doc_id of a group stays; a null doc_id counts only where the group has no other, and of rows
    that repeat a doc_id with an equal text just one is kept. An empty table gives an empty result.

    The texts are read twice and never shuffled as a whole: the second time only rows under a suspect fingerprint go
    on, and of these each task sends one copy of a text. A group of any size is therefore a row a task.
    """
    norm = normalised(F.col("text"))
    rows = staged(
        texts(docs).select("doc_id", F.unhex(F.sha2(norm, 256)).alias("sha"), fingerprint(norm).alias("fp"), F.monotonically_increasing_id().alias("row_id")),
        "fingerprints",
    )
    owner_bits = max(5, (rows.count() // OWNER_ROWS).bit_length())
    sent = staged(rows.select("fp").mapInPandas(_sender(owner_bits), "chunk string, owner long, n int, k int, blob binary, local binary"), "golomb")
    answers = sent.drop("local").groupBy("owner").applyInPandas(_answer, "chunk string, owner long, seen binary")
    suspects = staged(sent.join(answers, ["chunk", "owner"]).mapInPandas(_suspects(owner_bits), "fp long").distinct(), "suspects")

    if suspects.count() <= BROADCAST_ROWS:
        suspects = F.broadcast(suspects)
    groups = (
        texts(docs)
        .select("doc_id", norm.alias("norm"))
        .withColumn("fp", fingerprint(F.col("norm")))
        .join(suspects, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    groups = staged(groups, "groups")
    firsts = (
        rows.alias("r")
        .join(groups.alias("g"), (F.col("r.sha") == F.col("g.sha")) & F.col("r.doc_id").eqNullSafe(F.col("g.keep_id")))
        .groupBy("r.sha", "r.doc_id", "g.group_size")
        .agg(F.min("r.row_id").alias("keep_row"))
        .select("sha", F.col("doc_id").alias("keep_id"), "group_size", "keep_row")
    )
    return rows.join(firsts, "sha", "left").select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("keep_row").isNull() | (F.col("keep_row") == F.col("row_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row_id",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns; a repeated row is taken once.

    Decisions meet rows by doc_id and the digest of the text. Up to BROADCAST_ROWS dropped rows are broadcast, so that
    texts stay where they are; beyond that the join shuffles.
    """
    found = staged(exact_groups(docs).filter("group_size > 1").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha"), "kept"), "decisions")
    keys = found.groupBy("_id", "_sha").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    dropped = keys.filter("not stays").select("_id", "_sha")
    repeated = keys.filter("stays and n > 1").select("_id", "_sha")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    named = docs.select(whole_row(), F.col("doc_id").cast("long").alias("_doc"), F.unhex(F.sha2(normalised(F.coalesce(F.col("text"), F.lit(""))), 256)).alias("_text_sha"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_sha") == F.col("_sha"))
    out = named.join(dropped, same, "left_anti")
    if not repeated.isEmpty():
        again = out.join(repeated, same, "left_semi").dropDuplicates(["_doc", "_text_sha"])
        out = out.join(repeated, same, "left_anti").unionByName(again)
    return out.select("_row.*")
