"""Vector compression: product codes by Elkan's form of Lloyd's rounds, on whole numbers.

A vector's components become floor(256 * x) and are cut into 16 parts; a part's code is its nearest entry of 64. Beside
each vector lie, from round to round, an upper bound of each part's distance to its entry and a lower bound of its
distance to every entry. When entries move, bounds move by as much; an entry whose lower bound, or half whose distance
from the present entry, is strictly more than the upper bound cannot be nearer nor tie. Distances that the bounds leave
open are computed in whole numbers, and equal ones go to the lower index, so codes are those of a full search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole components lie within this (inputs of 131,072 or more count as that), so that sums of squares fit 64 bits.
MOST = 1 << 25
#: Vectors that a task holds with their bounds at once.
SLICE = 2048
#: Sums by label are broadcast up to this many labels; beyond it both sides shuffle, hot labels dealt over SALTS.
BROADCAST_ROWS, SALTS = 1_000_000, 16
#: Rounding of square roots: bounds are widened by this much.
SLACK = 1e-9

State = dict[str, np.ndarray]


def whole(vector: Column) -> Column:
    """Components as floor(256 * x); null for a vector that is null or holds null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vector, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.greatest(F.lit(-2.0 * MOST), F.least(F.lit(2.0 * MOST), x.cast("double") * SCALE))))).cast("int"))
    return F.when(vector.isNotNull() & ~bad, ints)


# ---- one part --------------------------------------------------------------------------------------------------------


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """All squared distances of parts and entries, exact."""
    out = np.zeros((len(x), len(entries)), np.int64)
    for i in range(x.shape[1]):
        out += (x[:, i, None] - entries[None, :, i]) ** 2
    return out


def full_search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, squared distance, upper bound, lower bounds) by computing all distances."""
    d = squared(x, entries)
    code = d.argmin(axis=1)
    own = d[np.arange(len(x)), code]
    return code, own, np.sqrt(own) * (1 + SLACK), np.sqrt(d) * (1 - SLACK)


class Move:
    """A codebook part's step from old to new entries, as bounds need it."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.entries = new
        self.moved = np.sqrt(((new - old) ** 2).sum(axis=1)) * (1 + SLACK)
        self.half = np.sqrt(squared(new, new)) / 2 * (1 - SLACK)


def pruned_search(x: np.ndarray, move: Move, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """As full_search, from the bounds to the old entries; and how many distances to other entries were computed."""
    entries, rows = move.entries, np.arange(len(x))
    upper = upper + move.moved[code]
    lower = np.maximum(lower - move.moved, 0)

    def open_pairs(some: np.ndarray) -> np.ndarray:
        u = upper[some, None]
        pairs = (lower[some] <= u) & (move.half[code[some]] <= u)
        pairs[np.arange(len(some)), code[some]] = False
        return pairs

    # A part that no entry can win keeps its code; its squared distance is exact all the same.
    own = ((x - entries[code]) ** 2).sum(axis=1)
    some = rows[open_pairs(rows).any(axis=1)]
    upper = np.sqrt(own) * (1 + SLACK)  # tightened, then asked again
    r, c = np.nonzero(open_pairs(some))
    r = some[r]
    d = ((x[r] - entries[c]) ** 2).sum(axis=1)
    lower[r, c] = np.sqrt(d) * (1 - SLACK)
    lower[rows, code] = np.sqrt(own) * (1 - SLACK)
    best = np.full((len(x), len(entries)), np.iinfo(np.int64).max)
    best[rows, code] = own
    best[r, c] = d
    code = best.argmin(axis=1)  # the first of equals
    own = best[rows, code]
    return code, own, np.sqrt(own) * (1 + SLACK), lower, len(r)


# ---- bounds at rest --------------------------------------------------------------------------------------------------


def pack_bounds(upper: np.ndarray, lower: np.ndarray) -> State:
    """Upper bounds as 32-bit floats rounded up; lower bounds as bytes, in steps of a 255th of the part's greatest, rounded down."""
    step = np.nextafter((lower.max(axis=2) / 255).astype(np.float32), np.float32(0)) if lower.size else np.zeros(upper.shape, np.float32)
    with np.errstate(divide="ignore", invalid="ignore"):
        steps = np.where(step[..., None] > 0, np.floor(lower / step[..., None].astype(np.float64)), 0)
    return {"upper": np.nextafter(upper.astype(np.float32), np.float32(np.inf)), "step": step, "lower": np.minimum(steps, 255).astype(np.uint8)}


def unpack_bounds(state: State) -> tuple[np.ndarray, np.ndarray]:
    return state["upper"].astype(np.float64), state["lower"] * state["step"].astype(np.float64)[..., None] * (1 - SLACK)


# ---- the rounds ------------------------------------------------------------------------------------------------------

CODED = "vec_id long, label string, x binary, code binary, error long, upper binary, step binary, lower binary"
_ROW = {"code": (np.uint8, (PARTS,)), "upper": ("<f4", (PARTS,)), "step": ("<f4", (PARTS,))}


def _bytes(values: np.ndarray) -> pa.Array:
    """An array's first axis as rows of a binary column."""
    n = len(values)
    size = values[:1].nbytes
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, max(size, 1), dtype="<i4").tobytes() if size else bytes(4 * (n + 1))), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _rows(column: pa.Array, kind, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _components(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as (vectors, parts, width); shorter ones are filled with zeros."""
    ends, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    out = np.zeros((len(column), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < ends[:, None]] = flat
    return out.reshape(len(column), PARTS, width)


def _coder(width: int, books: np.ndarray, old: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Codes under ``books``: by full search, or from the bounds to the ``old`` books."""
    schema = to_arrow_schema(T.StructType.fromDDL(CODED))
    moves = None if old is None else [Move(old[p], books[p]) for p in range(PARTS)]

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, k = batch.num_rows, books.shape[1]
        x = _components(batch.column("x"), width) if old is None else _rows(batch.column("x"), "<i4", (PARTS, width)).astype(np.int64)
        codes, error = np.zeros((n, PARTS), np.int64), np.zeros(n, np.int64)
        uppers, lowers = np.zeros((n, PARTS)), np.zeros((n, PARTS, k))
        if old is not None:
            state = {name: _rows(batch.column(name), *_ROW[name]) for name in _ROW} | {"lower": _rows(batch.column("lower"), np.uint8, (PARTS, k))}
            was, (upper, lower) = state["code"].astype(np.int64), unpack_bounds(state)
        for p in range(PARTS):
            if old is None:
                found = full_search(x[:, p], books[p])
            else:
                found = pruned_search(x[:, p], moves[p], was[:, p], upper[:, p], lower[:, p])
            codes[:, p], own, uppers[:, p], lowers[:, p] = found[:4]
            error += own
        packed = pack_bounds(uppers, lowers)
        columns = {"x": x.reshape(n, -1).astype("<i4"), "code": codes.astype(np.uint8), **packed}
        made = {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "error": pa.array(error)}
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else _bytes(columns[f.name]) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield code(batch.slice(at, SLICE))

    return run


def _totals(width: int, k: int):
    """A task's sums and counts of the parts under each entry: 1,024 rows a part's component, whatever the task read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS * k, width), np.int64), np.zeros(PARTS * k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                entry = (_rows(part.column("code"), np.uint8, (PARTS,)).astype(np.int64) + k * np.arange(PARTS)).ravel()
                np.add.at(sums, entry, _rows(part.column("x"), "<i4", (PARTS, width)).reshape(-1, width).astype(np.int64))
                counts += np.bincount(entry, minlength=PARTS * k)
        used = np.flatnonzero(counts)
        at = np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_pydict({"entry": np.repeat(used, width), "at": at, "n": np.repeat(counts[used], width), "total": sums[used].ravel()})

    return run


def _moved(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by its parts' means, rounded down; unused ones stay. As many rows as the books have numbers come to the driver."""
    _, k, width = books.shape
    totals = coded.select("x", "code").mapInArrow(_totals(width, k), "entry long, at long, n long, total long")
    new = books.reshape(PARTS * k, width).copy()
    for r in totals.groupBy("entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        new[r.entry, r.at] = r.total // r.n
    return new.reshape(books.shape)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """One row per kept row of vectors(vec_id, <vector>, label): vec_id, code, error, label_error, codebooks_sha256.

    Rows are dropped whose vector is null or holds null or non-finite components. Null vec_ids come last where the
    smallest are chosen, rows of one vec_id by their components; repeated rows are coded each on its own. Vectors of
    other lengths than 16 equal parts of the longest are filled with zeros at their end. Fewer than 64 kept rows give
    as many entries. Labels are equal as text, nulls together. An empty table gives an empty result.

    A round reads the vectors, codes and bounds of the one before from files and writes its own; only sums by entry, a
    fixed number of rows a task, are shuffled and come to the driver.
    """
    x = whole(F.col(vector))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x")).filter("x IS NOT NULL")
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()
    books = np.zeros((len(first), PARTS * width), np.int64)
    for row, r in zip(books, first):
        row[: len(r.x)] = r.x
    books = books.reshape(len(first), PARTS, width).transpose(1, 0, 2)

    old, coded = None, kept
    for _ in range(rounds):
        before, coded = coded, staged(coded.mapInArrow(_coder(width, books, old), CODED), "codes")
        if old is not None:
            discard(before)
        old, books = books, _moved(coded, books)
    coded = staged(coded.mapInArrow(_coder(width, books, old), CODED).select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "coded")
    return _with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with ``label_error``, the sum of error over its label. Sums are made in the tasks before they shuffle."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if staged(sums, "label-errors").count() <= BROADCAST_ROWS:
        return coded.join(F.broadcast(sums), same)
    dealt = coded.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    copies = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_copy"))
    return dealt.join(copies, same & (F.col("_salt") == F.col("_copy")))
