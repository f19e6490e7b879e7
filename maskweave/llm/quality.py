"""Document quality by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and some pairs of features a table over coarse bins. Shallow trees,
boosted in cycles over features and then over pairs, add up to these tables; a score is a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

#: Labelled rows that a model is fitted on, those first by a hash of doc_id; with FEATURES doubles a row on the driver.
TRAIN_ROWS = 60_000
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 60, 0.15, 3
FEATURES = (
    "log_chars", "letters", "digits", "upper", "spaces", "punctuation", "symbols", "beyond_ascii", "log_words", "word_length",
    "distinct_words", "commonest_word", "log_lines", "words_a_line", "repeated_lines", "commonest_line", "full_stops", "symbol_words", "short_words",
)
_CLASSES = ("letters", "digits", "upper", "spaces", "punctuation", "symbols", "beyond_ascii")


def _class_table() -> np.ndarray:
    table = np.zeros((128, len(_CLASSES)), np.int64)
    for i in range(128):
        c = chr(i)
        table[i] = (c.isalpha(), c.isdigit(), c.isupper(), c.isspace(), c in ".,;:!?'\"()-", c.isprintable() and not c.isalnum() and c not in " .,;:!?'\"()-", 0)
    return table


_TABLE = _class_table()


def features(text: str) -> list[float]:
    """FEATURES of one text; an empty text has zeros. Rates lie between 0 and 1."""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = np.bincount(codes[codes < 128], minlength=128) @ _TABLE
    plain[0] += n - int((codes < 128).sum())
    plain[-1] = n - int((codes < 128).sum())
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, m = len(words), len(lines)
    counted, line_counts = Counter(words), Counter(lines)
    return [
        np.log1p(n), *(plain / max(n, 1)), np.log1p(w), n / max(w, 1),
        len(counted) / max(w, 1), max(counted.values(), default=0) / max(w, 1),
        np.log1p(m), w / max(m, 1), 1 - len(line_counts) / max(m, 1), max(line_counts.values(), default=0) / max(m, 1),
        text.count(".") / max(w, 1), sum(c for x, c in counted.items() if not x[-1].isalnum() and x[-1] not in ".,;:!?'\")") / max(w, 1),
        sum(c for x, c in counted.items() if len(x) <= 3) / max(w, 1),
    ]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = LEAVES, l2: float = 1.0) -> np.ndarray:
    """A shallow regression tree over ordered bins, from sums of gradient and hessian: each bin's leaf value."""
    cuts = [(0, len(grad))]
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in cuts:
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = (g[at] - g[a]) ** 2 / (h[at] - h[a] + l2) + (g[b] - g[at]) ** 2 / (h[b] - h[at] + l2) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + l2)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (a, a + 1 + i, b))
        if best[1] is None:
            break
        a, m, b = best[1]
        cuts.remove((a, b))
        cuts += [(a, m), (m, b)]
    out = np.zeros(len(grad))
    for a, b in cuts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + l2)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """A tree of one split along each of two features: the best four quadrants, as a table, and their gain."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)

    def quadrants(s):
        a, rows, columns, every = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        return a, rows - a, columns - a, every - rows - columns + a

    gain = sum(x**2 / (y + l2) for x, y in zip(quadrants(g), quadrants(h), strict=True))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [x[i, j] / (y[i, j] + l2) for x, y in zip(quadrants(g), quadrants(h), strict=True)]
    out = np.empty(grad.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return out, float(gain[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + l2))


class Additive:
    """base + a table entry for each feature's bin + one for each chosen pair of coarse bins; see fit()."""

    def __init__(self, edges: list[np.ndarray], coarse: list[np.ndarray], base: float):
        self.edges, self.coarse, self.base = edges, coarse, base
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, k], "right")]
        for (i, j), t in self.pairs.items():
            total += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return _sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boost tables for the log odds of y (0 or 1). Without rows, or with one class, the model is (nearly) constant."""
    if not len(x):
        return Additive([np.empty(0)] * len(FEATURES), [np.empty(0)] * len(FEATURES), 0.0)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    cut = lambda n: [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1])) for k in range(x.shape[1])]
    model = Additive(cut(BINS), cut(PAIR_BINS), float(np.log(mean / (1 - mean))))
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    total = np.full(len(x), model.base)
    for _ in range(ROUNDS):
        for k, (b, table) in enumerate(zip(bins, model.tables, strict=True)):
            p = _sigmoid(total)
            step = RATE * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)))
            model.tables[k] = table + step
            total += step[b]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.coarse)]
    shape = {(i, j): (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1) for i, j in combinations(range(x.shape[1]), 2)}
    cell = {p: coarse[p[0]] * s[1] + coarse[p[1]] for p, s in shape.items() if min(s) > 1}

    def tree(pair):
        p = _sigmoid(total)
        n = shape[pair]
        return _pair_tree(np.bincount(cell[pair], y - p, n[0] * n[1]).reshape(n), np.bincount(cell[pair], p * (1 - p), n[0] * n[1]).reshape(n))

    chosen = sorted(cell, key=lambda pair: -tree(pair)[1])[:PAIRS]
    for _ in range(PAIR_ROUNDS):
        for pair in chosen:
            step = RATE * tree(pair)[0]
            model.pairs[pair] = model.pairs.get(pair, 0) + step
            total += step.ravel()[cell[pair]]
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the row's label may teach nothing; a null doc_id has no label and is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Additive:
    """Fit on at most ``rows`` labelled texts that aren't held out; labels(doc_id, quality) other than 0 and 1 are unused.

    Labels are bounded first, then the rows that they meet: a doc_id may repeat, in docs as in labels. Features are made
    where the texts lie, and only those of the bounded rows come to the driver. Null doc_ids teach nothing; an empty
    table gives a model that knows only the base rate.
    """
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    taught = taught.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = taught.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)

    def featured(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "quality": b["quality"], "x": [features(t) for t in b["text"]]}

    met = map_batches(texts(docs).join(F.broadcast(sample), "doc_id"), featured, "doc_id long, quality int, x array<double>")
    found = met.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "quality").limit(rows).select("quality", "x").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T[::-1])  # the order of arrival decides nothing
    return fit(x[order], found.column("quality").to_numpy()[order].astype(np.float64))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """One row per row of docs(doc_id, text): score (0 to 1, higher: better) and predicted (score of 0.5 or more).

    Null counts as the empty text, which is scored too; repeated rows and null doc_ids are scored each on its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for b in batches:
            s = shared.value.score(np.array([features(t) for t in b["text"]], np.float64).reshape(-1, len(FEATURES)))
            yield {"doc_id": b["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return map_batches(texts(docs), scored, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. If a doc_id repeats, the rows' texts are each taught its label."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
