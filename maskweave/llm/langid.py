"""Language identification of words and documents.

Scripts narrow the languages a word can be in; letter n-grams score it in each of these; a Viterbi pass over the words,
with a penalty for changing the language, labels the spans of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, map_batches, mix, staged, texts, whole_row

#: Cells of the hashed n-gram table: its size, 8 bytes a cell and language, is the model's size at any corpus size.
CELLS = 1 << 16
ORDERS = (1, 2, 3)
#: Nats that a change of language costs, and the least share of a script in a language's letters.
SWITCH = 6.0
SCRIPT_SHARE = 0.001
#: Languages that a model may hold; lang is a column of codes, and more of them point to an error in it.
MAX_LANGUAGES = 512
UNDETERMINED = "und"
#: Rejected texts up to here are broadcast by hash (8 bytes each) to the rows; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000

# First and last code point of the ranges of each script.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2AF), (0x1E00, 0x1EFF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x591, 0x5F4),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x2D00, 0x2D2F)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
OTHER = len(SCRIPTS)


def _script_table() -> np.ndarray:
    """For each code point: 0 if it is no letter, else 1 and the number of its script (OTHER: any further script)."""
    table = np.array([chr(c).isalpha() for c in range(0x110000)], np.uint8) * (OTHER + 1)
    for number, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            part = table[a : b + 1]
            part[part > 0] = number + 1
    return table


_TABLES: dict[str, np.ndarray] = {}


def script_table() -> np.ndarray:
    if "script" not in _TABLES:
        _TABLES["script"] = _script_table()
    return _TABLES["script"]


class Words:
    """The words (runs of letters) of some texts as flat arrays: word w is letters[first[w]:last[w]] of text document[w]."""

    def __init__(self, batch: list[str]):
        lowered = [t.lower() for t in batch]
        codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        script = script_table()[codes]
        letter = script > 0
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        self.codes, self.script = codes, script
        self.first, self.last = edge[::2], edge[1::2]
        starts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        self.document = np.searchsorted(starts, self.first, "right") - 1
        self.n_documents = len(batch)

    def blocks(self, letters: int = 100_000) -> Iterator[slice]:
        """Runs of words of about so many letters: what is computed of n-grams stays small however long a text is."""
        ends = np.cumsum(self.last - self.first)
        cuts = np.searchsorted(ends, np.arange(letters, int(ends[-1]) if len(ends) else 0, letters))
        cuts = np.unique(np.concatenate([[0], cuts, [len(ends)]]))
        yield from map(slice, cuts[:-1].tolist(), cuts[1:].tolist())

    def cells(self, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The table cells of all n-grams of some words, a blank before and after each, and each n-gram's word in that run."""
        first, last = self.first[part], self.last[part]
        lengths = last - first
        padded = np.zeros(int(lengths.sum() + 2 * len(lengths)), np.uint64)
        word = np.repeat(np.arange(len(lengths)), lengths + 2)
        ends = np.cumsum(lengths + 2)
        inside = np.ones(len(padded), bool)
        inside[ends - 1] = inside[ends - lengths - 2] = False
        padded[inside] = self.codes[np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))]
        found, words = [], []
        for n in ORDERS:
            if len(padded) < n:
                continue
            key = np.full(len(padded) - n + 1, n, np.uint64)
            for i in range(n):
                key = key * np.uint64(MULTIPLIER) + padded[i : len(padded) - n + 1 + i]
            whole = word[: len(key)] == word[n - 1 :]
            found.append((mix(key[whole]) & np.uint64(CELLS - 1)).astype(np.int64))
            words.append(word[: len(key)][whole])
        return (np.concatenate(found), np.concatenate(words)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))

    def word_scripts(self) -> np.ndarray:
        """Each word's script: that of its first letter."""
        return self.script[self.first] - 1 if len(self.first) else np.empty(0, np.int64)


def _slices(texts_: list[str], size: int = 1_000_000):
    """Runs of texts with about ``size`` code points each, so that arrays stay small however long a batch is."""
    begin, total = 0, 0
    for i, t in enumerate(texts_):
        total += len(t)
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts_):
        yield begin, len(texts_)


def _count(batches):
    """By language: how often each cell and each script occurs, as blocks of little-endian 64-bit counts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, own in by_lang.items():
            total = sums.setdefault(lang, np.zeros(CELLS + OTHER + 1, np.int64))
            for a, b in _slices(own):
                words = Words(own[a:b])
                for part in words.blocks():
                    total[:CELLS] += np.bincount(words.cells(part)[0], minlength=CELLS)
                total[CELLS:] += np.bincount(words.word_scripts(), minlength=OTHER + 1)
    for lang, total in sums.items():
        parts = np.array_split(total, 16)
        yield {"lang": [lang] * 16, "part": range(16), "counts": [p.astype("<i8").tobytes() for p in parts]}


def _add(pdf):
    return pdf.iloc[:1].assign(counts=np.sum([np.frombuffer(c, "<i8") for c in pdf["counts"]], axis=0).astype("<i8").tobytes())


class Model:
    """Per language: log probabilities of n-gram cells, and which scripts it is written in."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        n = np.array([counts[x][:CELLS] for x in self.languages], np.float64).reshape(len(self.languages), CELLS)
        # What the languages' own texts reach: mean and variance of an n-gram's score, and by how much a text that wasn't
        # learned falls below because its n-grams were not counted.
        share, log = n / np.maximum(n.sum(1, keepdims=True), 1), np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * CELLS))
        self.mean = (share * log).sum(1)
        self.variance = (share * (log - self.mean[:, None]) ** 2).sum(1)
        self.unseen = (share * np.log((n + 0.5) / np.maximum(n - 0.5, 0.5))).sum(1)
        self.scores = np.ascontiguousarray(np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * CELLS)).T.astype(np.float32))
        scripts = np.array([counts[x][CELLS:] for x in self.languages], np.float64).reshape(len(self.languages), OTHER + 1)
        self.written = (scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= SCRIPT_SHARE).T

    def word_scores(self, words: Words) -> np.ndarray:
        """Each word's score in each language; in a language that isn't written in its script, far below all others."""
        out = np.empty((len(words.first), len(self.languages)))
        for part in words.blocks():
            cells, word = words.cells(part)
            for k in range(len(self.languages)):
                out[part, k] = np.bincount(word, self.scores[cells, k], part.stop - part.start)
        allowed = self.written[words.word_scripts()]
        out[~allowed & allowed.any(1)[:, None]] -= 1e3
        return out


def viterbi(scores: np.ndarray, document: np.ndarray, n_documents: int, switch: float = SWITCH) -> np.ndarray:
    """The best language number for each word, over all texts at once: step t handles the t-th word of every text."""
    lengths = np.bincount(document, minlength=n_documents)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    lengths = lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts with more than t words
    best = np.zeros((n_documents, scores.shape[1]))
    came_from = np.empty(scores.shape, np.int16)
    own = np.arange(scores.shape[1])
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        now = best[:n]
        top = now.argmax(1)
        top_score = np.take_along_axis(now, top[:, None], 1) - switch
        moves = now < top_score
        came_from[at] = np.where(moves, top[:, None], own)
        best[:n] = np.where(moves, top_score, now) + scores[at]
    labels = np.empty(len(document), np.int64)
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        at = begin[: active[t]] + t
        labels[at] = state[: active[t]]
        state[: active[t]] = came_from[at, state[: active[t]]]
    return labels


def train(docs: DataFrame) -> Model:
    """A model from (text, lang) rows; rows with a null in either teach nothing. Tasks send sums of one fixed size."""
    rows = docs.select("text", "lang").dropna()
    summed = map_batches(rows, _count, "lang string, part long, counts binary").groupBy("lang", "part").applyInPandas(_add, "lang string, part long, counts binary")
    by_lang: dict[str, list] = {}
    for r in summed.orderBy("lang", "part").limit(16 * MAX_LANGUAGES + 1).collect():
        by_lang.setdefault(r.lang, []).append(np.frombuffer(r.counts, "<i8"))
    if len(by_lang) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    return Model({lang: np.concatenate(parts) for lang, parts in by_lang.items()})


def _labelled(batches, model: Model):
    """For slices of a batch: its bounds, the words, each word's language number, and its score in that language."""
    for batch in batches:
        for a, b in _slices(batch["text"]):
            words = Words(batch["text"][a:b])
            scores = model.word_scores(words)
            labels = viterbi(scores, words.document, words.n_documents)
            yield batch, a, b, words, labels, np.take_along_axis(scores, labels[:, None], 1)[:, 0]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of _predict()."""
    return _predict(docs.select("doc_id", "text"), model).drop("shortfall", "label")


def _predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs(doc_id, text): lang_pred, the language of most letters, and score, its share of them.

    Null and empty texts, and texts without a letter, are ``und`` with score 0, as is every text under a model without
    languages. Equal shares go to the language that is first by name. ``shortfall`` is by how much the text's mean score
    an n-gram lies below that of the language's own texts, less what a text of its length may by chance. ``label`` is passed on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        model = shared.value
        names = [*model.languages, UNDETERMINED]
        if not model.languages:
            yield from ({"doc_id": b["doc_id"], "lang_pred": [UNDETERMINED] * len(b["text"]), "score": [0.0] * len(b["text"]), "shortfall": [0.0] * len(b["text"]), "label": b["label"]} for b in batches)
            return
        for batch, a, b, words, labels, own in _labelled(batches, model):
            cell = words.document * len(model.languages) + labels
            letters = np.bincount(cell, words.last - words.first, words.n_documents * len(model.languages)).reshape(-1, len(model.languages))
            total = letters.sum(1)
            lang = np.where(total > 0, letters.argmax(1), len(model.languages))
            # A word of n letters, a blank before and after it, has 3n + 3 n-grams of one to three.
            grams = np.maximum(3 * (total + np.bincount(words.document, minlength=words.n_documents)), 1)
            k = np.minimum(lang, len(model.languages) - 1)
            below = model.mean[k] - np.bincount(words.document, own, words.n_documents) / grams
            chance = CHANCE * np.sqrt(len(ORDERS) * model.variance[k] / grams)
            shortfall = np.where(total > 0, below - model.unseen[k] - chance, 0.0)
            yield {"doc_id": batch["doc_id"][a:b], "lang_pred": [names[i] for i in lang], "score": letters.max(1) / np.maximum(total, 1), "shortfall": shortfall, "label": batch["label"][a:b]}

    label_of = F.col("label") if "label" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), label_of.alias("label"))
    return map_batches(rows, label, "doc_id long, lang_pred string, score double, shortfall double, label string")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """The labelled spans of each text: doc_id, first_word, last_word (counted from 0), lang.

    Null and empty texts, and such without a word, have none, so they have no row; repeated rows and null doc_ids are
    labelled each on its own. An empty table, and a model without languages, give an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        for batch, a, _, words, labels, _ in _labelled(batches, shared.value):
            edge = np.flatnonzero((np.diff(words.document, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
            ends = np.append(edge[1:], len(labels)) - 1
            before = np.searchsorted(words.document, words.document[edge])
            yield {
                "doc_id": [batch["doc_id"][a + d] for d in words.document[edge]],
                "first_word": edge - before,
                "last_word": ends - before,
                "lang": [shared.value.languages[k] for k in labels[edge]],
            }

    return map_batches(texts(docs), label, "doc_id long, first_word long, last_word long, lang string")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether the row may teach nothing; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, then predict all: one row per row, doc_id, held_out, lang_pred, score.

    Null and empty texts, and such without a letter, are ``und`` with a score of 0; so is everything where no row has a
    language to learn. Rows with a null doc_id are not held out; repeated rows are predicted each on its own. An empty
    table gives an empty result. Other columns than doc_id, text and lang are not looked at.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Below this share of the letters no language is the text's main one.
LEAST_SHARE = 0.3
#: Standard deviations that a text's mean score may lie below its language's by chance; the n-grams of one to three
#: letters that share a letter count as one draw.
CHANCE = 4.0
#: Nats an n-gram that a text may lie below that, as its style or subject may differ; where the language's own texts
#: differ more (SPREAD times their upper quartile's distance from the median), as much as they do.
SLACK, SPREAD = 0.6, 6.0


def accepted(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs whose text has a main language, with all their columns.

    The model learns from the labelled rows that aren't held out. Rows without a letter go, such in which no language
    has the share ``least`` of the letters, and such whose likelihood is far below what the texts of their language
    reach: random letters, and languages that weren't learned. Short texts show less, so of a word or two nearly all
    stay. A row with a null or unknown lang is judged like any other. Decisions meet the rows by a hash of the text:
    what is rejected depends on the text and the model alone.
    """
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    taught = F.when(~held_out(F.col("doc_id")), F.col("lang").cast("string"))
    hashed = docs.select(F.xxhash64(F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))).alias("doc_id"), "text", taught.alias("label"))
    judged = staged(_predict(hashed, model), "judged")
    quartiles = judged.filter("label = lang_pred").groupBy("lang_pred").agg(F.percentile_approx("shortfall", [0.5, 0.75]).alias("q"))
    allowed = F.lit(SLACK)
    for r in quartiles.collect():
        allowed = F.when(F.col("lang_pred") == r.lang_pred, SLACK + max(0.0, r.q[0] + SPREAD * (r.q[1] - r.q[0]))).otherwise(allowed)
    bad = (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < least) | (F.col("shortfall") > allowed)
    rejected = staged(judged.filter(bad).select(F.col("doc_id").alias("_hash")).distinct(), "rejected")
    if rejected.count() <= BROADCAST_ROWS:
        rejected = F.broadcast(rejected)
    own = docs.select(whole_row(), F.xxhash64(F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))).alias("_own"))
    return own.join(rejected, F.col("_own") == F.col("_hash"), "left_anti").select("_row.*")
