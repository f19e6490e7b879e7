"""Term lists of any size: runs of tokens looked up in a dictionary, the longest from the left, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import HITS
from ..functions.text import normalise
from .term_file import Dictionary, Terms, build

#: Terms of more words never match.
MOST_WORDS = 6
TOKEN = r"[\p{L}\p{Nd}-]+"
#: Tokens that a worker remembers with what it knows of them, and their letters at most; then it forgets all and starts anew.
REMEMBERED, REMEMBERED_LETTERS = 200_000, 64

#: Texts of a batch that a worker holds as Python objects at once, and their bytes; a single longer one is held by itself.
ROWS, BYTES = 1_000, 4_000_000

_TOKENS, _PARTS = regex.compile(TOKEN), regex.compile(r"[^\p{L}\p{N}]+")


def dictionary(terms: DataFrame, column: str = "term") -> DataFrame:
    """(norm, raw, n_words): one row per normalised term of up to MOST_WORDS words, raw the least spelling."""
    norm = normalise(F.col(column))
    rows = terms.select(norm.alias("norm"), F.col(column).alias("raw")).filter("norm != ''")
    return rows.groupBy("norm").agg(F.min("raw").alias("raw")).withColumn("n_words", F.size(F.split("norm", " "))).filter(F.col("n_words") <= MOST_WORDS)


class Tokens(dict):
    """(normal form, most words of a term that it begins) of tokens, remembered for those met last."""

    def __init__(self, terms: Terms):
        self.terms = terms

    def __missing__(self, token: str) -> tuple[str, int]:
        norm = " ".join(_PARTS.split(token.lower())).strip() if "-" in token else token.lower()
        known = norm, self.terms.words(norm.partition(" ")[0]) if norm else 0
        if len(token) <= REMEMBERED_LETTERS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = known
        return known


def search(text: str, terms: Terms, tokens: Tokens, most: int) -> list[tuple[int, int, str]]:
    """(start, length, spelling) of the terms in a text: from each token on the longest run that is a term; then on behind it."""
    words = _TOKENS.findall(text)
    known = [tokens[w] for w in words]
    if not any(k[1] for k in known):
        return []
    starts, at, find = [], 0, text.find
    for w in words:  # tokens are whole runs, so the next place of a token's letters is the token's own
        at = find(w, at)
        starts.append(at)
        at += len(w)
    out, i, n = [], 0, len(words)
    while i < n:
        norm, longest = known[i]
        if not longest:
            if norm:
                i += 1
                continue
            # Hyphens alone may stand before a term's first word.
            longest = next((k[1] for k in known[i + 1 : i + most] if k[0]), 0)
        runs, parts, count = [], [], 0
        for j in range(i, min(i + most, n) if longest else i):
            if part := known[j][0]:
                parts.append(part)
                count += part.count(" ") + 1
                if count > longest:
                    break
            runs.append(" ".join(parts))
        width = len(runs)
        while width and (not runs[width - 1] or (raw := terms.get(runs[width - 1])) is None):
            width -= 1
        if width:
            last = i + width - 1
            out.append((starts[i], starts[last] + len(words[last]) - starts[i], raw))
        i += width or 1
    return out


def finder(terms: DataFrame | Dictionary) -> Callable[[Column], Column]:
    """A function from texts to their hits by a dictionary() of any size; it looks at each row by itself, so it serves streams as well."""
    ready = terms if isinstance(terms, Dictionary) else build(terms, MOST_WORDS)

    @F.arrow_udf(HITS)
    def find(texts: pa.Array) -> pa.Array:
        opened = ready.open()
        tokens = vars(opened).setdefault("tokens", Tokens(opened))  # kept from batch to batch
        return pa.concat_arrays([_hits([search(t, opened, tokens, ready.most) if t else [] for t in part.to_pylist()]) for part in _parts(texts)])

    return find


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in runs of at most ROWS texts and about BYTES bytes; at least one run, which may be empty."""
    ends, begin = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)), 0
    while True:
        fit = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BYTES, "right"))
        end = min(max(fit, begin + 1), begin + ROWS, len(texts))
        yield texts.slice(begin, end - begin)
        if end >= len(texts):
            return
        begin = end


def _hits(found: list[list[tuple[int, int, str]]]) -> pa.Array:
    flat = [h for hits in found for h in hits]
    start, length, value = zip(*flat) if flat else ((), (), ())
    rows = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(value, pa.string())], ["start", "length", "value"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), rows)


def term_hits(docs: DataFrame, terms: DataFrame | Dictionary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hits) for the rows of docs whose text holds terms of a dictionary(); null and repeated keys are as good as others.

    Tokens are runs of letters, digits and hyphens; ``value`` is the dictionary's spelling. A deterministic search would
    be copied into the filter as well: each text searched twice, by two Python workers a task.
    """
    return docs.select(key, finder(terms).asNondeterministic()(F.col(text)).alias("hits")).filter(F.size("hits") > 0)
