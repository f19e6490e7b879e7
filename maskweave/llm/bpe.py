"""BPE encoding and decoding with a memory-mapped minimal acyclic transducer of frequent words.

The corpus's frequent words are compiled into an automaton whose states are shared between equal suffixes; each word
has a number (its rank among the sorted words, summed along its path), and the number leads to its token ids. Words
that the automaton does not hold are merged exactly, pair by pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import sys
import tempfile
import unicodedata
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .common import KEPT, map_batches, release, staged, texts

#: Words in the automaton: with their ids a few MB, broadcast to the executors.
LEXICON_WORDS = 65_536
#: Bytes of words and their ids that a Python worker remembers beside the automaton, whatever the words' lengths. Words of
#: more letters are neither remembered nor counted: they are merged anew in n log n steps.
REMEMBERED_BYTES, WORD_LETTERS = 50_000_000, 48

# White space (Unicode's, as the vocabulary's normaliser has it) and the pieces that text is cut into.
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")


# The same pieces among the characters up to 0xFF in lower case, where the standard library's engine is faster.
LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa00-9\xb2\xb3\xb9\xbc-\xbea-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
# Characters that every Unicode version of the last years has, with the same class and lower case.
COMMON = regex.compile(r"[\x00-\u0377\u0391-\u0556\u1E00-\u1F15\u2000-\u2063\u20A0-\u20BD\u2100-\u2188\u2190-\u23E0\u2600-\u26FF\u3041-\u3096\u30A1-\u30FE\u4E00-\u9FA5\uAC00-\uD7A3\uFF01-\uFF5E\U0001F300-\U0001F64F]*+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes are their own, the others follow from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A vocabulary file's ids, merges and special tokens, and the exact merging of one word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs] + [-1]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in {**self.ids, **self.special}.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = byte_letters()
        self.inner, self.last = [self.ids.get(x) for x in letters], [self.ids.get(x + self.end) for x in letters]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True).pre_tokenize_str

    def letter_ids(self, word: str) -> list[int]:
        data, inner = word.encode("utf-8", "surrogatepass"), self.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        return [x for x in ids if x is not None] if None in ids else ids

    def merge(self, word: str) -> list[int]:
        """The ids of one word: always the leftmost pair of the lowest rank is merged, until none is left."""
        ids, made, rank = self.letter_ids(word), self.made, self.ranks.get
        never = len(made) - 1
        ranks = [rank(p, never) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            ids[i] = new = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], new), never)
            if i < len(ranks):
                ranks[i] = rank((new, ids[i + 1]), never)
        return ids

    def merge_long(self, word: str) -> list[int]:
        """As merge, in n log n steps: for long runs without a break."""
        ids = self.letter_ids(word)
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(self.ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (p := (ids[left], ids[right])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], left, *p))
        return [x for x in ids if x >= 0]

    def exact(self, word: str) -> list[int]:
        return self.merge(word) if len(word) <= WORD_LETTERS else self.merge_long(word)

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens' strings among them as they are.

        Characters that Unicode versions may class in different ways are left to the library's own normaliser and splitter.
        """
        parts = self.cut.split(text) if self.cut.search(text) else [text]
        out: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(part)
            elif _latin(part):
                out += LATIN_WORD.findall(part.lower())
            elif COMMON.fullmatch(part):
                out += WORD.findall(plain_form(part))
            else:
                out += [w for w, _ in self.split(self.normalise(part))]
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def plain_form(text: str) -> str:
    """NFC, then lower case letter by letter (no final sigma). White space only parts words, so runs stay as they are."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    vocab = Vocabulary(path)
    release()  # the file as it was parsed
    return vocab


# ---- the automaton -------------------------------------------------------------------------------------------------


def compile_lexicon(entries: list[tuple[str, list[int]]]) -> bytes:
    """(word, ids) entries as one block of bytes: a minimal acyclic automaton over UTF-8 bytes, then the ids by number.

    Words are added in byte order; when the next word leaves a branch, its states are final and each is replaced by an
    equal one if there is one, so suffixes are stored once. A transition carries how many words lie before it under
    its state; the sum along a word's path is the word's number.
    """
    entries = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    words_below: list[int] = []

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            words_below.append(final + sum(words_below[t] for _, t in arcs))
        return register[key]

    path: list[list] = [[False, [], -1]]  # final, frozen arcs, the byte that leads on
    last = b""
    for word, _ in entries:
        same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        while len(path) - 1 > same:
            final, arcs, _ = path.pop()
            path[-1][1].append((path[-1][2], freeze(final, arcs)))
        for byte in word[same:]:
            path[-1][2] = byte
            path.append([False, [], -1])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        final, arcs, _ = path.pop()
        path[-1][1].append((path[-1][2], freeze(final, arcs)))
    root = freeze(path[0][0], path[0][1])

    first, labels, targets, skips = [0], [], [], []
    for final, arcs in states:
        before = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(before)
            before += words_below[target]
        first.append(len(labels))
    starts = np.cumsum([0, *(len(ids) for _, ids in entries)])
    flat = [i for _, ids in entries for i in ids]
    arrays = [np.array(x, "<u4") for x in (first, [f for f, _ in states], targets, skips, starts, flat)]
    head = np.array([root, *(len(a) for a in arrays)], "<u4")
    return head.tobytes() + b"".join(a.tobytes() for a in arrays) + bytes(labels)


class Lexicon:
    """A compiled lexicon, read in place from a memory-mapped file."""

    def __init__(self, buffer: mmap.mmap):
        head = np.frombuffer(buffer, "<u4", 7)
        self.root, at, views = int(head[0]), 28, []
        for n in head[1:].tolist():
            views.append(memoryview(buffer)[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.final, self.targets, self.skips, self.starts, self.flat = views
        self.find, self.labels = buffer.find, at

    def number(self, word: bytes) -> int:
        """The word's rank among the lexicon's words, or -1."""
        state, total = self.root, 0
        for i in range(len(word)):
            arc = self.find(word[i : i + 1], self.labels + self.first[state], self.labels + self.first[state + 1]) - self.labels
            if arc < 0:
                return -1
            total += self.skips[arc]
            state = self.targets[arc]
        return total if self.final[state] else -1

    def ids(self, word: str) -> list[int] | None:
        n = self.number(word.encode("utf-8", "surrogatepass"))
        return None if n < 0 else self.flat[self.starts[n] : self.starts[n + 1]].tolist()


@lru_cache(maxsize=2)
def mapped(block: bytes) -> Lexicon:
    """The lexicon over a map of a file in the task's own temporary folder; the file's name goes at once."""
    with tempfile.NamedTemporaryFile(delete=False) as f:
        f.write(block)
    try:
        with open(f.name, "rb") as f:
            return Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    finally:
        os.unlink(f.name)


# ---- encoding and decoding -----------------------------------------------------------------------------------------


class Memory(dict):
    """What ``make`` gives for a word, remembered for the words met last.

    Two generations of half of REMEMBERED_BYTES each: when the newer is full, the older goes, and words of it that were
    met again are in the newer.
    """

    #: What a word takes beside its letters and its ids: its place in the dict.
    PLACE = 48

    def __init__(self, make):
        self.make, self.older, self.bytes = make, {}, 0

    def __missing__(self, word: str):
        value = self.older.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= WORD_LETTERS:
            self.bytes += (size := sys.getsizeof(word) + sys.getsizeof(value) + self.PLACE)
            if self.bytes > REMEMBERED_BYTES // 2:
                self.older, self.bytes = dict(self), size
                self.clear()
            self[word] = value
        return value


class Encoder:
    def __init__(self, path: str, lexicon: Lexicon | None = None):
        self.vocabulary = vocabulary(path)
        self.lexicon = lexicon
        self.decimals = Memory(lambda w: " ".join(map(str, self.word_ids(w))))
        self.packed = Memory(lambda w: array("I", self.word_ids(w)).tobytes())

    def word_ids(self, word: str) -> list[int]:
        if word in self.vocabulary.special:
            return [self.vocabulary.special[word]]
        ids = self.lexicon.ids(word) if self.lexicon else None
        return self.vocabulary.exact(word) if ids is None else ids

    def encode(self, text: str) -> str:
        """The ids as decimals with spaces between."""
        return " ".join(map(self.decimals.__getitem__, self.vocabulary.words(text)))

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.vocabulary.words(text)))


@lru_cache(maxsize=2)
def encoder(path: str, block: bytes | None = None) -> Encoder:
    """A worker's encoder, which keeps from task to task what it remembers."""
    return Encoder(path, None if block is None else mapped(block))


KEPT["encoder"] = encoder.cache_clear


class Decoder:
    def __init__(self, path: str):
        strings = vocabulary(path).strings
        self.string = {str(i): s for i, s in strings.items()}

    def decode(self, ids: str) -> str:
        """The tokens' strings with spaces between: this vocabulary names no decoder that would join them."""
        return " ".join(map(self.string.__getitem__, ids.split()))


def _short(counts: Counter[str]) -> dict[str, list]:
    words = [w for w in counts if len(w) <= WORD_LETTERS]
    return {"word": words, "n": [counts[w] for w in words]}


def _count(path: str):
    def count(batches):
        cut, n = vocabulary(path).words, Counter()
        for batch in batches:
            for text in batch["text"]:
                n.update(cut(text))
            if len(n) > 4 * LEXICON_WORDS:
                yield _short(n)
                n = Counter()
        yield _short(n)

    return count


def frequent_words(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> list[str]:
    """At most ``size`` words of WORD_LETTERS letters at most, the most frequent over all texts. Tasks send counts, not words.

    A histogram of counts (each below 1024, then 64 steps a doubling: a few thousand rows at any corpus size) tells the
    least count that leaves ``size`` words; only these come to the driver.
    """
    counted = map_batches(texts(docs).select("text"), _count(path), "word string, n long")
    counted = staged(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 64))
    left, least = size, None
    for r in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):
        left -= r.words
        if left < 0:
            break
        least = r.level
    return [] if least is None else [r.word for r in counted.filter(level >= least).select("word").collect()]


def build_lexicon(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    vocab = vocabulary(path)
    words = [w for w in frequent_words(docs, path, size) if w not in vocab.special]
    return compile_lexicon([(w, vocab.exact(w)) for w in words])


def _sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of docs(doc_id, text): number of ids, and digests of the ids and of what they decode to.

    Null and empty texts, and texts of white space, have no ids. Repeated rows and null doc_ids are coded each on its
    own; an empty table gives an empty result. Two passes over the texts, one to count words; only counts shuffle.
    """
    block = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path))

    def code(batches):
        encode, decoder = encoder(path, block.value).encode, Decoder(path)
        for batch in batches:
            ids = [encode(t) for t in batch["text"]]
            yield {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(x) and x.count(" ") + 1 for x in ids],
                "ids_sha256": [_sha256(x) for x in ids],
                "decoded_sha256": [_sha256(decoder.decode(x)) for x in ids],
            }

    return map_batches(texts(docs), code, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keep="encoder")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs' doc_id with ``ids array<int>``; null and empty texts have no ids."""
    block = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path))

    def code(batches):
        packed = encoder(path, block.value).encode_packed
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "ids": [np.frombuffer(packed(t), "<i4") for t in batch["text"]]}

    return map_batches(texts(docs), code, "doc_id long, ids array<int>", keep="encoder")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) to doc_id with ``text``; null ids are none."""

    def code(batches):
        strings = vocabulary(path).strings
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "text": [" ".join(strings[i] for i in ids or ()) for ids in batch["ids"]]}

    return map_batches(encoded.select("doc_id", "ids"), code, "doc_id long, text string")
