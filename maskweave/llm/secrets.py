"""Secret scan: fixed credential forms, and windows of high Shannon entropy in other long strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_batches, texts

# The forms every scan reports.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Fixed values: (class, its characters, window, least bits a character); the first class that holds a whole string is used.
CLASSES = (
    ("digits", frozenset("0123456789"), 24, math.inf),
    ("hex", frozenset("0123456789abcdefABCDEF"), 24, 3.0),
    ("alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 20, 3.6),
    ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"), 20, 3.6),
)
# Strings that look random and are no secrets. A word allows what is near it, and no more: a longer string
# that holds one is searched all the same.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # a UUID
    r"|.{0,40}(?i:example|placeholder|xxxxxx|changeme|your[-_]).{0,40}"
    r"|(?:0123456789|abcdefghij|ABCDEFGHIJ).{0,60}"
)

# Pairs of letters that words, names and identifiers are made of; of random letters one pair in four is one.
PAIRS = frozenset(
    "ab ac ad ag ai al am an ap ar as at ba be bl bo bu by ca ce ch ck cl co ct da de di do ds ea ec ed ee ef eg el em en ep er es et ex ey fa ff fi fo ge gr ha he hi ho ht ia ic id ie if ig il im"
    " in io is it ke la ld le lf li ll lo ls lt lu ma mb me mi mm mo mp na nc nd ne ng ni no ns nt nu oc od ok ol om on op or os ot ou ow pa pe pl po pr ps pt pu py qu ra rc rd re ri rm rn ro rr rs"
    " rt ru sc se sh si so sp ss st su ta tc te th ti to tr ts tt tu ty ua ue ui ul um un up ur us ut va ve wh wi wo xe xt yg yp yw".split()
)
#: A window is made of words if at least this share of its pairs of letters are among PAIRS and no change to upper case.
WORDLIKE = 0.5
#: Strings with fewer digits are tested for words.
FEW_DIGITS = 4


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed forms, by start, then kind as listed; kinds are searched apart and may overlap."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _excess(s: str) -> list[float]:
    """Prefix sums over the pairs of characters of s: below 0 over a range that is made of words by WORDLIKE, or just 0."""
    out = [0.0]
    for a, b in zip(s, s[1:], strict=False):
        if a.isalpha() and b.isalpha():
            like = (a + b).lower() in PAIRS and not (a.islower() and b.isupper())
            out.append(out[-1] + WORDLIKE - like)
        else:
            out.append(out[-1])
    return out


def entropy_windows(s: str, window: int, least: float, spare_words: bool = False) -> Iterator[tuple[int, int]]:
    """Maximal unions of overlapping windows of s whose entropy is at least ``least`` bits a character.

    With ``spare_words``, windows that are made of words are none. The sum of n·log2(n) over the window's counts is carried from one window to the next: a step changes two counts.
    """
    if len(s) < window:
        return
    n_log = [0.0, 0.0] + [n * math.log2(n) for n in range(2, window + 2)]
    counts: dict[str, int] = {}
    total, begin, end = 0.0, -1, -1
    excess = _excess(s) if spare_words else None
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += n_log[n + 1] - n_log[n]
        if i >= window:
            old = s[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += n_log[n - 1] - n_log[n]
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            at = i - window + 1
            if excess is not None and excess[i] <= excess[at]:
                continue
            if begin >= 0 and at <= end:
                end = i + 1
            else:
                if begin >= 0:
                    yield begin, end
                begin, end = at, i + 1
    if begin >= 0:
        yield begin, end


def entropy_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """High-entropy windows of candidate strings, outside of ``taken`` and the allow-list.

    A candidate has letters. Where it has few digits it may be an identifier, a path or long words, so there a window
    must also be other than words by its pairs of letters. What ``taken`` covers of a candidate is cut out, and each
    part that is left is searched by itself.
    """
    out, uncovered = [], Uncovered(taken)
    for m in CANDIDATE.finditer(text):
        if not any(map(str.isalpha, m[0])) or ALLOWED.fullmatch(m[0]):
            continue
        for begin, end in uncovered.parts(m.start(), m.end()):
            s = text[begin:end]
            if not any(map(str.isalpha, s)):
                continue
            held = frozenset(s)
            _, _, window, least = next(c for c in CLASSES if held <= c[1])
            few = sum(map(str.isdigit, s)) < FEW_DIGITS
            out += [(begin + a, begin + b, "entropy") for a, b in entropy_windows(s, window, least, few)]
    return out


class Uncovered:
    """The parts of ranges that no span covers; ranges are asked for from left to right, so spans are passed once."""

    def __init__(self, taken: list[tuple[int, int, str]]):
        self.union: list[list[int]] = []
        for a, b, _ in taken:  # in order of start
            if self.union and a <= self.union[-1][1]:
                self.union[-1][1] = max(self.union[-1][1], b)
            else:
                self.union.append([a, b])
        self.at = 0

    def parts(self, begin: int, end: int) -> list[tuple[int, int]]:
        while self.at < len(self.union) and self.union[self.at][1] <= begin:
            self.at += 1
        out, i = [], self.at
        while i < len(self.union) and self.union[i][0] < end:
            if begin < self.union[i][0]:
                out.append((begin, self.union[i][0]))
            begin = max(begin, self.union[i][1])
            i += 1
        return [*out, (begin, end)] if begin < end else out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


RESULT = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")


def _scan(batches):
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            base = base_spans(text)
            more = entropy_spans(text, base)
            every = sorted(base + more, key=lambda s: (s[0], s[1], s[2]))
            n = [sum(s[2] == k for s in base) for k in KINDS]
            rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(more)))
        yield dict(zip(RESULT, zip(*rows), strict=True)) if rows else dict.fromkeys(RESULT, [])


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts by kind, a digest of the fixed forms, and all spans.

    Spans are kind:start:end in code points, end exclusive, by start. Null and empty texts have no spans; rows that
    repeat, or have a null doc_id, are scanned each on its own; an empty table gives an empty result. One pass, no
    shuffle, and memory for one Arrow batch and the longest text.
    """
    return map_batches(texts(docs), _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
