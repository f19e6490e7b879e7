"""The pattern types: each compiles its own little language to a column of hits.

A compiled pattern is a function from a text column to array<struct<start, length, value>>, hits from left to right. It
may know what a text's sketch must match for it to find anything, so that other texts are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import BUDGET, any_of, arrow_hits, hits, let, literal, no_hits, python_regex, swept
from ..functions.syntax import image, linear


#: (start, length) of the hits in one text, for functions of SQL; see functions.table_functions.
Search = Callable[[str], Iterable[tuple[int, int]]]


@dataclass(frozen=True)
class Compiled:
    find: Callable[[Column], Column]
    #: A pattern that the sketch of every text matches in which something is found; None if any sketch may be.
    needs: str | None = None
    search: Search | None = None

    def __call__(self, text: Column) -> Column:
        return self.find(text)


# The names of the types.
TYPES = ("Regex", "ConstList", "LlmPrompt", "Like", "BeginsWith", "EndsWith", "WholeWord", "AfterLabel", "BetweenMarkers", "NumberSequence", "WholeLine", "FileList")

#: Ignore case, Unicode classes, and only \n ends a line for the dot; with "m", ^ and $ hold at lines.
FLAGS, LINE_FLAGS = "(?iUd)", "(?iUdm)"


class PatternError(ValueError):
    """A raw regular expression that cannot be compiled: the whole catalogue is refused."""


def type_name(name: str) -> str:
    """The type that a name stands for, whatever its case and underscores."""
    if name in COMPILERS:
        return name
    wanted = name.replace("_", "").lower()
    for known in TYPES:
        if known.lower() == wanted:
            return known
    raise ValueError(f"unknown pattern type {name!r}")


def known(name: str) -> bool:
    """Whether name stands for a type, built in or registered."""
    return name in COMPILERS or name.replace("_", "").lower() in {t.lower() for t in TYPES}


def valid(pattern: str) -> bool:
    """Whether the JVM compiles the pattern; in a worker, which has none, whether the other engine does."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            python_regex(re.sub(r"^\(\?[iUdm]+\)", "", pattern))
        else:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


NOTHING = Compiled(lambda text: no_hits(), search=lambda text: ())


def _searched(body: str, multiline: bool, part: str = "all", before: int = 0) -> Search:
    """As hits() finds, text by text."""

    def search(text: str) -> Iterator[tuple[int, int]]:
        for m in python_regex(body, multiline).finditer(text, timeout=BUDGET):
            value = m[0 if part == "all" else 1] or ""
            start = {"all": m.start(), "tail": m.end() - len(value), "inner": m.start() + before}[part]
            if value or part == "all":
                yield start, len(value)

    return search


def _found(body: str, flags: str, part: str = "all", before: int = 0, strict: bool = False) -> Compiled:
    """Hits of a body under flags; a body that Java refuses has none, or raises if ``strict``.

    Bodies whose part is a group are this module's own and linear; others are asked, and run in the JVM only if they are.
    """
    if not valid(flags + body):
        if strict:
            raise PatternError(body)
        return NOTHING
    safe = linear(body, "m" in flags) if part == "all" else body
    try:
        python_regex(body, "m" in flags)
        search = _searched(body, "m" in flags, part, before)
    except regex.error as e:
        if safe is None:
            raise PatternError(f"{body}: not linear, and of a form that only the JVM's engine knows, which has no time limit") from e
        search = None
    if safe is None:
        return Compiled(lambda text: arrow_hits(text, body, "m" in flags), search=search)
    return Compiled(lambda text: hits(text, flags + safe, part, before), image(body), search)


def raw(pattern: str) -> Compiled:
    return _found(pattern, FLAGS, strict=True)


def _overlap(a: str, b: str) -> bool:
    """Whether occurrences of two terms can overlap."""
    return a in b or b in a or any(a.endswith(b[:i]) or b.endswith(a[:i]) for i in range(1, min(len(a), len(b))))


def const_list(pattern: str) -> Compiled:
    """Terms between bars; a term counts where neither neighbour is a letter or digit, and once for each time it is listed.

    A term of letters and digits only is then a whole run of them, so all such terms make one kernel. Others are
    searched for in groups of terms that cannot overlap, from the left and each behind its last occurrence.
    """
    terms = [t for t in map(str.strip, pattern.split("|")) if t]
    edge = r"[\p{L}\p{Nd}]"
    listed: list[dict[str, str]] = []  # n-th: terms that are listed n times or more
    groups: list[list[str]] = []
    for term in terms:
        key = term.lower()
        if re.fullmatch(r"[^\W_]+", key):
            words = next((w for w in listed if key not in w), None)
            if words is None:
                listed.append(words := {})
            words[key] = term
        else:
            group = next((g for g in groups if not any(_overlap(key, t.lower()) for t in g)), None)
            if group is None:
                groups.append(group := [])
            group.append(term)

    bodies = [f"(?<!{edge}){any_of(list(words))}(?!{edge})" for words in listed] + ["(?:" + "|".join(map(literal, g)) + ")" for g in groups]
    if not bodies:
        return NOTHING

    def find(text: Column) -> Column:
        return F.concat(*(hits(text, "(?iU)" + b, clear=None if i < len(listed) else edge) for i, b in enumerate(bodies)))

    def search(text: str) -> Iterator[tuple[int, int]]:
        beside = python_regex(edge)
        for i, body in enumerate(bodies):
            for start, length in _searched(body, False)(text):
                if i < len(listed) or not beside.search(text[max(start - 1, 0) : start] + text[start + length : start + length + 1]):
                    yield start, length

    needs = [image(b) for b in bodies]
    return Compiled(find, None if None in needs else "|".join(needs), search)


def like(pattern: str) -> Compiled:
    """* is any run and ? any character, within a line; a side without a wildcard ends at a word boundary."""
    if not pattern:
        return NOTHING
    body = "".join({"*": ".*", "?": "."}.get(c) or literal(c) for c in pattern)
    # A leading run begins where its line does, or where the last match ended: no other start can match if these don't.
    left = {"*": r"(?:\G|^)", "?": ""}.get(pattern[0], r"\b")
    right = "" if pattern[-1] in "*?" else r"\b"
    return _found(left + body + right, LINE_FLAGS)


def begins_with(pattern: str) -> Compiled:
    return _found(rf"\b{literal(pattern.strip())}\S*", LINE_FLAGS)


def ends_with(pattern: str) -> Compiled:
    return _found(rf"(?:\G|(?<!\S))\S*{literal(pattern.strip())}\b", LINE_FLAGS)


def whole_word(pattern: str) -> Compiled:
    return _found(rf"\b{literal(pattern.strip())}\b", LINE_FLAGS)


def after_label(pattern: str) -> Compiled:
    """label or label|N: what follows the label on its line, or its next N words; the label stays."""
    label, _, count = pattern.partition("|")
    label, n = label.strip(), int(count) if re.fullmatch(r"\s*[+-]?[0-9]+\s*", count) else 0
    value = r"([^\r\n]+)" if n <= 0 else r"(\S++(?:[ \t]++\S++){0,%d}+)" % (n - 1)
    return _found(rf"{literal(label)}[ \t]*{value}", LINE_FLAGS, "tail")


def between_markers(pattern: str) -> Compiled:
    """left | right: the least text between both on a line; the markers stay.

    Where no right marker follows a left one, none follows any later one of the line: the rest of it is passed over.
    """
    left, bar, right = pattern.partition(" | ")
    left, right = left.strip(), right.strip()
    if not bar or not left or not right:
        return NOTHING
    return _found(rf"{literal(left)}(?:(.+?){literal(right)}|.*+)", FLAGS, "inner", len(left))


def number_sequence(pattern: str) -> Compiled:
    """n or least,most: runs of so many digits, no more beside them."""
    m = re.fullmatch(r"\s*([0-9]+)\s*(?:,\s*([0-9]+)\s*)?", pattern)
    least, most = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
    if least < 1 or most < least:
        return NOTHING
    return _found(r"(?<!\d)\d{%d,%d}(?!\d)" % (least, most), "(?U)")


LINE = r"[^\r\n]*+(?:\r\n|\r|\n)|[^\r\n]++"


def whole_line(pattern: str) -> Compiled:
    """The lines, with their ends, in which a match begins; each once."""
    if not valid(FLAGS + pattern):
        return NOTHING
    places, safe = raw(pattern), linear(pattern)

    def find(text: Column) -> Column:
        lines = hits(text, LINE)
        if safe is not None and not re.search(r"\\[nrsSDWv]|\[\^|\n|\(\?s", pattern):
            # No match can cross a line's end, so each line is looked at by itself.
            return F.filter(lines, lambda line: F.regexp_like(line["value"], F.lit(FLAGS + pattern)))

        def held(found: Column) -> Column:
            # The last match that begins before a line's end must begin in the line.
            return swept(lines, found, lambda x: x["start"] + x["length"], lambda x: x["start"], lambda h: h["start"], lambda h: h["start"] + 1, above=True)

        return let(places(text), held)

    def search(text: str) -> Iterator[tuple[int, int]]:
        begins, i = [start for start, _ in places.search(text)], 0
        for m in re.finditer(LINE, text):
            while i < len(begins) and begins[i] < m.start():
                i += 1
            if i < len(begins) and begins[i] < m.end():
                yield m.start(), m.end() - m.start()

    own = search if places.search else None
    if safe is None:
        return Compiled(find, search=own)
    return Compiled(lambda text: F.when(text.rlike(FLAGS + safe), find(text)).otherwise(no_hits()), places.needs, own)


def nothing(pattern: str) -> Compiled:
    """A type that is kept in catalogues and finds nothing yet."""
    return NOTHING


#: FileList is looked up in a dictionary; see term_list.
COMPILERS: dict[str, Callable[[str], Compiled]] = {
    "Regex": raw,
    "ConstList": const_list,
    "LlmPrompt": nothing,
    "Like": like,
    "BeginsWith": begins_with,
    "EndsWith": ends_with,
    "WholeWord": whole_word,
    "AfterLabel": after_label,
    "BetweenMarkers": between_markers,
    "NumberSequence": number_sequence,
    "WholeLine": whole_line,
}


def register(name: str, compiler: Callable[[str], Compiled]) -> None:
    """Add a pattern type of one's own."""
    COMPILERS[name] = compiler


def occurrences(text: Column, term: str) -> Column:
    """The places of a text that is searched for: all that do not overlap, whatever their case; a blank one has none."""
    return hits(text, f"(?iU){literal(term)}") if term.strip() else no_hits()


def find(text: Column | str, pattern_type: str, pattern: str) -> Column:
    """The hits of one pattern in a text column."""
    return COMPILERS[type_name(pattern_type)](pattern)(F.col(text) if isinstance(text, str) else text)
