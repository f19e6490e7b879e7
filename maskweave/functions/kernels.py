"""Match kernels: every match of a regular expression with its place, as an array column.

Offsets are code points from 0. Patterns are Java's; they run in the JVM, where neither Python nor a shuffle is needed.
That engine has no time limit and a stack of its own, so patterns whose search may take more than linear time, or go
deep, run in an Arrow kernel with a time limit instead (see ``syntax``).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .syntax import COMMON

HIT = "struct<start:int,length:int,value:string>"
HITS = f"array<{HIT}>"
BLOCK = 128
#: Seconds that a search of one text may take where the engine can be stopped.
BUDGET = 2.0
#: Put around matches. A noncharacter, which texts do not exchange; one that holds it all the same is searched with OTHER in its place.
MARK, OTHER = "\ufdd0", "\ufdd1"


def no_hits() -> Column:
    return F.array().cast(HITS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(rows: Column, step: Callable[[Column, Column], tuple[Column, Column]], out: str) -> Column:
    """From left to right, step(at, row) gives the next ``at``, an int that begins as 0, and an array of type ``out``; those arrays in a row.

    Blocks of rows are folded one after the other, so that adding to an array stays cheap however many rows there are.
    """

    def one(acc: Column, row: Column) -> Column:
        at, made = step(acc["at"], row)
        return F.struct(at.cast("int").alias("at"), F.concat(acc["out"], made).alias("out"))

    def block(done: Column, some: Column) -> Column:
        at = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0))
        return F.concat(done, F.array(F.aggregate(some, F.struct(at.alias("at"), F.array().cast(out).alias("out")), one)))

    def folded(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(rows), F.lit(BLOCK)), lambda b: F.slice(rows, b + 1, F.lit(BLOCK)))
        done = F.aggregate(blocks, F.array().cast(f"array<struct<at:int,out:{out}>>"), block)
        return F.flatten(F.transform(done, lambda b: b["out"]))

    return let(rows, folded)


def swept(rows: Column, marks: Column, end: Callable[[Column], Column], floor: Callable[[Column], Column], place: Callable[[Column], Column], value: Callable[[Column], Column], above: bool) -> Column:
    """Rows, in their order, of which the greatest ``value`` (0 at least) of a mark whose place is before the row's end is, or is not, ``above`` the row's floor.

    One sort of rows and marks by place, and one pass: the greatest value so far is all that is kept.
    """

    def event(at: Column, is_mark: int, i: Column, low: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), F.lit(is_mark).alias("mark"), i.cast("int").alias("i"), low.cast("int").alias("low"))

    def step(at: Column, e: Column) -> tuple[Column, Column]:
        wanted = (at > e["low"]) if above else (at <= e["low"])
        return F.when(e["mark"] == 1, F.greatest(at, e["low"])).otherwise(at), F.when((e["mark"] == 0) & wanted, F.array(e["i"])).otherwise(F.array().cast("array<int>"))

    def kept(own: Column) -> Column:
        events = F.concat(F.transform(own, lambda r, i: event(end(r), 0, i, floor(r))), F.transform(marks, lambda m: event(place(m), 1, F.lit(0), value(m))))
        taken = F.transform(F.sort_array(scan(F.sort_array(events), step, "array<int>")), lambda i: F.get(own, i))
        return F.when((F.size(own) > 0) & (F.size(marks) > 0), taken).otherwise(F.slice(own, 1, 0) if above else own)

    return let(rows, kept)


def hits(text: Column, pattern: str, part: str = "all", before: int = 0, clear: str | None = None) -> Column:
    """array<struct<start, length, value>> of the non-overlapping matches of a pattern, empty ones, too.

    part: "all" is the whole match; "tail" is group 1 where it ends with the match; "inner" is group 1 where it begins
    ``before`` code points after the match. Empty groups are left out. ``clear`` is a character class: matches beside one
    of its characters are left out. Null text has no matches.

    The text is searched once: matches are put between marks, and what marks part is measured.
    """
    k = 2 if part == "all" else 3
    held = text.contains(MARK)
    marked = F.regexp_replace(F.when(held, F.translate(text, MARK, OTHER)).otherwise(text), F.lit(_whole(pattern)), F.lit(MARK + "$0" + MARK + ("$1" + MARK if k == 3 else "")))

    def rows_of(pieces: Column) -> Column:
        def row(i: Column) -> Column:
            at = i * k
            own = {"gap": F.length(F.get(pieces, at)), "size": F.length(F.get(pieces, at + 1)), "value": F.get(pieces, at + k - 1)}
            if clear:
                left, right = F.concat(F.coalesce(F.get(pieces, at - k + 1), F.lit("")), F.get(pieces, at)), F.concat(F.get(pieces, at + k), F.coalesce(F.get(pieces, at + k + 1), F.lit("")))
                own["clear"] = ~F.concat(F.right(left, F.lit(1)), F.left(right, F.lit(1))).rlike(clear)
            return F.struct(*(c.alias(n) for n, c in own.items()))

        return F.transform(F.sequence(F.lit(0), (F.size(pieces) / k).cast("int") - 1), row)

    def step(at: Column, row: Column) -> tuple[Column, Column]:
        begin = at + row["gap"]
        end = begin + row["size"]
        size = F.length(row["value"])
        start = {"all": begin, "tail": end - size, "inner": begin + before}[part]
        return end, F.array(F.struct(start.alias("start"), size.alias("length"), row["value"].alias("value"), *([row["clear"].alias("clear")] if clear else [])))

    def found(pieces: Column) -> Column:
        kind = HITS if not clear else "array<struct<start:int,length:int,value:string,clear:boolean>>"
        out = scan(rows_of(pieces), step, kind)
        if clear:
            out = F.transform(F.filter(out, lambda h: h["clear"]), lambda h: h.dropFields("clear"))
        if part != "all":
            out = F.filter(out, lambda h: h["length"] > 0)
        return F.when(F.size(pieces) > 1, out).otherwise(no_hits())

    def itself(every: Column) -> Column:
        return F.when(held, F.transform(every, lambda h: F.struct(h["start"], h["length"], F.substring(text, h["start"] + 1, h["length"]).alias("value")))).otherwise(every)

    return F.coalesce(let(let(F.split(marked, MARK, -1), found), itself), no_hits())


def _whole(pattern: str) -> str:
    """The pattern; one that might match the empty string keeps out of the middle of a surrogate pair."""
    flags, body = re.match(r"((?:\(\?[a-zA-Z]+\))?)(.*)", pattern, re.S).groups()
    return rf"{flags}(?![\uDC00-\uDFFF])(?:{body})" if can_be_empty(body) else pattern


def can_be_empty(pattern: str) -> bool:
    """Whether a pattern, its look-around aside, matches the empty string; true also of one that cannot be told."""
    parts, depth, skip = [], 0, 0
    for token in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]])*\]|\(\?<?[=!]|.", pattern, re.S):
        depth += token[0] == "("
        if not skip and re.fullmatch(r"\(\?<?[=!]", token):
            skip = depth
        if not skip:
            parts.append(token)
        if token == ")":
            skip = 0 if skip == depth else skip
            depth -= 1
    try:
        compiled = regex.compile("".join(parts), regex.IGNORECASE | regex.MULTILINE)
    except regex.error:
        return True
    return any(m.end() == m.start() for probe in ("", "a", " ", "a b", "1\n-", "Zz9 \n.,:;x") for m in compiled.finditer(probe))


def sketch(text: Column) -> Column:
    """What a text has besides Latin letters, white space and common signs, a blank for each run of these; see syntax.image."""
    return F.regexp_replace(text, f"[{COMMON}]+", " ")


@lru_cache(maxsize=1_000)
def python_regex(pattern: str, multiline: bool = False) -> regex.Pattern:
    """A pattern of Java's for the ``regex`` module, which can be stopped and goes no deeper than it has memory for."""
    nested = "&&" in pattern or re.search(r"\[[^\]]*(?<!\\)\[", pattern) is not None
    flags = regex.IGNORECASE | (regex.MULTILINE if multiline else 0) | (regex.V1 if nested else regex.V0)
    return regex.compile(re.sub(r"\\[zZ]", lambda m: {r"\z": r"\Z", r"\Z": r"(?=\n?\Z)"}[m[0]], pattern), flags)


def arrow_hits(text: Column, pattern: str, multiline: bool = False, timeout: float = BUDGET) -> Column:
    """As hits, by the ``regex`` module over Arrow batches; a text that takes over ``timeout`` seconds fails the task."""

    @F.pandas_udf(HITS)
    def find(texts: pd.Series) -> pd.Series:
        compiled = python_regex(pattern, multiline)

        def of(text: str | None) -> list[dict]:
            try:
                return [] if text is None else [{"start": m.start(), "length": m.end() - m.start(), "value": m[0]} for m in compiled.finditer(text, timeout=timeout)]
            except TimeoutError as e:
                raise TimeoutError(f"a search for {pattern!r} took over {timeout} s in a text of {len(text)} characters") from e

        return texts.map(of)

    return find(text)


def literal(text: str) -> str:
    """A Java pattern that matches just this text."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def any_of(words: list[str]) -> str:
    """A Java pattern that matches each of some words, as a tree of their letters: a place is tried once a letter, however many words there are."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    # The empty rest goes last, so that the longest word is tried first.
    parts = [literal(h) + (any_of(rest) if rest != [""] else "") for h, rest in heads.items() if h] + ([""] if "" in heads else [])
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
