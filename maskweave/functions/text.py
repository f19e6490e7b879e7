"""Text functions of the catalogue, the term files and the results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(c: Column) -> Column:
    """Letters and digits in lower case, every other run one blank, trimmed."""
    return F.trim(F.lower(F.regexp_replace(c, "[^\\p{L}\\p{N}]+", " ")))


def clean_term(c: Column) -> Column:
    """A term without a pair of outer parentheses, then brackets, and without apostrophes; white space is one blank."""
    c = F.trim(c)
    for a, b in ("()", "[]"):
        c = F.when(c.startswith(a) & c.endswith(b) & (F.length(c) >= 2), F.trim(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    return F.trim(F.regexp_replace(F.regexp_replace(c, "['`’]", ""), "\\s+", " "))


def hash_key(c: Column) -> Column:
    """SHA-256 in lower-case hex; null for blank keys."""
    return F.when(F.trim(c) != "", F.sha2(c, 256))


def truncate(c: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def direction(c: Column, least: float = 0.12) -> Column:
    """rtl where more than ``least`` of the characters are Hebrew, else ltr."""
    share = F.regexp_count(c, F.lit("[\\u0590-\\u05FF]")) / F.greatest(F.length(c), F.lit(1))
    return F.when(share > least, "rtl").otherwise("ltr")


def file_size(n: Column) -> Column:
    """A number of bytes for readers: B, KB, MB."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / 1048576))
    )


def size_kb(n: Column) -> Column:
    return F.floor(n / 1024).cast("long")


def stem(path: Column) -> Column:
    """A path's file name without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))
