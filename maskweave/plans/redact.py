"""redact(): documents and a catalogue to redacted texts, as one projection that Spark plans like any other.

The catalogue is unrolled into the plan, a match kernel for each pattern, and most kernels look only at texts whose
sketch shows that they may match. Texts stay in their rows, and term lists of any size are looked up row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import no_hits, sketch
from ..functions.text import clean_term, escape_html
from ..operators.patterns import COMPILERS, FLAGS, nothing
from ..operators.spans import fields_hit, no_candidates, ordered, outside, splice, stamped, without_overlaps
from ..operators.term_list import dictionary, finder
from .catalog import Field, ordered_patterns


def _terms(df: DataFrame, pattern: str) -> DataFrame:
    rows = df.sparkSession.createDataFrame([(t,) for t in pattern.split("\n") if t.strip()], "term string")
    return dictionary(rows.select(clean_term(F.col("term")).alias("term")))


def _unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def with_matches(df: DataFrame, catalogue: list[Field], text: str = "text", dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """df with ``matches``: the spans that are redacted, disjoint and in order.

    dictionaries: by field name, term tables (see term_list.dictionary) for FileList patterns too large for a
    catalogue. Rows need no key: each is looked at by itself. Null texts have no matches.
    """
    source, named_hits = F.col(text), {}
    drawn, found_in, zones_in = (_unused(df, name) for name in ("_sketch", "_found", "_zones"))
    for n, field in enumerate(catalogue):
        for p in field.patterns if field.is_active else ():
            if p.pattern_type == "FileList":
                terms = (dictionaries or {}).get(field.name)
                terms = _terms(df, p.pattern) if terms is None else terms
                named_hits[n, p] = finder(terms)(source)

    def hits(n: int, p) -> Column:
        if (n, p) in named_hits:
            return named_hits[n, p]
        # A type that nothing is registered for finds nothing; the rest of the catalogue stays in force.
        compiled = COMPILERS.get(p.pattern_type, nothing)(p.pattern)
        if (needs := getattr(compiled, "needs", None)) is None:
            return compiled(source)
        return F.when(F.col(drawn).rlike(FLAGS + needs), compiled(source)).otherwise(no_hits())

    active = [(n, f) for n, f in enumerate(catalogue) if f.is_active]
    df = df.withColumn(drawn, sketch(source))  # the optimiser drops it where no pattern asks for it
    zones = [hits(n, p) for n, f in active if f.is_preserve for p in f.patterns]
    found, place = [], 0
    for n, f in active:
        for p in () if f.is_preserve else ordered_patterns(f.patterns):
            found.append(stamped(hits(n, p), f.name, f.replace_with, place))
            place += 1
    df = df.withColumn(found_in, F.concat(*found) if found else no_candidates())
    if zones:
        df = df.withColumn(zones_in, reduce(lambda a, b: F.concat(a, b), zones))
        df = df.withColumn(found_in, outside(F.col(found_in), F.col(zones_in))).drop(zones_in)
    few = F.when(F.size(found_in) > 1, without_overlaps(ordered(F.col(found_in)))).otherwise(F.col(found_in))
    return df.withColumn("matches", few).drop(found_in, drawn)


def redact(df: DataFrame, catalogue: list[Field], text: str = "text", dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """df with redacted_text, match_count, fields_hit and matches; a null text stays null."""
    out = with_matches(df, catalogue, text, dictionaries)
    out = out.withColumn("redacted_text", splice(F.col(text), F.col("matches"))).withColumn("match_count", F.size("matches")).withColumn("fields_hit", fields_hit(F.col("matches")))
    public = F.transform("matches", lambda m: m.dropFields("ord"))
    return out.withColumn("matches", public)


def highlighted(text: Column, matches: Column) -> Column:
    """text as HTML with its matches marked."""
    return splice(text, matches, lambda m: F.concat(F.lit("<mark>"), escape_html(m["matched_text"]), F.lit("</mark>")), escape_html)


def as_json(results: DataFrame) -> DataFrame:
    """One JSON string per redaction result."""
    spans = F.transform("matches", lambda m: F.struct(m["start"].alias("startIndex"), m["length"].alias("length"), m["field_name"].alias("fieldName"), m["replacement"].alias("replacement")))
    body = F.struct(F.col("redacted_text").alias("redactedText"), F.col("match_count").alias("matchCount"), F.col("fields_hit").alias("fieldsHit"), spans.alias("matches"))
    return results.select("doc_id", F.to_json(body).alias("json"))
