"""Span algebra: protected zones, order, overlaps, splicing, summaries; on arrays within a row, without a shuffle.

A candidate is struct<start, length, field_name, replacement, matched_text, ord>; ord is its place in the catalogue's
order and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import BLOCK, let, scan, swept

#: Places of a text that one task sweeps in candidates_outside(), at most.
BLOCK_CHARS = 65_536
CANDIDATES = "array<struct<start:int,length:int,field_name:string,replacement:string,matched_text:string,ord:int>>"


def no_candidates() -> Column:
    return F.array().cast(CANDIDATES)


def stamped(hits: Column, field_name: str, replacement: str, ord_: int) -> Column:
    """Hits as candidates of a field."""
    return F.transform(
        hits,
        lambda h: F.struct(h["start"], h["length"], F.lit(field_name).alias("field_name"), F.lit(replacement).alias("replacement"), h["value"].alias("matched_text"), F.lit(ord_).alias("ord")),
    )


def outside(candidates: Column, zones: Column) -> Column:
    """Candidates that no zone overlaps; spans that only touch do not overlap.

    A zone overlaps a span if it begins before the span's end and ends behind its start: of the zones that begin before
    the span's end only the farthest end matters, so spans and zones are swept once.
    """
    return let(zones, lambda found: swept(candidates, found, _end, lambda m: m["start"], lambda z: z["start"], _end, above=False))


def _end(span: Column) -> Column:
    return span["start"] + span["length"]


def ordered(candidates: Column) -> Column:
    """By start, the longest first, then by catalogue order and place among a pattern's hits."""
    keyed = F.transform(candidates, lambda m, i: F.struct(m["start"].alias("a"), (-m["length"]).alias("b"), m["ord"].alias("c"), i.alias("d"), m.alias("m")))
    return F.transform(F.sort_array(keyed), lambda k: k["m"])


def without_overlaps(candidates: Column) -> Column:
    """From left to right, each candidate that begins at or after the end of the last one taken; input as by ordered()."""

    def step(end: Column, m: Column) -> tuple[Column, Column]:
        free = m["start"] >= end
        return F.when(free, _end(m)).otherwise(end), F.when(free, F.array(m)).otherwise(no_candidates())

    return scan(candidates, step, CANDIDATES)


def splice(text: Column, spans: Column, render=lambda m: m["replacement"], gap=lambda g: g) -> Column:
    """text with each of its disjoint spans rendered; text between them goes through ``gap``.

    Spans are taken in blocks, each with its stretch of the text, so that no gap is counted out from the text's beginning.
    """

    return let(spans, lambda own: _spliced(text, own, render, gap))


def _spliced(text: Column, spans: Column, render, gap) -> Column:
    def block(b: Column) -> Column:
        begin = F.coalesce(_end(F.get(spans, b - 1)), F.lit(0))
        stretch = F.substring(text, begin + 1, _end(F.get(spans, F.least(b + BLOCK, F.size(spans)) - 1)) - begin)

        def pieces(own: Column) -> Column:
            def piece(m: Column, i: Column) -> Column:
                last = F.coalesce(_end(F.get(spans, b + i - 1)), F.lit(0))
                return F.concat(gap(F.substring(own["text"], last - own["begin"] + 1, m["start"] - last)), render(m))

            return F.array_join(F.transform(F.slice(spans, b + 1, F.lit(BLOCK)), piece), "")

        return let(F.struct(stretch.alias("text"), begin.alias("begin")), pieces)

    tail = gap(F.substring(text, _end(F.get(spans, F.size(spans) - 1)) + 1, F.length(text)))
    whole = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(BLOCK)), block), ""), tail)
    return F.when(F.size(spans) > 0, whole).otherwise(gap(text))


def fields_hit(spans: Column) -> Column:
    """Distinct field names, by first appearance."""
    return F.array_distinct(F.transform(spans, lambda m: m["field_name"]))


def candidates_outside(candidates: DataFrame, zones: DataFrame, key: str = "doc_id", block: int = BLOCK_CHARS) -> DataFrame:
    """The relational form of outside(), for candidate and zone tables (key, start, length).

    Zones carry their farthest end forward, first within blocks of a text's places and then from block to block, so a
    text of n candidates and zones costs n log n steps, and one of many blocks is dealt over as many tasks. Candidates
    with a null key have no zones.
    """
    end = F.col("start") + F.col("length")
    marks = zones.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col("start").cast("long").alias("_at"), end.cast("long").alias("_far"))
    marks = marks.withColumn("_block", F.floor(F.col("_at") / block)).groupBy("_key", "_block", "_at").agg(F.max("_far").alias("_far"))
    # A row stands at the last place where a zone that is before its end may begin.
    rows = candidates.select(F.struct(*candidates.columns).alias("_row"), F.col(key).alias("_key"), (end - 1).cast("long").alias("_at"), F.col("start").cast("long").alias("_start"))
    rows = rows.withColumn("_block", F.floor(F.col("_at") / block))

    blocks = marks.groupBy("_key", "_block").agg(F.max("_far").alias("_far")).select("_key", "_block", "_far", F.lit(0).alias("_asked"))
    asked = rows.filter("_key IS NOT NULL").select("_key", "_block", F.lit(None).cast("long").alias("_far"), F.lit(1).alias("_asked")).distinct()
    before = Window.partitionBy("_key").orderBy("_block", F.col("_asked").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.unionByName(asked).withColumn("_carried", F.max("_far").over(before)).filter("_asked = 1").select("_key", "_block", "_carried")

    none = F.lit(None).cast(rows.schema["_row"].dataType)
    both = rows.withColumns({"_far": F.lit(None).cast("long"), "_mark": F.lit(1)}).unionByName(marks.withColumns({"_row": none, "_start": F.lit(None).cast("long"), "_mark": F.lit(0)}))
    within = Window.partitionBy("_key", "_block").orderBy("_at", "_mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.filter("_key IS NOT NULL").withColumn("_nearest", F.max("_far").over(within)).filter("_mark = 1")
    clear = known.join(carried, ["_key", "_block"], "left").filter("coalesce(greatest(_nearest, _carried), _start) <= _start")
    return clear.select("_row.*").unionByName(candidates.filter(F.col(key).isNull()))
