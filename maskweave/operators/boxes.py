"""Boxes around recognised words: offsets, unions, masks and clamping. Pixels are left to a painter of one's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pixels that a mask reaches beyond its word.
PAD = 5


def word_offsets(words: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("line", "word")) -> DataFrame:
    """words(key, *order, text) with char_start and char_end in the text made of them with a separator after each."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return words.withColumn("char_start", start.cast("int")).withColumn("char_end", (start + F.length("text")).cast("int"))


def page_text(words: DataFrame, key: str = "doc_id", order: tuple[str, ...] = ("line", "word")) -> DataFrame:
    """(key, text): words by blanks, lines by \\n, in order."""
    line, word = order
    lines = words.groupBy(key, line).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(word, "text"))), lambda w: w["text"]), " ").alias("text"))
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(line, "text"))), lambda x: x["text"]), "\n").alias("text"))


def masks(words: DataFrame, pad: float = PAD) -> DataFrame:
    """All words' boxes, ``pad`` wider on each side: left, top, right, bottom."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    return words.withColumns({"left": x - pad, "top": y - pad, "right": x + w + pad, "bottom": y + h + pad})


def match_boxes(spans: DataFrame, words: DataFrame, key: str = "doc_id", pad: float = PAD) -> DataFrame:
    """(key, start, length, left, top, right, bottom): the union of the boxes of the words that each span overlaps."""
    m, w = spans.alias("m"), words.alias("w")
    meets = (F.col("w.char_start") < F.col("m.start") + F.col("m.length")) & (F.col("w.char_end") > F.col("m.start"))
    rows = m.join(w, (F.col(f"m.{key}") == F.col(f"w.{key}")) & meets)
    return rows.groupBy(f"m.{key}", "m.start", "m.length").agg(
        (F.min("w.x") - pad).alias("left"), (F.min("w.y") - pad).alias("top"), (F.max(F.col("w.x") + F.col("w.width")) + pad).alias("right"), (F.max(F.col("w.y") + F.col("w.height")) + pad).alias("bottom")
    )


def clamped(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes cut to an image; those outside of it go."""
    inside = boxes.withColumns({
        "left": F.greatest("left", F.lit(0)), "top": F.greatest("top", F.lit(0)),
        "right": F.least("right", F.lit(width)), "bottom": F.least("bottom", F.lit(height)),
    })
    return inside.filter("right > left and bottom > top")


def all_passes(passes: DataFrame) -> DataFrame:
    """One row per word of passes(doc_id, scale, words array<struct>), rescaled to the image's own size."""
    rows = passes.select("doc_id", "scale", F.inline("words"))
    return rows.select("doc_id", "text", *((F.col(c) / F.col("scale")).alias(c) for c in ("x", "y", "width", "height")))


def best_pass(passes: DataFrame, enough: int = 20) -> DataFrame:
    """(doc_id, text) of passes(doc_id, pass, text): the first with over ``enough`` characters, else the longest, else the first."""
    size = F.length(F.trim("text"))
    rank = F.struct((size > enough).alias("a"), F.when(size > enough, -F.col("pass")).otherwise(size).alias("b"), (-F.col("pass")).alias("c"))
    return passes.groupBy("doc_id").agg(F.trim(F.max_by("text", rank)).alias("text"))


def is_dark(pixels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, dark) of pixels(key, r, g, b): whether more than 55 % of them have a luminance below 128."""
    luminance = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    return pixels.groupBy(key).agg((F.avg(F.when(luminance < 128, 1.0).otherwise(0.0)) > 0.55).alias("dark"))


def inverted(pixels: DataFrame) -> DataFrame:
    return pixels.withColumns({c: 255 - F.col(c) for c in ("r", "g", "b")})
