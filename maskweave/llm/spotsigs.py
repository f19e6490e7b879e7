"""SpotSigs document fingerprints, by DataFrame functions only.

A spot is a common word (the anchor) with the chain of the next content words; a text's fingerprint is its multiset
of spots. They are compared by Jaccard likeness, and only where their lengths allow the likeness that is asked for.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, texts

# Common words that spots start from, by language.
ANCHORS = (
    "the of and to in a is that it was for on with as by at from be this are or an",
    "le la les de des du et un une en que qui est dans pour sur avec par au ce",
    "der die das und in zu den von mit ist im für ein eine auf dem nicht als auch",
    "el los las y del se por con una su para lo al es como más pero o",
)
#: Anchors that may stand between the two content words of a chain; the second is missing where more do.
PASSED = 4
#: Rows of a range of doc_ids, and the most ranges, whose bounds are in the plan. Beyond, ranges hold more rows; they are sorted with spilling.
ROWS_PER_RANGE = 1_000
MAX_RANGES = 100_000


def _is_anchor(word: Column) -> Column:
    return word.isin(sorted({w for line in ANCHORS for w in line.split()}))


def with_spots(df: DataFrame, text: str, spots: str) -> DataFrame:
    """df with the column ``spots``: 32-bit hashes of the spots of ``text``, the second, third, ... of a spot as one of
    their own, so that comparing sets compares multisets.

    A spot is an anchor, the content word that follows it, and the next content word; anchors between them are passed
    over. Where words have no anchor among them, each three content words in a row are a spot as well, and where they
    have nothing else, each PASSED + 1 anchors in a row. All depend on a few words alone and not on the rest of the
    text, so an edit changes only the spots that it touches. A text too short for any (six words at most) is
    its threes of words, or one spot; a text without a word has none.
    """
    # Words are hashed once: anchors to even numbers, content words to odd ones.
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    df = df.withColumn("_codes", F.transform(words, lambda w: F.when(_is_anchor(w), F.xxhash64(w).bitwiseAND(-2)).otherwise(F.xxhash64(w).bitwiseOR(1))))

    def code(i: Column) -> Column:
        return F.get("_codes", i)

    def content(i: Column) -> Column:
        return F.when(code(i).bitwiseAND(1) == 1, code(i))

    def places(of: str, less: int = 0) -> Column:
        n = F.size(of) - less
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def spot(i: Column) -> Column:
        return F.xxhash64(code(i), code(i + 1), F.coalesce(*(content(i + k) for k in range(2, PASSED + 3)), F.lit(0)))

    def is_content(i: Column) -> Column:
        return code(i).bitwiseAND(1) == 1

    def own(i: Column) -> Column:
        """The hash of the spot that begins at word i, null where none does."""
        three = F.when(is_content(i + 1) & is_content(i + 2), F.xxhash64(code(i), code(i + 1), code(i + 2)))
        others = reduce(and_, (~is_content(i + k) for k in range(2, PASSED + 1)))
        anchors = F.when(others, F.xxhash64(*(code(i + k) for k in range(PASSED + 1))))
        return F.when(is_content(i), three).otherwise(F.when(is_content(i + 1), spot(i)).otherwise(anchors))

    df = df.withColumn("_hashes", F.filter(F.transform(places("_codes", 1), own), lambda h: h.isNotNull()))
    every = F.when(F.size("_codes") < 3, F.transform(F.slice("_codes", 1, 1), lambda c: F.xxhash64(c, code(F.lit(1)), F.lit(0)))).otherwise(
        F.transform(places("_codes", 2), lambda i: F.xxhash64(code(i), code(i + 1), code(i + 2)))
    )
    hashes = F.when(F.size("_hashes") > 0, F.col("_hashes")).otherwise(every)
    df = df.withColumn("_hashes", F.sort_array(F.transform(hashes, lambda h: F.shiftrightunsigned(h, 32))))
    # Equal hashes stand together: where runs begin, and then the members of each run, numbered from 0.
    changes = F.filter(places("_hashes"), lambda i: (i == 0) | (F.get("_hashes", i) != F.get("_hashes", i - 1)))
    df = df.withColumn("_runs", changes)

    def members(begin: Column, run: Column) -> Column:
        n = F.coalesce(F.get("_runs", run + 1), F.size("_hashes")) - begin
        first = F.get("_hashes", begin)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.when(k == 0, first).otherwise(F.shiftrightunsigned(F.xxhash64(first, k), 32)))

    single = F.size("_runs") == F.size("_hashes")
    counted = F.array_distinct(F.flatten(F.transform("_runs", members)))
    return df.withColumn(spots, F.when(single, F.col("_hashes")).otherwise(counted)).drop("_codes", "_hashes", "_runs")


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 1 for two empty ones. Sets whose lengths keep it below ``least`` are not compared and given 0."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(large == 0, F.lit(1.0)).when(small < large * F.lit(least), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def as_string(spots: str) -> Column:
    return F.array_join(F.transform(spots, lambda s: F.lower(F.hex(s))), " ")


def with_next(docs: DataFrame, then) -> DataFrame:
    """(doc_id, text, next_*): each row with its follower by doc_id, the last with the first; nulls come first.

    doc_id is cut into ranges of about equal numbers of rows, so that no task holds them all. A range's first row is also
    sent to the range before. ``then`` adds columns to rows once they are in their range; those are given as next_*, too.
    Rows that repeat a doc_id follow each other by text; those of a doc_id (or of none) that fills several ranges follow
    each other in the order of a hash, by which they are spread over these. An empty table gives an empty result.
    """
    keyed = texts(docs).withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    rows = keyed.count()
    n = min(MAX_RANGES, max(1, math.ceil(rows / ROWS_PER_RANGE)))
    cuts = keyed.agg(F.min("_key").alias("first"), F.percentile_approx("_key", [(i + 1) / (n + 1) for i in range(n)], max(10_000, 10 * n)).alias("cuts")).first()
    # A doc_id that is several cuts has as many ranges.
    widths = Counter(cuts["cuts"] or ()) | Counter([cuts["first"] or 0])
    bounds = sorted(widths)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.lit([g[0] for g in groups])
    inner = F.array(*(F.lit(g) for g in groups))

    keyed = keyed.withColumn("_head", F.size(F.filter(heads, lambda h: h <= F.col("_key"))))
    keyed = keyed.withColumn("_group", F.element_at(inner, F.col("_head")))
    keyed = keyed.withColumn("_range", (F.col("_head") - 1) * step + F.size(F.filter("_group", lambda h: h <= F.col("_key"))) - 1)
    keyed = keyed.withColumn("_sub", F.lit(0).cast("long")).withColumn("_first", F.array_contains("_group", F.col("_key")))
    keyed = keyed.withColumn("_before", F.pmod(F.col("_range") - 1, F.lit(len(bounds))))
    if max(widths.values()) > 1:
        keyed = _split(keyed, [widths[b] for b in bounds])
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    sent = F.when(F.col("_first"), F.array(own, F.struct(F.col("_before").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(own))
    placed = keyed.select("doc_id", "text", "_key", "_sub", F.inline(sent)).repartition("range")

    placed = then(placed)
    more = [c for c in placed.columns if c not in ("doc_id", "_key", "_sub", "range", "guest")]
    order = Window.partitionBy("range").orderBy("guest", "_key", "_sub", "text")
    follower = F.lead(F.struct(*more)).over(order)
    return placed.withColumn("_next", follower).filter("not guest").select("doc_id", *more, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in more))


def _split(keyed: DataFrame, widths: list[int]) -> DataFrame:
    """keyed with ranges numbered anew: the rows of the doc_id that range i begins with are spread over ``widths[i]`` ranges.

    The last of these also has the other doc_ids of range i. Rows are written with their hash before it is used, so that
    it is the same in each job. Which row comes first in each range (three numbers a range) is brought to the driver.
    """
    width = F.element_at(F.lit(widths), F.col("_range") + 1)
    spread = F.when(F.col("_first") & (width > 1), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.col("_sub"))
    keyed = staged(keyed.select("doc_id", "text", "_key", "_range", "_first", spread.alias("_sub")), "split-ranges")
    offsets = F.lit([0, *accumulate(widths)])
    place = F.when(F.col("_first"), F.shiftright((F.shiftright("_sub", 32) + (1 << 31)) * width, 32)).otherwise(width - 1)
    place = F.when(width > 1, place).otherwise(0)
    keyed = keyed.withColumn("_range", (F.element_at(offsets, F.col("_range") + 1) + place).cast("int")).drop("_first")
    firsts = keyed.groupBy("_range").agg(F.min(F.struct("_key", "_sub")).alias("f")).orderBy("_range").collect()
    at = {r["_range"]: (r["f"]["_key"], r["f"]["_sub"], before["_range"]) for before, r in zip([firsts[-1], *firsts], firsts, strict=False)}
    key, sub, before = (F.lit([at.get(i, (0, 0, 0))[k] for i in range(sum(widths))]) for k in range(3))
    own = F.col("_range") + 1
    first = (F.col("_key") == F.element_at(key, own)) & (F.col("_sub") == F.element_at(sub, own))
    return keyed.withColumn("_first", first).withColumn("_before", F.element_at(before, own))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): its fingerprint and that of its edited text, and likenesses.

    The edited text has its last quarter (by code points, rounded down) replaced by as many from the beginning of the
    next document, or all of that. Null counts as the empty text. An empty table gives an empty result.
    """
    both = with_next(docs, lambda df: with_spots(df, "text", "spots"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter)))
    both = with_spots(both, "edited", "edited_spots")
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string("spots").alias("fingerprint"),
        as_string("edited_spots").alias("edited_fingerprint"),
        likeness("spots", "edited_spots").alias("near_edited"),
        likeness("spots", "next_spots").alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(spots_a, spots_b, likeness): digests of all pairs of different fingerprints of at least ``threshold``; exact.

    Sets meet by rare spots: of two sets that are so alike, the rarest |s| - ceil(t·|s|) + 1 spots of each share one.
    Lengths are cut into ranges by powers of 1/t; a set looks for partners in its own range and the next. Equal sets
    are one row here, so a group of copies costs no pairs; fingerprint_of() has each document's digest. Null and empty
    texts, and such without a word, have no spots and no pairs; an empty table gives an empty result.
    """
    # Written before it is filtered: a filter would pull the making of spots into itself, once for each use.
    sets = staged(fingerprint_of(docs).select("digest", "spots").dropDuplicates(["digest"]), "spot-sets")
    sets = sets.withColumn("n", F.size("spots")).filter("n > 0")
    frequency = sets.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("df"))
    ranked = sets.select("digest", "n", F.explode("spots").alias("spot")).join(frequency, "spot")
    place = F.row_number().over(Window.partitionBy("digest").orderBy("df", "spot"))
    prefix = ranked.withColumn("_place", place).filter(F.col("_place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    band = F.floor(F.log(F.col("n")) / -math.log(threshold))
    a = prefix.select("spot", band.alias("band"), F.col("digest").alias("a"), F.col("n").alias("na"))
    b = prefix.select("spot", F.explode(F.array(band, band - 1)).alias("band"), F.col("digest").alias("b"), F.col("n").alias("nb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = a.join(b, ["spot", "band"]).filter(smaller & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select("a", "b").distinct()
    left, right = (sets.select(F.col("digest").alias(x), F.col("spots").alias(f"spots_{x}")) for x in "ab")
    full = pairs.join(left, "a").join(right, "b").withColumn("likeness", likeness("spots_a", "spots_b", threshold - 1e-9))
    return full.filter(F.col("likeness") >= threshold).select("a", "b", "likeness")


def fingerprint_of(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, spots): each row's set of spots and a digest of it."""
    return with_spots(texts(docs), "text", "spots").select("doc_id", F.sha2(as_string("spots"), 256).alias("digest"), "spots")
