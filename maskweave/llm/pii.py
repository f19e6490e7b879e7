"""Personal data: fixed forms, and identifiers that contexts learnt from them reveal; by DataFrame functions only.

The fixed forms are seeds. The two words before a seed are a lexical pattern for its kind; a pattern also holds other
strings of about the kind's shape. Patterns and instances form a graph whose scores are iterated: a pattern is as good
as its instances, of which seeds of another kind count against it, and an instance that is no seed as good as the good
patterns, other than the one in question, that hold it. Instances of good patterns are reported as well, and the contexts
in which they occur elsewhere are patterns of the next turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import hits, let, scan, swept
from ..operators.spans import splice
from .common import discard, staged, texts, whole_row

KINDS = ("email", "ip", "card", "phone")
# The forms, with the starts a search can skip told by what stands before.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What may be an identifier that no form describes, with the least and most digits by kind.
LIKE = r"(?<![\p{L}\p{N}.+-])\(?[0-9][0-9()\x20./:-]{5,24}[0-9](?![\p{L}\p{N}])"
LIKE_DIGITS = {"card": (13, 19), "phone": (8, 15), "ip": (4, 12)}
# Addresses that are written out.
AT, DOT = r"(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|@)", r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)"
LIKE_EMAIL = rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"

#: Characters before a span in which its two words are looked for; longer words are no context. Texts are cut into
#: chunks of so many for that, so that no span is counted out from its text's beginning.
REACH, CHUNK = 256, 4096
#: Turns in which instances give new patterns, and rounds in which the scores of a turn are computed.
TURNS, ROUNDS = 2, 3
#: A pattern needs so many different seeds, and that score, for its instances to be reported.
SEEDS, GOOD = 3, 0.8

NAMED = "array<struct<kind:string,start:int,end:int>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>>: all matches of a pattern that is never empty, in code points."""
    return F.transform(hits(text, pattern), lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["length"]).alias("end"), m["value"].alias("value")))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def address(value: Column) -> Column:
    """A written-out address as an address."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), AT, "@"), DOT, ".")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass Luhn's check."""
    own = F.reverse(digits(value))
    each = F.transform(F.sequence(F.lit(1), F.length(own)), lambda i: F.substring(own, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def with_base(df: DataFrame) -> DataFrame:
    """df(text) with a column for each of KINDS: its matches that pass their check, as array<struct<start, end, value>>."""
    text = F.col("text")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    has_digit = text.rlike("[0-9]")
    found = {
        "email": F.when(text.contains("@"), matches(text, EMAIL)),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, IP), lambda m: m["value"].rlike(IP_PARTS))),
        "card": F.when(has_digit, F.filter(matches(text, CARD), lambda m: luhn(m["value"]))),
        "phone": F.when(text.contains("+"), F.filter(matches(text, PHONE), lambda m: F.length(digits(m["value"])).between(8, 15))),
    }
    return df.withColumns({k: F.coalesce(v, none) for k, v in found.items()})


def _chunks(text: Column) -> Column:
    """The text in chunks of CHUNK characters, each with the REACH + 1 before it."""
    return F.transform(F.sequence(F.lit(0), F.length(text), F.lit(CHUNK)), lambda at: F.substring(text, F.greatest(at - REACH - 1, F.lit(0)) + 1, CHUNK + F.least(at, F.lit(REACH + 1))))


def _context(chunks: Column, start: Column) -> Column:
    """The two words before a place, in lower case, digits as 0; null where there are fewer than two in REACH characters."""
    chunk = F.floor(start / CHUNK).cast("int")
    left = F.substring(F.get(chunks, chunk), 1, start - F.greatest(chunk * CHUNK - REACH - 1, F.lit(0)))
    # One character more than REACH: a word that begins there, and not at the text's beginning, may have begun before.
    near = F.when(start > REACH, F.right(left, F.lit(REACH + 1))).otherwise(F.concat(F.lit(" "), left))
    words = F.regexp_replace(F.lower(F.regexp_extract(near, r"\s(\S+\s+\S+)\s*$", 1)), "[0-9]", "0")
    return F.when(words != "", F.regexp_replace(words, r"\s+", " "))


def _scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: base spans by kind, and seeds and look-alikes with their contexts."""
    df = with_base(texts(docs).withColumn("row_id", F.monotonically_increasing_id()))
    text, chunks = F.col("text"), F.col("chunks")
    df = df.withColumn("chunks", _chunks(text))

    def seeds_of(kind: str) -> Column:
        value = F.lower if kind == "email" else digits
        return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"], m["end"], value(m["value"]).alias("value"), _context(chunks, m["start"]).alias("context")))

    def alike_of(found: Column, value) -> Column:
        return F.transform(found, lambda m: F.struct(m["start"], m["end"], value(m["value"]).alias("value"), _context(chunks, m["start"]).alias("context")))

    seeds = F.concat(*map(seeds_of, KINDS))
    numbers = F.when(text.rlike("[0-9]{2}"), alike_of(matches(text, LIKE), digits))
    addresses = F.when(text.rlike(r"(?i)[\[({\x20]at[\])}\x20]"), alike_of(matches(text, LIKE_EMAIL), address))
    none = F.array().cast("array<struct<start:int,end:int,value:string,context:string>>")
    alike = F.concat(F.coalesce(numbers, none), F.coalesce(addresses, none))
    spans = {k: F.transform(k, lambda m: F.struct(m["start"], m["end"])).alias(k) for k in KINDS}
    return df.select("row_id", "doc_id", F.xxhash64("text").alias("text_hash"), *spans.values(), seeds.alias("seeds"), alike.alias("alike"))


def _suits(kind: Column, value: Column) -> Column:
    """Whether a look-alike's value suits the kind: an address, or so many digits."""
    out = value.contains("@")
    for k, (least, most) in LIKE_DIGITS.items():
        out = F.when(kind == k, ~value.contains("@") & F.length(value).between(least, most)).otherwise(out)
    return out


def discovered(scanned: DataFrame) -> DataFrame:
    """(row_id, kind, start, end, score): look-alikes, clear of all base spans, that good patterns hold.

    The graph's edges are distinct (kind, context, value) triples, so a context or value that a third of all rows share
    is one row a task before anything shuffles. A look-alike with several kinds keeps the best. A pattern has SEEDS
    known values at least, seeds or instances of good patterns.
    """
    known = F.filter("alike", lambda m: m["context"].isNotNull())
    clear = let(F.flatten(F.array(*KINDS)), lambda base: swept(known, base, lambda m: m["end"], lambda m: m["start"], lambda b: b["start"], lambda b: b["end"], above=False))
    alike = staged(scanned.select("row_id", F.inline(clear)), "look-alikes")
    places = staged(alike.select("context", "value").distinct(), "places")
    seeds = staged(scanned.select(F.inline("seeds")).filter("context is not null").select("kind", "context", "value").distinct(), "seeds")
    every = seeds.groupBy("context").agg(F.count("*").alias("every"))
    others = staged(seeds.groupBy("kind", "context").agg(F.count("*").alias("own")).join(every, "context").select("kind", "context", (F.col("every") - F.col("own")).alias("others")), "others")
    known, scored = seeds.withColumn("seed", F.lit(1.0)), None
    for _ in range(TURNS):
        evidence = known if scored is None else known.unionByName(places.join(_good(scored).select("kind", "value").distinct(), "value").select("kind", "context", "value", F.lit(0.0).alias("seed")))
        patterns = evidence.groupBy("kind", "context").agg(F.countDistinct("value").alias("n")).filter(F.col("n") >= SEEDS).select("kind", "context")
        patterns = staged(patterns, "patterns")
        held = places.join(patterns, "context").filter(_suits(F.col("kind"), F.col("value"))).withColumn("seed", F.lit(0.0))
        edges = held.select("kind", "context", "value", "seed").unionByName(known.join(patterns, ["kind", "context"], "left_semi"))
        edges = edges.groupBy("kind", "context", "value").agg(F.max("seed").alias("seed")).join(others, ["kind", "context"], "left").withColumn("others", F.coalesce("others", F.lit(0)))
        edges = staged(edges, "edges")
        last, scored = scored, _scored(edges)
        discard(last, patterns, edges)
    best = alike.join(_good(scored), ["context", "value"]).groupBy("row_id", "start", "end").agg(F.max(F.struct("pattern", "kind")).alias("b"))
    best = staged(best.select("row_id", F.col("b.kind").alias("kind"), "start", "end", F.col("b.pattern").alias("score")), "discovered")
    discard(alike, places, seeds, others, scored)
    return best


def _good(scored: DataFrame) -> DataFrame:
    """The instances of good patterns that are no seeds there."""
    return scored.filter((F.col("seed") == 0) & (F.col("pattern") >= GOOD)).select("kind", "context", "value", "pattern")


def _scored(edges: DataFrame) -> DataFrame:
    """edges(kind, context, value, seed, others) with the pattern's score.

    A pattern's score is the mean of its values' support, seeds of other kinds counted as values without any. A seed's
    support is 1, another value's that of good patterns beside this one: none vouches for itself.
    """
    scored = None
    for _ in range(ROUNDS):
        now = edges.withColumn("support", F.col("seed")) if scored is None else scored
        by_pattern = now.groupBy("kind", "context").agg((F.sum("support") / (F.count("*") + F.first("others"))).alias("pattern"))
        own = F.when(F.col("pattern") >= GOOD, F.log(F.greatest(1 - F.col("pattern"), F.lit(1e-9)))).otherwise(0.0)
        joined = edges.join(by_pattern, ["kind", "context"]).withColumn("own", own)
        by_value = joined.groupBy("kind", "value").agg(F.sum("own").alias("total"))
        support = F.greatest("seed", 1 - F.exp(F.col("total") - F.col("own")))
        new = joined.join(by_value, ["kind", "value"]).select("kind", "context", "value", "seed", "others", "pattern", support.alias("support"))
        new = staged(new, "scores")
        discard(scored)
        scored = new
    return scored


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _kind(kind: str) -> Column:
    """The base spans of a kind, with its name."""
    return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _more(kind: str) -> Column:
    return F.filter(F.coalesce("more", F.array().cast(NAMED)), lambda m: m["kind"] == kind)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): counts by kind, a digest of the fixed forms, and all spans.

    Spans are kind:start:end in code points, end exclusive, by kind as listed, then start; those that patterns revealed
    count among spans only. Null counts as the empty text; repeated rows, and rows with a null doc_id, are searched each
    on its own; an empty table gives an empty result. The texts are read once and never shuffled.
    """
    scanned = staged(_scan(docs), "pii-scan")
    more = discovered(scanned).groupBy("row_id").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    out = scanned.select("row_id", "doc_id", "text_hash", *KINDS).join(more, "row_id", "left")
    every = F.concat(*(F.sort_array(F.concat(_kind(k), _more(k))) for k in KINDS))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.concat(*map(_kind, KINDS))), 256).alias("base_sha256"),
        joined(every).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_discovered"),
        "text_hash",
        F.coalesce("more", F.array().cast(NAMED)).alias("more"),
    )


#: Rows with revealed spans up to here are broadcast to the texts; beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data in ``text`` replaced by its kind in brackets, as in [EMAIL]; a null stays.

    Spans that overlap are replaced as one, by the kind of the leftmost (the longest of these), so that nothing which
    any of them covers stays. Fixed forms are found where the text lies; only rows with revealed spans come from
    elsewhere, by doc_id and a hash of the text.
    """
    more = staged(find_pii(docs).filter("n_discovered > 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("more").alias("_more")), "revealed")
    more = more.dropDuplicates(["_id", "_hash"])
    if more.count() <= BROADCAST_ROWS:
        more = F.broadcast(more)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_hash"))
    held = docs.select(whole_row(), "doc_id", "text").join(more, same, "left")
    spans = F.concat(*map(_kind, KINDS), F.coalesce("_more", F.array().cast(NAMED)))
    by_place = F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"]))
    cover = "array<struct<start:int,length:int,replacement:string>>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        """A span that begins within another and reaches further covers the rest without a name of its own."""
        end, inside = -s["back"], s["start"] < at
        start = F.greatest(s["start"], at)
        own = F.struct(start.alias("start"), (end - start).alias("length"), F.when(inside, "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("replacement"))
        return F.greatest(at, end), F.when(end > at, F.array(own)).otherwise(F.array().cast(cover))

    done = with_base(held).withColumn("_spans", F.sort_array(by_place)).withColumn("_cover", scan(F.col("_spans"), step, cover))
    clean = F.when(F.size("_spans") > 0, splice(F.col("text"), F.col("_cover"))).otherwise(F.col("text"))
    return done.withColumn("_clean", clean).select(*(F.col("_clean").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns))
