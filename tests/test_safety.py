"""Patterns that may take long or go deep, prefilters, dictionaries in files, interval sweeps."""

import random
import re
import time

import pytest
import regex
from pyspark.sql import functions as F

from maskweave.functions.kernels import arrow_hits, hits, sketch
from maskweave.functions.syntax import COMMON, image, linear, trouble
from maskweave.operators import term_file
from maskweave.operators.patterns import COMPILERS, FLAGS, PatternError, find
from maskweave.operators.spans import candidates_outside, outside
from maskweave.operators.term_list import MOST_WORDS, dictionary, term_hits
from maskweave.plans.builtin import builtin
from maskweave.plans.catalog import Field, Pattern
from maskweave.plans.redact import redact
from maskweave.streaming.redact import read_folder, redact_stream

LONG = 1_000_000


@pytest.mark.parametrize(
    "pattern,why",
    [
        (r"(a|aa)+b", "deep"), (r"(\w|\d)+$", "deep"), (r"(?:a|b)+", "deep"), (r"(a+)+b", "deep"), (r"(?:\.[a-z]+)+x", "deep"), (r"(?:ab?){0,900}", "deep"),
        (r"(?:a|a)*+b", "restarts"), (r"(?:(?:a|b|ab){1,9}){1,40}c", "exponential"), (r"(?:a{1,30}){1,30}b", "exponential"),
        (r".*.*.*x", "polynomial"), (r"\d+\d+x", "polynomial"), (r"\ba+[ab]*ac", "polynomial"),
        (r"[a-z]+@", "restarts"), (r"a.*b", "restarts"), (r"\b[a-z.]+@", "restarts"), (r"\s+$", "restarts"),
        (r"(a)\1", "unreadable: (a)\\1"),
        (r"\b[a-z]+@", None), (r"foo\S*", None), (r'"[^"]*"', None), (r"a{1,30}b", None), (r"(?:[a-z]++,)*+", None), (r"(?<![a-z])[a-z]+@", None), (r"\d{9}", None), (r".*", None), (r"(?m)^.*x", None),
    ],
)
def test_trouble(pattern, why):
    assert trouble(pattern) == why or why == "exponential" and trouble(pattern) in ("exponential", "deep")


def test_built_in_patterns_stay_in_the_jvm():
    for f in builtin():
        for p in f.patterns:
            if p.pattern_type == "Regex":
                assert linear(p.pattern) is not None


@pytest.mark.parametrize("pattern", [r"[a-z]+@", r"[a-z0-9.]{2,}@b", r"\d+-\d", r"[ab]+(?:c|@)", r"\w+\W"])
def test_anchored_runs_are_equal(spark, pattern):
    assert trouble(pattern) == "restarts" and linear(pattern) not in (None, pattern)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc@@.-1 \nÉ") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", find("t", "Regex", pattern).alias("h"))
    got = {r.i: [(h.start, h.value) for h in r.h] for r in df.collect()}
    assert got == {i: [(m.start(), m[0]) for m in regex.finditer(pattern, t, regex.IGNORECASE)] for i, t in enumerate(texts)}


@pytest.mark.parametrize(
    "kind,pattern,text",
    [
        ("Regex", r"(?:a|b)+", "ab" * (LONG // 2)), ("Regex", r"[a-z]+@", "a" * LONG), ("Regex", r"(?:x|y)*z", "xy" * 3000 + "z"), ("WholeLine", r"(?:a|b)+c", "ab" * 3000 + "c\nq"),
        ("AfterLabel", "x|5000", "x " + "w " * 6000), ("BetweenMarkers", "<< | >>", "<< a " * 100_000), ("Like", "*tion", "a" * LONG), ("BeginsWith", "a", "a" * LONG),
        ("EndsWith", "b", "a" * LONG), ("ConstList", "a|b c", "a b " * 50_000), ("NumberSequence", "9", "1" * LONG),
    ],
)
def test_long_texts_end_in_time(spark, kind, pattern, text):
    df = spark.createDataFrame([(text,)], "t string").select(F.size(find("t", kind, pattern)).alias("n"))
    df.limit(0).collect()
    begin = time.time()
    assert df.first().n >= 0
    assert time.time() - begin < 20


@pytest.mark.parametrize("pattern", [r"(a|aa)+b", r"(\w|\d)+$", r".*.*.*x"])
def test_what_takes_too_long_fails_the_task(spark, pattern):
    text = "a" * LONG + "!"
    df = spark.createDataFrame([(text,)], "t string").select(F.size(find("t", "Regex", pattern)).alias("n"))
    begin = time.time()
    try:
        df.collect()
    except Exception as e:
        assert "TimeoutError" in str(e)
    assert time.time() - begin < 30
    assert spark.range(3).count() == 3


def test_a_form_of_one_engine_that_is_not_linear_is_refused(spark):
    with pytest.raises(PatternError):
        find("t", "Regex", r"(?:a|\p{javaLowerCase})+b")


def test_differing_classes_between_engines(spark):
    texts = ["a-b_c é ß 1٣ \x1c\x85  ", "AbC[x]&&", "line\nnext\r\nlast\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in (r"[a-z&&[^b]]", r"[[a-c][x]]", r"\p{L}", r"e$", r"t\Z", r"^l"):
        both = df.select(hits(F.col("t"), FLAGS + pattern).alias("a"), arrow_hits(F.col("t"), pattern).alias("b"))
        assert both.filter("a != b").isEmpty(), pattern


# ---- prefilters


def sketched(text):
    return re.sub(f"[{COMMON}]+", " ", text)


PATTERNS = [p for f in builtin() for p in f.patterns]


def test_images_hold_of_every_text_that_matches(spark):
    """A text in which a built-in pattern finds something has a sketch that the pattern's image matches."""
    rng = random.Random(4)
    words = ["050-1234567", "0521234567", "+972-50-1234567", "4111 1111 1111 1111", "6011-1111-1111-1111", "01/02/1990", "1990-02-01", "12345678", "AB1234567", "10.0.0.1", "12-345678", "Mr John Smith",
             "IL620108000000099999999", "DEUTDEFF", "ח.פ.: 512345678", "עוסק מורשה 512345678", "12-345-67", "כהן", "בן דוד", "a.b@c-d.org", "x@y.il", "K9", "ſ", "é", ",", ".", "-", "/", " ", "\n", "12", "٣٤٥"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", "\t", "; ", "x"]) for _ in range(rng.randint(1, 8))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("s", sketch(F.col("t")))
    assert [r.s for r in df.orderBy("i").collect()] == list(map(sketched, texts))
    guarded = 0
    for p in PATTERNS:
        compiled = COMPILERS[p.pattern_type](p.pattern)
        if compiled.needs:
            guarded += 1
            assert df.filter((F.size(compiled(F.col("t"))) > 0) & ~F.col("s").rlike(FLAGS + compiled.needs)).isEmpty(), p.pattern
    assert guarded >= 20


@pytest.mark.parametrize("pattern", [r"9k9", r"[^a]7", r"\d.\d", r"(?:ab|1)2", r"x{2}-{2}", r"a*5b*", r"(?s)1.2", r"\W\d", r"3(?=k)", r"[\d-k]{2}", r"#[a-z ]{1,3}#", r"1\s+2", r"(?:1a){2}"])
def test_images_of_odd_patterns(pattern):
    rng = random.Random(pattern)
    needs = image(pattern)
    compiled = regex.compile(pattern, regex.IGNORECASE)
    for _ in range(3000):
        text = "".join(rng.choice("aAbkKK9 157  \n-x#23,é²") for _ in range(rng.randint(0, 12)))
        if compiled.search(text):
            assert needs is None or regex.search(needs, sketched(text), regex.IGNORECASE | regex.V1), (text, needs)


def test_a_catalogue_is_still_one_projection(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = redact(docs, builtin())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    assert plan.count("regexp_replace(text") < 80


# ---- dictionaries

WORDS = [("Cohen",), ("Cohen Levi",), ("Tel Aviv",), ("a b c d e f g",), ("b c d",), ("one two three four five six",), ("é",)]
ROWS = [(1, "Tel, Aviv Cohen - Cohen Levi"), (None, "cohen-levi -cohen- x"), (5, ""), (5, None), (5, "a b c d e f g"), (None, "- - tel aviv"), (7, "one two-three four, five six"), (None, None), (5, "É!")]


def brute(text, terms):
    tokens = [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{Nd}-]+", text)]
    norm = lambda s: regex.sub(r"[^\p{L}\p{N}]+", " ", s).strip().lower()
    known, out, i = {norm(t): t for t in terms if len(norm(t).split()) <= 6}, [], 0
    most = max((len(n.split()) for n in known), default=1)
    while i < len(tokens):
        for width in range(min(most, len(tokens) - i), 0, -1):
            a, b = tokens[i][0], tokens[i + width - 1][1]
            if norm(text[a:b]) in known:
                out.append((a, b - a, known[norm(text[a:b])]))
                i += width - 1
                break
        i += 1
    return out


@pytest.mark.parametrize("sizes", [None, (0, 1 << 20), (0, 30)])
def test_dictionaries_equal_brute_force(spark, sizes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    terms = dictionary(spark.createDataFrame(WORDS, "term string"))
    ready = term_file.build(terms, MOST_WORDS, *sizes) if sizes else term_file.build(terms, MOST_WORDS)
    assert bool(ready.names) == bool(sizes)
    got = sorted((str(r.doc_id), [tuple(h) for h in r.hits]) for r in term_hits(docs, ready).collect())
    want = [(str(d), brute(t, [w for w, in WORDS])) for d, t in ROWS if t]
    assert got == sorted(w for w in want if w[1])


def test_random_texts_and_terms(spark):
    rng = random.Random(6)
    terms = [" ".join(rng.choice("ab cd e f -".split()) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choice(["ab", "cd", "e", "f", "-", "ab-cd", "e,", "x"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    table = dictionary(spark.createDataFrame([(t,) for t in terms], "term string"))
    spelled = [r.raw for r in table.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(h) for h in r.hits] for r in term_hits(docs, term_file.build(table, MOST_WORDS, 0, 200)).collect()}
    assert got == {i: b for i, t in enumerate(texts) if (b := brute(t, spelled))}


def test_a_large_dictionary_leaks_nothing_and_serves_streams(spark, tmp_path, monkeypatch):
    """Null and repeated keys with a dictionary in files, in a batch and in a stream."""
    monkeypatch.setattr(term_file, "BROADCAST_BYTES", 0)
    rows = [(None, "hello ann"), (5, "see bob"), (5, "no name here at all")]
    catalogue = [Field("who", (Pattern("FileList", "ann\nbob"),), "[N]")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.redacted_text for r in redact(docs, catalogue).collect()] == ["hello [N]", "see [N]", "no name here at all"]
    docs.write.parquet(str(tmp_path / "in"))
    names = dictionary(spark.createDataFrame([("Ann",), ("Bob",)], "term string"))
    stream = redact_stream(read_folder(spark, str(tmp_path / "in"), "doc_id long, text string"), [Field("who", (Pattern("FileList", ""),), "[N]")], dictionaries={"who": names})
    q = stream.writeStream.format("memory").queryName("large_terms").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.redacted_text for r in spark.table("large_terms").collect()) == ["hello [N]", "no name here at all", "see [N]"]


def test_a_million_terms(spark):
    terms = spark.range(1_000_000).select(F.concat(F.lit("name"), F.col("id"), F.when(F.col("id") % 3 == 0, " of many").otherwise("")).alias("term"))
    ready = term_file.build(dictionary(terms), MOST_WORDS)
    assert len([n for n in ready.names if n]) > 1
    docs = spark.createDataFrame([(i % 2 or None, f"x name{i} of many name{i * 7} y name{10**7 + i}") for i in range(300)], "doc_id long, text string")
    found = term_hits(docs, ready)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == 300
    assert sum(h.value.endswith(" of many") for r in rows for h in r.hits) == sum(i % 3 == 0 for i in range(300)) and all(len(r.hits) >= 1 for r in rows)


# ---- intervals


def spans(rng, n, width=30):
    return [(a := rng.randint(0, width), rng.randint(0, 6)) for _ in range(n)]


def clear(m, zones):
    return not any(m[0] < z[0] + z[1] and m[0] + m[1] > z[0] for z in zones)


def test_sweeps_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, spans(rng, rng.randint(0, 12)), spans(rng, rng.randint(0, 6))) for i in range(400)]
    kind = "array<struct<start:int,length:int>>"
    df = spark.createDataFrame(rows, f"i long, m {kind}, z {kind}")
    want = {i: [m for m in ms if clear(m, zs)] for i, ms, zs in rows}
    assert {r.i: [tuple(m) for m in r.k] for r in df.select("i", outside(F.col("m"), F.col("z")).alias("k")).collect()} == want
    key = F.when(F.col("i") % 7 > 0, F.col("i"))  # null for a seventh
    candidates = df.select(key.alias("doc_id"), "i", F.inline("m"))
    zones = df.select(key.alias("doc_id"), F.inline("z"))
    for block in (3, 10, 1000):
        got = sorted((r.i, r.start, r.length) for r in candidates_outside(candidates, zones, block=block).collect())
        assert got == sorted((i, *m) for i, ms, _ in rows for m in (ms if i % 7 == 0 else want[i]))


def test_many_spans_and_zones_of_one_text(spark):
    n = 20_000
    at = F.sequence(F.lit(0), F.lit(n - 1))
    span = lambda step, size: F.transform(at, lambda i: F.struct((i * step).alias("start"), F.lit(size).alias("length")))
    row = spark.range(1).select(outside(span(10, 4), span(20, 3)).alias("k"))
    begin = time.time()
    assert row.select(F.size("k")).first()[0] == n // 2
    assert time.time() - begin < 20
    one = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 10).alias("start"), F.lit(4).alias("length"))
    two = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 20).alias("start"), F.lit(3).alias("length"))
    assert candidates_outside(one, two).count() == n // 2
