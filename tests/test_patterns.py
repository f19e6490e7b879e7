import random

import pytest
import regex
from pyspark.sql import functions as F

from maskweave.functions.table_functions import register as register_functions
from maskweave.operators.patterns import PatternError, find, type_name
from maskweave.plans.catalog import Field, Pattern
from maskweave.plans.redact import redact

CASES = [
    ("Like", "*@gmail.com", "see x@gmail.com now", [(0, 15)]),
    ("Like", "Dr.?", "Dr.AB Dr.A", [(0, 4), (6, 4)]),
    ("Like", "*b", "ab ab\nxb c", [(0, 5), (6, 2)]),
    ("BeginsWith", "wh", "What (who) awh", [(0, 4), (6, 4)]),
    ("EndsWith", ".il", "site.il/path", [(0, 7)]),
    ("EndsWith", "tion", "nation nations a-tion,", [(0, 6), (15, 6)]),
    ("WholeWord", "Dr.", "Dr. Cohen Dr.Cohen", [(10, 3)]),
    ("BetweenMarkers", "ID: | DOB", "ID: 123456789 DOB: 1990", [(3, 11)]),
    ("BetweenMarkers", "ID:|DOB", "ID: 1 DOB", []),
    ("AfterLabel", "Name:", "Name:   ", [(7, 1)]),
    ("AfterLabel", "Name:", "name: A B\nname: C", [(6, 3), (16, 1)]),
    ("AfterLabel", "Name:|2", "Name: A B C", [(6, 3)]),
    ("ConstList", "a a", "xa a a", []),
    ("ConstList", "the| |of", "The_of oft of", [(0, 3), (4, 2), (11, 2)]),
    ("NumberSequence", "9", "1234567890 123456789", [(11, 9)]),
    ("NumberSequence", "2,3", "1 12 123 1234 ٣٤", [(2, 2), (5, 3), (14, 2)]),
    ("NumberSequence", "0", "1", []),
    ("WholeLine", "Patient:", "a\r\nPatient: x\r\nb", [(3, 12)]),
    ("WholeLine", "x", "x x\ny\nx", [(0, 4), (6, 1)]),
    ("WholeLine", "(", "(", []),
    ("Like", "", "a", []),
    ("LlmPrompt", "names", "Dana", []),
    ("Regex", r"a.b", "a\rb a\nb", [(0, 3)]),
    ("Regex", r"\b", "ab", [(0, 0), (2, 0)]),
    ("Regex", r"x*", "ax", [(0, 0), (1, 1), (2, 0)]),
    ("Regex", r"\d{2}", "😀12 ١٢", [(1, 2), (4, 2)]),
    ("Regex", r"b.n", "בן ban BÉN", [(3, 3), (7, 3)]),
]


@pytest.mark.parametrize("kind,pattern,text,want", CASES)
def test_hits(spark, kind, pattern, text, want):
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string").select("text", find("text", kind, pattern).alias("h"))
    rows = {r.text: r.h for r in df.collect()}
    assert [(h.start, h.length) for h in rows[text]] == want
    assert rows[None] == []
    for h in rows[text]:
        assert h.value == text[h.start : h.start + h.length]


def test_table_function_gives_the_same(spark):
    """find_spans in SQL, for every type and every text of the cases above."""
    register_functions(spark)
    texts = spark.createDataFrame([(i, t) for i, (_, _, t, _) in enumerate(CASES)] + [(-1, None), (-2, "")], "i int, t string")
    texts.createOrReplaceTempView("texts_of_cases")
    for kind, pattern in {(k, p) for k, p, _, _ in CASES}:
        got = spark.sql("SELECT i, s.* FROM texts_of_cases, LATERAL find_spans(t, :kind, :pattern) s", args={"kind": kind, "pattern": pattern}).collect()
        want = texts.select("i", F.inline(find("t", kind, pattern))).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)), (kind, pattern)


def test_table_function_checks_what_it_is_given(spark):
    register_functions(spark)
    for call in ("find_spans('x', 'Telepathy', 'x')", "find_spans(1, 'Regex', 'x')", "find_spans('x', 'Regex', '(')", "find_spans('x', 'Regex', NULL)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {call}").collect()
    with pytest.raises(Exception):
        spark.sql("SELECT s.* FROM VALUES ('a', 'b') AS v(t, p), LATERAL find_spans(t, 'Regex', p) s").collect()


def test_bad_raw_pattern_is_refused(spark):
    with pytest.raises(PatternError):
        find("text", "Regex", "(")


def test_type_names():
    assert type_name("file_list") == type_name("FILELIST") == "FileList"
    with pytest.raises(ValueError):
        type_name("nope")


def test_many_hits_in_one_text(spark):
    text = "ab " * 5000
    row = spark.createDataFrame([(text,)], "text string").select(find("text", "WholeWord", "ab").alias("h")).first()
    assert [h.start for h in row.h] == list(range(0, 15000, 3))


def test_native_and_arrow_kernels_agree(spark, sf_dir):
    from maskweave.functions.kernels import arrow_hits, hits

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for pattern in (r"[0-9a-f]{3,}", r"\b[A-Z]{6,8}\b", r"th\w+"):
        both = docs.select(hits(F.col("text"), "(?iUd)" + pattern).alias("a"), arrow_hits(F.col("text"), pattern).alias("b"))
        assert both.filter("a != b").isEmpty()


@pytest.mark.parametrize("pattern", [r"(?=q)", r"(?<=@)", r"\b(?=\d{4})", r"\d*", r"q?", r"(?<!\d)\d{2}(?!\d)", r"^|$", r"[a@]+"])
def test_places_equal_another_engine(spark, pattern):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aq@1 2345\n.é😀Z") for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", find("t", "Regex", pattern).alias("h"))
    got = {r.i: [(h.start, h.length, h.value) for h in r.h] for r in df.collect()}
    assert got == {i: [(m.start(), m.end() - m.start(), m[0]) for m in regex.finditer(pattern, t, regex.IGNORECASE)] for i, t in enumerate(texts)}


def test_a_text_may_hold_the_mark(spark):
    text = "a\ufdd0 b\ufdd0\ufdd0ab"
    row = spark.createDataFrame([(text,)], "t string").select(find("t", "Regex", "b.|a").alias("h")).first()
    assert [(h.start, h.length, h.value) for h in row.h] == [(0, 1, "a"), (3, 2, "b\ufdd0"), (6, 1, "a")]


def test_const_list_equals_brute_force(spark):
    terms = ["ab", "a", "b a", "a b", "a a", "Ab", "b", "é", "b-", "-b", "abba"]
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB é-") for _ in range(rng.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", find("t", "ConstList", "|".join(terms)).alias("h"))
    got = {r.i: sorted((h.start, h.length) for h in r.h) for r in df.collect()}

    def want(text):
        out = []
        for term in terms:
            at = text.lower().find(term.lower())
            while at >= 0:
                if not any(c.isalnum() for c in text[max(at - 1, 0) : at] + text[at + len(term) : at + len(term) + 1]):
                    out.append((at, len(term)))
                at = text.lower().find(term.lower(), at + len(term))
        return sorted(out)

    assert got == {i: want(t) for i, t in enumerate(texts)}


def test_unknown_types_are_skipped(spark):
    fields = [Field("n", (Pattern("Telepathy", "x"), Pattern("WholeWord", "bob")), "[N]")]
    docs = spark.createDataFrame([(1, "bob x")], "doc_id long, text string")
    assert redact(docs, fields).first().redacted_text == "[N] x"


def test_terms_are_searched_once_in_bounded_runs(spark, monkeypatch):
    """The search stands once in the plan, not again in the filter on its hits; a batch is taken a few texts at a time, with the same hits."""
    import pyarrow as pa

    from maskweave.operators import term_list

    terms = term_list.dictionary(spark.createDataFrame([("red fox",), ("owl",)], "term string"))
    docs = spark.createDataFrame([(1, "a Red-fox, an owl"), (2, None), (3, "none"), (4, "")], "doc_id long, text string")
    found = term_list.term_hits(docs, terms).selectExpr("doc_id", "size(hits) AS n", "hits[0].value AS v", "transform(hits, h -> h.start) AS starts")
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 2, "red fox", [2, 14])]
    monkeypatch.setattr(term_list, "ROWS", 2)
    monkeypatch.setattr(term_list, "BYTES", 8)
    for texts in ([], [None], ["x" * 20, "a", None, "bb", "", "c" * 9, "d"]):
        parts = list(term_list._parts(pa.array(texts, pa.string())))
        assert [t for p in parts for t in p.to_pylist()] == texts and all(len(p) <= 2 for p in parts) and len(parts) >= 1
