import pytest
from pyspark.sql import functions as F

from maskweave.operators.spans import ordered, outside, stamped, without_overlaps
from maskweave.plans.builtin import builtin
from maskweave.plans.catalog import Field, Pattern
from maskweave.plans.redact import as_json, redact, with_matches

GOLDEN = [
    ("Please contact a.user@example.com for help.", "Please contact [email] for help."),
    ("id: 123456782 end", "id: [ID] end"),
    ("Call 050-0000000 or 052-1111111.", "Call [PHONE] or [PHONE]."),
    ("dob 01/02/1990, age 30", "dob [DOB], age 30"),
    ("Card: 4111 1111 1111 1111 exp 12/26", "Card: [CARD] exp 12/26"),
    ("No PII in this text.", "No PII in this text."),
    ("The hospital is located in Jerusalem, second floor.", "The [IBAN] is located in Jerusalem, second floor."),
    ("co 512345678 x", "co [ID] x"),
    ("ח.פ.: 512345678", "[ח.פ.]"),
    ("+972-50-1234567", "+972-[BANK]"),
    ("doc 12345678", "doc [PASSPORT]"),
    ("plate 12-345-67", "plate [PLATE]"),
    ("pin 1234567", "pin [PLATE]"),
    ("ip 10.0.0.1 ok", "ip [IP] ok"),
    ("Dr. Dana Levi called", "[NAME]"),
    ("Mr john smith went home", "[NAME] home"),
    ("IL620108000000099999999", "[IBAN]"),
    ("שרה כהן", "[שם] [משפחה]"),
    ("דוד אמיר טל", "[שם] [שם] [שם]"),
    ("Patient: כהן  ID: 123456782  DOB: 01/02/1990  Phone: 050-0000000  Email: a.user@example.com", "Patient: [משפחה]  ID: [ID]  DOB: [DOB]  Phone: [PHONE]  Email: [email]"),
]


def test_builtin_catalogue(spark):
    assert len(builtin()) == 14 and sum(len(f.patterns) for f in builtin()) == 25
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)] + [(99, None)], "doc_id int, text string")
    out = {r.doc_id: r for r in redact(df, builtin()).collect()}
    for i, (text, want) in enumerate(GOLDEN):
        assert out[i].redacted_text == want
        ends = 0
        for m in out[i].matches:
            assert m.matched_text == text[m.start : m.start + m.length] and m.start >= ends
            ends = m.start + m.length
        assert out[i].match_count == len(out[i].matches)
    assert out[99].redacted_text is None and out[99].match_count == 0


def test_preserve_zones_only_suppress_what_they_overlap(spark):
    zone = Field("clinic", (Pattern("Regex", r" at example.*"),), is_preserve=True)
    df = spark.createDataFrame([(1, "Patient: כהן at Example Clinic 123456782")], "doc_id int, text string")
    assert redact(df, [*builtin(), zone]).first().redacted_text == "Patient: [משפחה] at Example Clinic 123456782"


def test_overlaps_go_to_the_earliest_then_longest(spark):
    spans = [(0, 6), (5, 9), (5, 4), (6, 2)]
    rows = spark.createDataFrame([([(a, n, "v") for a, n in spans],)], "h array<struct<start:int,length:int,value:string>>")
    kept = rows.select(without_overlaps(ordered(stamped(F.col("h"), "f", "r", 0))).alias("k")).first().k
    assert [(m.start, m.length) for m in kept] == [(0, 6), (6, 2)]


def test_touching_is_no_overlap_and_empty_zones_cut_inside(spark):
    rows = spark.createDataFrame([([(0, 3, "v"), (3, 3, "v"), (6, 2, "v")], [(4, 0, "")])], "h array<struct<start:int,length:int,value:string>>, z array<struct<start:int,length:int,value:string>>")
    kept = rows.select(outside(F.col("h"), F.col("z")).alias("k")).first().k
    assert [m.start for m in kept] == [0, 6]


def test_field_priority_decides_nothing_and_inactive_fields_rest(spark):
    a = Field("a", (Pattern("Regex", "x", 1), Pattern("WholeWord", "x", 9)), "A", priority=0)
    b = Field("b", (Pattern("Regex", "x"),), "B", priority=1000)
    off = Field("off", (Pattern("Regex", "x y"),), "OFF", is_active=False)
    df = spark.createDataFrame([(1, "x y")], "doc_id int, text string")
    assert redact(df, [off, a, b]).first().redacted_text == "A y"


def test_file_list(spark):
    field = Field("names", (Pattern("FileList", "Tel Aviv\nCohen\nCohen Levi\nA'AKEF\none two three four five six seven"),), "[N]")
    texts = ["Tel,\nAviv Cohen Cohen-Levi -cohen- A'AKEF - Cohen x", "cohen levi cohen", "one two three four five six seven", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {r.doc_id: r for r in redact(df, [field]).collect()}
    assert [(m.start, m.length) for m in out[0].matches] == [(0, 9), (10, 5), (16, 10), (27, 7), (42, 7)]
    assert [m.matched_text for m in out[1].matches] == ["Cohen Levi", "Cohen"]
    assert out[2].match_count == 0 and out[3].match_count == 0 and out[4].redacted_text is None


def test_whole_line_with_an_empty_replacement_deletes_it(spark):
    df = spark.createDataFrame([(1, "a\r\nPatient: x\r\nb")], "doc_id int, text string")
    assert redact(df, [Field("l", (Pattern("WholeLine", "Patient:"),), "")]).first().redacted_text == "a\r\nb"


def test_empty_spans_insert(spark):
    df = spark.createDataFrame([(1, "ab cd")], "doc_id int, text string")
    assert redact(df, [Field("l", (Pattern("Regex", r"(?=c)"),), "|")]).first().redacted_text == "ab |cd"


def test_no_shuffle_for_a_catalogue_without_term_lists(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = redact(docs, builtin())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "mail a.b@c.de", "s", "f", "z")], "doc_id int, text string, _sketch string, _found string, _zones string")
    row = redact(df, [*builtin(), Field("keep", (Pattern("WholeWord", "mail"),), is_preserve=True)]).first()
    assert (row.redacted_text, row._sketch, row._found, row._zones) == ("mail [email]", "s", "f", "z")


def test_json(spark):
    df = spark.createDataFrame([(1, "to a.b@c.de")], "doc_id int, text string")
    row = as_json(redact(df, builtin())).first()
    assert row.json == '{"redactedText":"to [email]","matchCount":1,"fieldsHit":["Email Address"],"matches":[{"startIndex":3,"length":8,"fieldName":"Email Address","replacement":"[email]"}]}'


@pytest.mark.parametrize("catalogue", [[], [Field("none")]])
def test_empty_catalogues(spark, catalogue):
    df = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    assert redact(df, catalogue).first().redacted_text == "x"
    assert with_matches(df.limit(0), catalogue).count() == 0
