import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from maskweave.llm.pii import find_pii, redact

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    d = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    spans = [(k, m.start(), m.end()) for k, p in FORMS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]
    return spans, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


TEXTS = [
    None, "", "a@b.co", "x a.b%c@d-e.f.g..h a@b a@@b.c a@b.c@d.e", "a@b.com_x@c.de,+q@r.st", "é😀 ünï@x.y 漢z@x.y", "1.2.3.4.5.6.7.8 256.1.1.1 0255.0.0.1 1.2.3 ..1.2.3.4.",
    "4111 1111 1111 1111, 4111-1111-1111-1111 41111111111111111111 4111  1111 1111 1111", "0000000000000000 1 0000000000000000", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+1 (017) 555-7713 +1+2 +12345678+ +1-) +123456789012345678 ++4930123456",
    "1 " * 30000, "a." * 20000 + "@x.y", "x@" + "a." * 20000 + "b", "9" * 50000, "tél +33 1 23 45 67 89 😀 +33 1 23 45 67 89",
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    return {r.doc_id: r for r in find_pii(df).collect()}


def test_base_forms_equal_brute_force(found):
    for i, t in enumerate(TEXTS):
        spans, sha = brute(t)
        assert found[i].base_sha256 == sha, (i, t and t[:60], spans, found[i].spans)
        assert [found[i][f"n_{k}"] for k in FORMS] == [sum(s[0] == k for s in spans) for k in FORMS]


def test_base_forms_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: brute(r.text)[1] for r in docs.collect()}
    assert {r.doc_id: r.base_sha256 for r in find_pii(docs).collect()} == want


def test_context_reveals_what_no_form_has(spark):
    """Numbers that follow the words of at least three phone numbers are taken; the same shapes elsewhere are not."""
    rows = [(i, f"Please ring my mobile +1 (212) 555-01{i}{i} at noon") for i in range(10, 20)]
    rows += [(50, "Please ring my mobile 212 555 0199 at noon"), (51, "It weighs exactly 212 555 0198 grams"), (None, "and my mobile 212 555 0197")]
    out = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[50].spans == "phone:22:34" and out[50].n_phone == 0 and out[50].n_discovered == 1
    assert out[51].spans == "" and out[None].spans == "phone:14:26"


def test_bad_contexts_stay_out(spark):
    """Where most numbers after the same words are no phone numbers, the rest isn't taken for one."""
    rows = [(i, f"call the number +1 (212) 555-01{i}{i} now") for i in range(10, 14)] + [(i, f"call the number 5551{i:04d} now") for i in range(100, 160)]
    assert all(r.n_discovered == 0 for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_redact(spark):
    rows = [(1, "to a@b.co or 1.2.3.4!", "k"), (1, "to a@b.co or 1.2.3.4!", "k"), (2, None, None), (3, "", "z"), (4, "no data", "k"), (None, "😀 +49 30 1234567", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    out = redact(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text, r.kind) for r in out.collect() if r.text is not None) == [(0, "😀 [PHONE]", "y"), (1, "to [EMAIL] or [IP]!", "k"), (1, "to [EMAIL] or [IP]!", "k"), (3, "", "z"), (4, "no data", "k")]
    assert out.filter("text is null").count() == 1


def test_redact_covers_overlapping_spans(spark):
    """What a second span covers beyond the end of the first does not stay."""
    rows = [(1, "+1 415 555 0100 7up@mail.com now"), (2, "at 10.0.0.4 4111111111111117, paid"), (3, "+1 415 555 0100a@b.co"), (4, "4111 1111 1111 1111 or a@b.co")]
    assert find_pii(spark.createDataFrame(rows[1:2], "doc_id long, text string")).first().spans == "ip:3:11,card:10:28"
    got = {r.doc_id: r.text for r in redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "[PHONE] now", 2: "at [IP], paid", 3: "[PHONE]", 4: "[CARD] or [EMAIL]"}


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert find_pii(empty).count() == 0 and redact(empty).count() == 0
    twice = spark.createDataFrame([(1, "a@b.co")] * 3, "doc_id long, text string")
    assert find_pii(twice).agg(F.sum("n_email")).first()[0] == 3


def _spans(spark, rows):
    return {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_no_pattern_vouches_for_itself(spark):
    """Nine phone numbers and eleven order numbers after the same words: none of the latter is a phone number."""
    rows = [(i, f"please quote number +1 415 555 01{i:02d} now") for i in range(9)] + [(100 + i, f"please quote number 71{i:02d}{i:02d}8845 now") for i in range(11)]
    got = _spans(spark, rows)
    assert all(got[i].startswith("phone:") for i in range(9)) and not any(got[100 + i] for i in range(11))


def test_seeds_of_another_kind_count_against_a_pattern(spark):
    rows = [(i, f"my contact is +1 415 555 01{i:02d} now") for i in range(5)] + [(50 + i, f"my contact is user{i}@mail.example now") for i in range(5)] + [(100, "my contact is 415 555 0190 now")]
    assert not _spans(spark, rows)[100]


def test_discovered_values_give_new_patterns(spark):
    """Numbers that a good context reveals make another context good, which reveals one more; that one stands in no seed's context."""
    rows = [(i, f"call me at +1 415 555 0{i:03d} now") for i in range(100)]
    rows += [(100 + i, f"call me at 650 555 01{i:02d} now") for i in range(8)] + [(200 + i, f"hotline desk line 650 555 01{i:02d} now") for i in range(8)] + [(300, "hotline desk line 650 555 0177 now"), (301, "other words here 650 555 0178 now")]
    got = _spans(spark, rows)
    assert all(got[100 + i].startswith("phone:") and got[200 + i].startswith("phone:") for i in range(8))
    assert got[300].startswith("phone:") and not got[301]


def test_written_out_addresses(spark):
    rows = [(i, f"please write to user{i}@mail.example today") for i in range(12)] + [(100, "please write to ann [at] host dot com today"), (101, "we met at noon dot dot")]
    got = _spans(spark, rows)
    assert got[100] == "email:16:37" and not got[101]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@ex.com" for i in range(20000))
    began = time.time()
    row = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_email == 20000 and time.time() - began < 60
    assert redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == " ".join(["[EMAIL]"] * 20000)
