import pytest
from pyspark.sql import functions as F

from maskweave.operators import boxes, logs
from maskweave.operators.patterns import occurrences
from maskweave.plans import catalog
from maskweave.plans.builtin import builtin
from maskweave.sources import readers, terms, writers


FIELDS = [
    (1, None, "Email", "[email]", True, False, 0),
    (2, None, "Ward", "████", True, True, 999),
    (3, 7, "Case number", "[CASE]", True, False, 500),
    (4, None, "Old", "[OLD]", False, False, 10),
    (5, 8, "Name", "[NAME]", True, False, 500),
]
PATTERNS = [(1, 1, "Regex", "a@b", 100), (2, 1, "Like", "*@c.d", 600), (3, 2, "ConstList", "Ward A|ward b", 999), (4, 2, "WholeWord", "Ward C", 50), (5, 3, "NumberSequence", "6", 80), (6, 4, "WholeWord", "x", 5)]


def small_catalogue(spark):
    return spark.createDataFrame(FIELDS, catalog.FIELD_SCHEMA), spark.createDataFrame(PATTERNS, catalog.PATTERN_SCHEMA)


def test_tables_round_trip(spark):
    fields, patterns = catalog.tables(spark, builtin())
    assert catalog.load(fields, patterns) == builtin()


def test_load_by_client(spark):
    assert [f.name for f in catalog.load(*small_catalogue(spark))] == ["Email", "Ward"]
    assert [f.name for f in catalog.load(*small_catalogue(spark), client_id=7)] == ["Email", "Ward", "Case number"]


def test_edits(spark):
    fields, patterns = small_catalogue(spark)
    more = catalog.add_field(fields, "New", " ")
    new = more.filter("id = 6").first()
    assert (new.replace_with, new.priority, new.is_active) == (catalog.MASK, 500, True)
    assert catalog.updated(more, 6, is_active=False, replace_with="x").filter("id = 6").first().replace_with == "x"
    f, p = catalog.without_field(fields, patterns, 1)
    assert f.count() == 4 and p.filter("field_id = 1").count() == 0
    f, p = catalog.add_preserve(fields, patterns, "Keep", ["a", "b"])
    assert p.filter("field_id = 6").first().pattern == "a|b" and f.filter("id = 6").first().is_preserve
    assert catalog.effective_priority(fields, patterns).first().field_name == "Ward"
    settings = spark.createDataFrame([("a", "1", "first"), ("b", "2", None)], "key string, value string, description string")
    assert {tuple(r) for r in catalog.upserted(settings, "a", "9").collect()} == {("a", "9", "first"), ("b", "2", None)}
    assert {tuple(r) for r in catalog.upserted(settings, "c", "9").collect()} >= {("c", "9", None)}
    assert catalog.seeded(settings, spark.createDataFrame([("b", "x"), ("d", "y")], "key string, value string"), "key").count() == 3


def test_edits_of_patterns(spark):
    fields, patterns = small_catalogue(spark)
    assert catalog.without_pattern(patterns, 2).count() == 5 and catalog.without_pattern(patterns, 99).count() == 6
    assert catalog.pattern_by_id(fields, patterns, 99).count() == 0
    with pytest.raises(ValueError):
        catalog.append_value(patterns, 2, "  ")
    assert [catalog.of_kind(fields, kind).count() for kind in (None, True, False)] == [5, 1, 4] and catalog.by_kind(fields.limit(0)).first().n_all == 0
    new = spark.createDataFrame([("beta",), ("Alpha",)], "term string")
    more = catalog.import_terms(patterns, 5, new)
    assert more.filter("field_id = 5").first()[2:] == ("FileList", "Alpha\nbeta", 100)
    other = spark.createDataFrame([("BETA",), ("gamma",)], "term string")
    assert catalog.import_terms(more, 5, other, append=True).filter("field_id = 5").first().pattern == "Alpha\nBETA\ngamma"
    assert catalog.import_terms(more, 5, other).filter("field_id = 5").first().pattern == "BETA\ngamma"
    with pytest.raises(ValueError):
        catalog.import_terms(more, 5, new.limit(0))
    clients = spark.createDataFrame([(1, "a", "old"), (2, "b", "old")], "id int, name string, api_key_hash string")
    assert {r.id: r.api_key_hash == "old" for r in catalog.with_new_key(clients, 2, "k").collect()} == {1: True, 2: False}
    assert logs.by_key(spark.createDataFrame([("k",)], "api_key string"), catalog.with_new_key(clients, 2, "k").selectExpr("*", "true AS is_active")).first().client_id == 2


def test_terms_in_windows_1255(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("שלום\r\nתל אביב\r\n".encode("cp1255"))
    (tmp_path / "b.txt").write_bytes("\ufeffחיפה\n".encode())
    (tmp_path / "c.txt").write_bytes(b"")
    assert {r.term for r in terms.read(spark, str(tmp_path / "*.txt")).collect()} == {"שלום", "תל אביב", "חיפה"}


def test_outcomes_listing_and_response(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "bad")], "id int, error string")
    assert tuple(logs.outcomes(rows).first()) == (1, 1, 2) and tuple(logs.outcomes(rows.limit(0)).first()) == (0, 0, 0)
    for name in ("b.png", "a.pdf"):
        (tmp_path / name).write_bytes(b"12")
    assert [(r.path[-5:], r.length) for r in readers.listing(readers.folder(spark, str(tmp_path))).collect()] == [("a.pdf", 2), ("b.png", 2)]
    texts = spark.createDataFrame([("ab",), (" \n\t",), ("",), (None,)], "text string")
    assert [tuple(r) for r in readers.response(texts, "plain").collect()] == [("ab", 2, "plain")]
    found = texts.select(occurrences(F.lit("A.b a.B axb a.ba.b"), "a.b").alias("v"), F.size(occurrences(F.lit("x"), " ")).alias("n")).first()
    assert [h.start for h in found.v] == [0, 4, 12, 15] and found.n == 0


def test_terms(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("# c\n\nDana  Levi\n'Tel Aviv'\n(x)\n[Haifa]|ab\nDANA\n", "utf-8")
    got = [r.term for r in terms.read(spark, str(path)).collect()]
    assert got == ["ab", "DANA", "Haifa", "Levi", "Tel Aviv"]
    assert terms.serialised(terms.read(spark, str(path))).first().pattern == "ab\nDANA\nHaifa\nLevi\nTel Aviv"
    assert [r.term for r in terms.search(terms.read(spark, str(path)), "A", 2).collect()] == ["ab", "DANA"]
    assert [r.term for r in catalog.without_term(terms.read(spark, str(path)), "dana").collect()] == ["ab", "Haifa", "Levi", "Tel Aviv"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo\n")
    (tmp_path / "b.zip").write_bytes(b"PK")
    (tmp_path / "c.TXT").write_bytes(b"x\xffy")
    assert readers.plain_text(spark, str(tmp_path / "a.txt")).first().text == "one\r\ntwo\n"
    assert [r.path[-5:] for r in readers.folder(spark, str(tmp_path)).collect()] == ["b.zip"]
    out = {r.path[-5:]: r for r in readers.extracted(readers.folder(spark, str(tmp_path), ["*"])).collect()}
    assert out["a.txt"].text == "one\r\ntwo\n" and out["c.TXT"].text == "x�y" and out["b.zip"].text is None and "unsupported" in out["b.zip"].error


def test_event_rows(spark):
    event = spark.createDataFrame([(1, 2, ["f", "g"], "x" * 9, "y")], "doc_id int, match_count int, fields_hit array<string>, text string, redacted_text string")
    assert writers.event(event, False).first().text is None and writers.event(event, True, 4).first().text == "xxxx..."


def test_logs(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01"), (3, "2024-03-31")], "id int, d string").withColumn("requested_at", F.to_timestamp("d"))
    assert [r.id for r in logs.within_retention(rows, F.to_timestamp(F.lit("2024-04-01")), 0).orderBy("id").collect()] == [2, 3]
    assert logs.page_count(rows.limit(0)).first().pages == 1
    assert [r.id for r in logs.page(rows, 2, size=2).collect()] == [1]
    ids = [*range(0, 400, 3), *range(10**6, 10**6 + 40), -5, -5, None, None]
    many, latest = spark.createDataFrame([(i,) for i in ids], "id long"), sorted((i for i in ids if i is not None), reverse=True) + [None, None]
    for n in (1, 2, 4, 25, 26, 40):
        assert [r.id for r in logs.page(many, n, size=7).collect()] == latest[(n - 1) * 7 : n * 7]
    assert logs.page(many.limit(0), 3).count() == 0 and logs.page(many.filter("id is null"), 1).count() == 2
    assert not logs.quota_state(logs.quota_used(rows.withColumn("client_id", F.lit(1))), 0).first().refused
    bad = spark.createDataFrame([("[",), ('["a"]',), (None,)], "j string").select(logs.parsed_fields(F.col("j")).alias("f"))
    assert [r.f for r in bad.collect()] == [[], ["a"], []]
    results = spark.createDataFrame([("a.txt", 2047, ["f"]), ("b.txt", 10, [])], "file_name string, length long, fields_hit array<string>")
    got = {r.file_name: r for r in logs.entries(results, 3, F.current_timestamp()).collect()}
    assert got["a.txt"].file_size_kb == 1 and got["a.txt"].fields_hit == '["f"]' and got["b.txt"].fields_hit is None and got["b.txt"].error_msg is None


def test_boxes(spark):
    passes = spark.createDataFrame([(1, 0, "short"), (1, 1, "x" * 25), (1, 2, "y" * 30), (2, 0, "ab"), (2, 1, "abc")], "doc_id int, pass int, text string")
    assert {r.doc_id: r.text[:3] for r in boxes.best_pass(passes).collect()} == {1: "xxx", 2: "abc"}
    pixels = spark.createDataFrame([(1, 0, 0, 0), (1, 10, 10, 10), (1, 255, 255, 255), (2, 255, 255, 255)], "doc_id int, r int, g int, b int")
    assert {r.doc_id: r.dark for r in boxes.is_dark(pixels).collect()} == {1: True, 2: False}
    word = "array<struct<text:string,x:double,y:double,width:double,height:double>>"
    scaled = spark.createDataFrame([(1, 2.5, [("a", 25.0, 5.0, 10.0, 10.0)]), (1, 1.0, [])], f"doc_id int, scale double, words {word}")
    assert boxes.all_passes(scaled).first().x == 10.0
    out = spark.createDataFrame([(-5.0, -5.0, 3.0, 3.0), (900.0, 0.0, 910.0, 5.0)], "left double, top double, right double, bottom double")
    assert [tuple(r) for r in boxes.clamped(out, 640, 480).collect()] == [(0.0, 0.0, 3.0, 3.0)]
