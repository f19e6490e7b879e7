"""Long texts, unclosed markup, rows under one key: shapes that once took too long, too much memory or one task."""

import random
import sys
import time
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskweave.llm import bpe, common, html, packing, pii, quality, secrets
from maskweave.llm.markup import blocks, tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def seconds(run):
    begin = time.time()
    run()
    return time.time() - begin


# ---- pages


def main(page):
    return [text for _, text, _, aside in blocks(page)[1] if not aside]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>one</p><svg viewBox='0'/><p>two</p>", ["one", "two"]), ("<p>one</p><iframe src=x /><p>two</p>", ["one", "two"]), ("<p>one</p><video src=x><p>two</p>", ["one", "two"]),
        ("<p title=it's>foo</p><p>don't stop</p>", ["foo", "don't stop"]), ("<section class='responses'><p>r</p></section><p>x</p>", ["x"]), ("<div class='discussion'>d</div><p>y</p>", ["y"]),
        ("<div class='cookie-recipe'>flour</div>", ["flour"]), ("<div class='cookie-notice-box'>ok</div>z", ["z"]), ("<article><div class=discussion>kept</div></article>", ["kept"]),
        ("a < b <3 &lt; c", ["a < b <3 < c"]), ("<!-->x<!-- y -->z", ["xz"]), ("<title>t</title>u<textarea>v", ["uv"]), ("<svg><svg></svg>in</svg>out", ["out"]), ("<video>a</video>b<video>c", ["bc"]),
        ("<select><option>1<option>2</select>s", ["s"]), ('x<a href="a>b">l</a>', ["xl"]), ("x<script>var a='<p>'</script >y", ["xy"]), ("x<script>y", ["x"]), ("x<a href='", ["x"]), ("x</ >y</>z<?php ?>", ["xyz"]),
        ("x<IFRAME>y</iframe>z", ["xz"]), ("<p>a<p class='x>b'>c", ["a", "c"]), ("", []),
    ],
)
def test_markup(page, want):
    assert main(page) == want


@given(st.lists(st.sampled_from(["<", ">", "/", "a", "p", "div", "'", '"', "=", " ", "!--", "-->", "svg", "script", "title", "x", "&amp;", "é"]), max_size=40).map("".join))
@settings(max_examples=500, deadline=None)
def test_any_markup_is_read_to_its_end(page):
    read = list(tokens(page))
    assert all(kind in ("text", "start", "end", "closed") for kind, _, _ in read)
    if "<" not in page:
        assert [t for _, _, t in read] == ([page] if page else [])
    blocks(page)


@pytest.mark.parametrize("page", ["<div>" * 200_000, "<a " * 340_000, "<" * 1_000_000, "<div>" * 100_000 + "</b>" * 100_000, "<title>" * 140_000, "<!--" * 250_000, "<a " + "=" * 1_000_000 + ">x", "<svg>" * 200_000, "<p>" * 100_000 + "<ul>" * 100_000, "<div>" * 100_000 + "</div>" * 90_000])
def test_a_megabyte_of_markup(page):
    """Time in proportion to the page: twice the page takes no more than three times as long, some noise aside."""
    half = min(seconds(lambda: blocks(page[: len(page) // 2])) for _ in range(2))
    assert min(seconds(lambda: blocks(page)) for _ in range(2)) < 3 * half + 0.3


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://h.example/x", "<p>text", 5, "t", "h")] * 2
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string, host string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "text", 4)] * 2


# ---- personal data


def test_long_written_out_addresses(spark):
    """Once a stack overflow that took the whole JVM."""
    rows = [(i, "x at y" + ".b" * n) for i, n in enumerate((1, 2_000, 50_000))] + [(9, "x at y" + " dot b" * 20_000)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 9]
    assert spark.createDataFrame([("x at y" + ".b" * 2_000,)], "t string").select(pii.matches(F.col("t"), pii.LIKE_EMAIL).alias("m")).first().m[0].end == 4_006


def test_contexts_are_whole_words(spark):
    """Words that reach back further than REACH are no context, wherever they are cut; chunks change nothing."""
    long = "w" * 300
    filler = "ab " * 3000
    texts = ["call me 1", "me 1", f"{long} me 1", f"{'v' * 100} {'u' * 150} 1", f"{'v' * 120} {'u' * 150} 1", filler + "Call  M2e 1", filler + f"{long} me 1", "x" * 4094 + " b c 1", "y" * 4090 + " bb ccc 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    df = df.withColumn("c", pii._chunks(F.col("text"))).select("i", pii._context(F.col("c"), F.length("text") - 1).alias("context"))
    got = {r.i: r.context for r in df.collect()}
    assert got == {0: "call me", 1: None, 2: None, 3: f"{'v' * 100} {'u' * 150}", 4: None, 5: "call m0e", 6: None, 7: "b c", 8: "bb ccc"}


def test_many_spans_in_one_text(spark):
    """20,000 look-alikes beside 20,000 base spans."""
    text = "call me +1 415 555 0100 or id 12345678901234 now " * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert seconds(lambda: pii.find_pii(df).select("doc_id", "n_phone").collect()) < 90


# ---- packing, labels, secrets, words


def test_a_third_of_all_rows_without_id_or_text_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 500)
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("word "), F.col("id").cast("string"))).alias("text"))
    rows = packing.pack(df, VOCABULARY).collect()
    assert len(rows) == 6000
    sizes = {}
    for r in rows:
        sizes[r.sequence_id % 12] = sizes.get(r.sequence_id % 12, 0) + 1
    assert max(sizes.values()) < 1.4 * 6000 / 12
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= packing.WINDOW


def test_labels_of_a_repeated_document_are_bounded(spark, monkeypatch):
    hot = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text"))
    labels = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    met = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: met.append(len(x)) or fit(x, y))
    quality.train(docs, labels, rows=100)
    assert met == [100]


def test_secrets_of_a_long_text_take_time_in_proportion():
    r = random.Random(1)
    line = lambda: "".join(r.choice("0123456789abcdef") for _ in range(32)) + " "
    text = "".join(line() for _ in range(16_000))

    def scan(t):
        return secrets.entropy_spans(t, secrets.base_spans(t))

    half = min(seconds(lambda: scan(text[: len(text) // 2])) for _ in range(2))
    assert min(seconds(lambda: scan(text)) for _ in range(2)) < 3 * half + 0.3


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=12), st.lists(st.tuples(st.integers(0, 70), st.integers(1, 15)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_uncovered_parts(taken, ranges):
    spans = sorted((a, a + n, "k") for a, n in taken)
    asked, at, uncovered = [], 0, secrets.Uncovered(spans)
    for a, n in sorted(ranges):
        if a >= at:
            asked.append((a, a + n))
            at = a + n
    for a, b in asked:
        free = [i for i in range(a, b) if not any(s <= i < e for s, e, _ in spans)]
        assert [i for x, y in uncovered.parts(a, b) for i in range(x, y)] == free


def test_long_words_are_not_remembered(spark):
    memory = bpe.Memory(len)
    assert memory["x" * 10_000] == 10_000 and memory["word"] == 4 and list(memory) == ["word"]
    docs = spark.createDataFrame([(i, "y" * 5_000 + " short") for i in range(5)], "doc_id long, text string")
    assert bpe.frequent_words(docs, VOCABULARY) == ["short"]


def test_what_is_remembered_is_bounded_in_bytes():
    """Words of 48 letters of four bytes have hundreds of ids: as many as fit are remembered, the last ones met among them."""
    path, n = VOCABULARY, 60_000
    memory = bpe.Memory(lambda w: bytes(768))
    words = [chr(0x10400 + i % 1000) * 40 + chr(0x10400 + i // 1000) * 8 for i in range(n)]
    assert all(memory[w] == bytes(768) for w in words)
    held = {**memory.older, **memory}
    assert sum(map(sys.getsizeof, held)) + sum(map(sys.getsizeof, held.values())) <= 50_000_000
    assert set(words[-10_000:]) <= set(held)
    assert bpe.encoder(path).encode_packed("walking " * 3) == bpe.encoder(path).encode_packed("walking") * 3


def test_staged_rows_go_to_python_in_small_batches(spark):
    """A batch ends soon after 4 MB; the session's own limit, if it names one, stays."""
    docs = spark.range(400, numPartitions=1).selectExpr("id", "repeat('x', 50000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

    def seen(name):
        return common.staged(docs.mapInArrow(sizes, "bytes long, rows long"), name).agg(F.max("bytes"), F.sum("rows")).first()

    most, rows = seen("small")
    assert rows == 400 and most < 5_000_000 and spark.conf.get(common.BATCH_BYTES, None) is None
    spark.conf.set(common.BATCH_BYTES, 8_000_000)
    try:
        most, rows = seen("own")
        assert rows == 400 and most > 7_000_000 and spark.conf.get(common.BATCH_BYTES).startswith("8000000")
    finally:
        spark.conf.unset(common.BATCH_BYTES)
