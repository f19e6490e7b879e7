from maskweave.plans.builtin import builtin
from maskweave.plans.catalog import Field, Pattern
from maskweave.plans.redact import redact
from maskweave.streaming.redact import read_folder, redact_batches, redact_stream

SCHEMA = "doc_id long, text string"


def test_stream_equals_batch_and_archives(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, f"ip 10.0.0.{i} for Dana Levi")], SCHEMA).write.parquet(str(tmp_path / "in" / str(i)))
    docs = read_folder(spark, str(tmp_path / "in" / "*"), SCHEMA)
    q = redact_stream(docs, builtin()).select("doc_id", "redacted_text").writeStream.format("memory").queryName("redacted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert {r.doc_id: r.redacted_text for r in spark.table("redacted").collect()} == {0: "ip [IP] for Dana Levi", 1: "ip [IP] for Dana Levi"}


def test_each_batch_asks_for_the_catalogue(spark, tmp_path):
    spark.createDataFrame([(1, "call Dana Levi")], SCHEMA).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    catalogue = lambda: [Field("n", (Pattern("FileList", "Dana Levi"),), "[N]")]
    q = redact_batches(read_folder(spark, str(tmp_path / "in"), SCHEMA), catalogue, lambda df, n: df.select("doc_id", "redacted_text").write.mode("append").parquet(out), str(tmp_path / "c2"))
    q.awaitTermination()
    assert [r.redacted_text for r in spark.read.parquet(out).collect()] == ["call [N]"]


def test_stream_with_term_lists_and_protected_fields_equals_the_batch(spark, tmp_path):
    rows = [(1, "Bob and Ann Lee at Ward A"), (2, "ann lee-bob"), (3, None), (4, "")]
    catalogue = [Field("who", (Pattern("WholeWord", "bob"), Pattern("FileList", "Ann Lee\nWard")), "[N]"), Field("kept", (Pattern("FileList", "Ward A"),), is_preserve=True)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    docs = read_folder(spark, str(tmp_path / "in"), SCHEMA)
    q = redact_stream(docs, catalogue).select("doc_id", "redacted_text").writeStream.format("memory").queryName("with_terms").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    got = {r.doc_id: r.redacted_text for r in spark.table("with_terms").collect()}
    assert got == {1: "[N] and [N] at Ward A", 2: "ann lee-[N]", 3: None, 4: ""}
    assert got == {r.doc_id: r.redacted_text for r in redact(spark.createDataFrame(rows, SCHEMA), catalogue).collect()}
