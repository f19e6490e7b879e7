"""The pipeline as a chain on odd tables, and spots built anew from words."""

from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from maskweave.llm import spotsigs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def prose(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars between 500 and 5000").orderBy("doc_id").limit(60).collect()
    return [tuple(r) for r in rows if not regex.search("[0-9@+]", r.text)]


def through(spark, tmp_path, rows, more=""):
    import corpus_pipeline

    df = spark.createDataFrame(rows, SCHEMA)
    df = df.selectExpr("*", *more.split(", ")) if more else df
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    seen, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    from maskweave.llm.common import staged

    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == df.columns
    return seen


def test_the_chain_on_odd_rows(spark, tmp_path, prose):
    """Null and empty texts go, rows that repeat are one, null ids stay with their texts, further columns come along."""
    plain = prose[:20]
    without_id = [(None, t, lang, s, n) for _, t, lang, s, n in prose[20:24]]
    odd = [(10**6, None, "en", "s", None), (10**6 + 1, "", None, None, 0), (None, None, None, None, None), (10**6 + 2, " \n\t", "fr", "s", 3), (10**6 + 3, "?!", "de", "s", 2)]
    seen = through(spark, tmp_path, [*plain, *plain[:5], *without_id, *without_id[:1], *odd], "1 as kept, 'x' as class_id, 2 as component, 'y' as spans, 3 as score, 'z' as _hash, 4 as more, 5 as place")
    counts = {name: df.count() for name, df in seen.items() if name != "packing"}
    assert counts["language"] >= counts["exact_dedup"] >= counts["near_dedup"] == counts["pii"]
    assert counts["exact_dedup"] == len(plain) + len(without_id)
    assert seen["pii"].filter("kept = 1 and class_id = 'x' and component = 2 and spans = 'y' and score = 3 and _hash = 'z' and more = 4 and place = 5").count() == counts["pii"]
    ids = {r.doc_id for r in seen["packing"].collect()}
    assert ids == {r.doc_id for r in seen["pii"].collect()} and None in ids and not ids & {r[0] for r in odd if r[0]}


def test_the_chain_on_an_empty_table(spark, tmp_path):
    assert all(df.count() == 0 for df in through(spark, tmp_path, []).values())


def test_the_chain_without_any_language(spark, tmp_path, prose):
    """Where no row has a language there is none to learn, and all go."""
    assert all(df.count() == 0 for df in through(spark, tmp_path, [(i, t, None, s, n) for i, t, _, s, n in prose[:5]]).values())


# ---- spots

COMMON = {w for line in spotsigs.ANCHORS for w in line.split()}


def spots(text):
    """The multiset of spots, each as its words."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    n, out = len(words), []

    def content(i):
        return i < n and words[i] not in COMMON

    for i in range(n - 1):
        if content(i):
            if content(i + 1) and content(i + 2):
                out.append(("content", *words[i : i + 3]))
        elif content(i + 1):
            out.append(("anchor", words[i], words[i + 1], next((words[k] for k in range(i + 2, min(i + spotsigs.PASSED + 3, n)) if content(k)), None)))
        elif i + spotsigs.PASSED < n and not any(content(k) for k in range(i + 1, i + spotsigs.PASSED + 1)):
            out.append(("anchors", *words[i : i + spotsigs.PASSED + 1]))
    if not out:
        out = [tuple(words[i : i + 3]) for i in range(n - 2)] if n > 2 else [tuple(words)] if n else []
    return Counter(out)


def likeness(a, b):
    both = (a & b).total()
    return 1.0 if not a and not b else both / (a.total() + b.total() - both)


def test_likenesses_equal_those_of_spots_built_from_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**7, "the of and to in a is that"), (10**7 + 1, "The cat"), (10**7 + 2, ""), (10**7 + 3, None), (10**7 + 4, "der die das und in zu den von mit"), (10**7 + 5, "one two three four five six seven eight"), (10**7 + 6, "漢字 the 漢字 the 漢字")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text or "") for r in docs.union(more).collect())
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs.union(more)).collect()}
    for (i, text), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        own = spots(text)
        assert got[i].near_edited == pytest.approx(likeness(own, spots(edited)), abs=1e-9), i
        assert got[i].near_next == pytest.approx(likeness(own, spots(after)), abs=1e-9), i
        assert len(got[i].fingerprint.split()) == own.total()


def test_most_of_an_edited_text_is_found_again(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 400")
    mean = spotsigs.fingerprints(docs).agg(F.avg("near_edited").alias("edited"), F.avg("near_next").alias("next")).first()
    assert mean.edited > 0.5 and mean.next < 0.2
