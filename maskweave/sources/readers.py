"""Documents from files: plain texts, and binary files through extractors that are looked up by their type."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension

# File types by extension.
TYPES = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".bmp": "image/bmp",
    ".txt": "text/plain",
}
OTHER = "application/octet-stream"
#: Embedded images of fewer bytes are not worth recognising; texts of fewer characters are a scan's.
LEAST_IMAGE_BYTES, LEAST_TEXT = 1024, 20

Extractor = Callable[[bytes], str]
#: (whether it takes a type, extractor), asked in order.
EXTRACTORS: list[tuple[Callable[[str], bool], Extractor]] = [(lambda mime: mime.startswith("text/"), lambda content: content.decode("utf-8-sig", "replace"))]


def register(takes: Callable[[str], bool], extractor: Extractor) -> None:
    """Add an extractor for further types, such as a PDF or recognition library of one's own."""
    EXTRACTORS.append((takes, extractor))


def mime_type(path: Column) -> Column:
    out = F.lit(OTHER)
    for ext, mime in TYPES.items():
        out = F.when(extension(path) == ext, mime).otherwise(out)
    return out


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, line ends as they are, without a byte order mark."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", F.regexp_replace("value", "^\\uFEFF", "").alias("text"))


def inline(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(doc_id, text) of texts that are given with a request; a blank one is refused."""
    if any(not t or not t.strip() for t in texts):
        raise ValueError("a text cannot be blank")
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def folder(spark: SparkSession, path: str, globs: list[str] | None = None) -> DataFrame:
    """(path, mime, length, content) of a folder's own files; without globs all but .txt files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
    if globs:
        reader = reader.option("pathGlobFilter", "{" + ",".join(globs) + "}")
    files = reader.load(path).withColumn("mime", mime_type(F.col("path")))
    if not globs:
        files = without_texts(files)
    return files.select("path", "mime", "length", "content")


def without_texts(files: DataFrame) -> DataFrame:
    """files(path, ...) but those whose names end in .txt, which are a batch's own results."""
    return files.filter(~F.lower("path").endswith(".txt"))


def worth_recognising(images: DataFrame, length: str = "length") -> DataFrame:
    """Embedded images of LEAST_IMAGE_BYTES or more."""
    return images.filter(F.col(length) >= LEAST_IMAGE_BYTES)


def is_scan(text: Column) -> Column:
    """Whether a page has so little text of its own that its picture is to be recognised; null counts as none."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < LEAST_TEXT


def listing(files: DataFrame) -> DataFrame:
    """(path, mime, length) of files, by path: contents are neither read nor sorted."""
    return files.select("path", "mime", "length").orderBy("path")


def response(rows: DataFrame, extractor: str, text: str = "text") -> DataFrame:
    """rows with text that isn't blank, with its length in code points and the extractor's name."""
    return rows.filter(F.col(text).rlike("\\S")).withColumns({"char_count": F.length(text), "extractor_used": F.lit(extractor)})


def extracted(files: DataFrame) -> DataFrame:
    """(path, mime, length, text, error): a file that no extractor takes, or one fails on, has an error and no text.

    Files go to Python in batches that Spark cuts at 64 MB (spark.sql.execution.arrow.maxBytesPerBatch); a larger one by itself.
    """
    extractors = list(EXTRACTORS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errors = [], []
            for mime, content in zip(pdf["mime"], pdf["content"], strict=True):
                text = error = None
                try:
                    own = next((e for takes, e in extractors if takes(mime)), None)
                    error = f"unsupported type {mime}" if own is None else None
                    text = own(bytes(content)) if own else None
                except Exception as e:  # one bad file doesn't end the job
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"path": pdf["path"], "mime": pdf["mime"], "length": pdf["length"], "text": pd.Series(texts, dtype=object), "error": pd.Series(errors, dtype=object)})

    return files.select("path", "mime", "length", "content").mapInPandas(run, "path string, mime string, length long, text string, error string")


def first_text(*columns: str) -> Column:
    """The first of several engines' texts that is not blank, trimmed; null if all are."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def paged(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) of pages(key, page, text): each page under a line with its number."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: F.concat(F.lit("[Page "), p["page"].cast("string"), F.lit("]\n"), p["text"], F.lit("\n")))
    return pages.groupBy(key).agg(F.array_join(lines, "").alias("text"))
