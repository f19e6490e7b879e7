"""Batches of a folder: files in, one text file a document out, sources moved aside, outcomes counted once.

``textfolder`` is a sink for rows of path, text and error. A task writes each text beside its final name and then moves
it there, so a text that is written twice, by a task that was run again, is one file all the same. What became of each
row goes to a file of the task's own, and the driver's commit names those of the tasks that counted: one short message
a task. Sources move only after that, by the list that the commit names, so a batch that stops half-way is run again
as if it had not begun.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.text import stem
from ..plans.catalog import Field
from ..plans.redact import redact
from .readers import extracted, folder
from .scratch import file_system

OUTCOMES, COMMITTED = "_outcomes", "_committed.json"
DONE = "done"


# ---- the sink --------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    name: str
    done: int
    failed: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch = path, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = file_system(self.path)
        attempt, counts = uuid.uuid4().hex, [0, 0]
        outcomes = f"{path}/{OUTCOMES}/{self.batch}"
        system.create_dir(outcomes, recursive=True)
        with system.open_output_stream(f"{outcomes}/{attempt}.jsonl") as log:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["error"] is None and row["name"] is not None:
                        self._text(system, path, row["name"], row["text"] or "", attempt)
                    counts[row["error"] is not None] += 1
                    log.write((json.dumps({"path": row["path"], "error": row["error"]}) + "\n").encode())
        return Written(f"{attempt}.jsonl", *counts)

    def _text(self, system: fs.FileSystem, path: str, name: str, text: str, attempt: str) -> None:
        beside = f"{path}/{OUTCOMES}/{self.batch}/{attempt}.part"
        with system.open_output_stream(beside) as out:
            out.write(text.encode("utf-8-sig"))
        system.move(beside, f"{path}/{name}.txt")

    def commit(self, messages: list[Written]) -> None:
        system, path = file_system(self.path)
        system.create_dir(f"{path}/{OUTCOMES}/{self.batch}", recursive=True)
        counted = [m for m in messages if m]
        body = {"files": [m.name for m in counted], "done": sum(m.done for m in counted), "failed": sum(m.failed for m in counted)}
        with system.open_output_stream(f"{path}/{OUTCOMES}/{self.batch}/{COMMITTED}") as out:
            out.write(json.dumps(body).encode())

    def abort(self, messages: list[Written]) -> None:
        """Texts that were written stay: the next run writes them again. Nothing counts without a commit."""


class TextFolder(DataSource):
    """``spark.dataSource.register(TextFolder)`` makes the format ``textfolder`` known; rows: path, name, text, error."""

    @classmethod
    def name(cls) -> str:
        return "textfolder"

    def schema(self) -> str:
        return "path string, name string, text string, error string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["batch"])


def write_texts(results: DataFrame, path: str, text: str = "redacted_text", source: str = "path", batch: str | None = None) -> dict:
    """One ``<stem>.txt`` a document in a folder, in UTF-8 with a mark; {"done", "failed", "files"} of this batch.

    results may have an ``error``: such documents have no file and count as failed. Documents that share a stem all
    count, and the last by path is the one that is kept. Null texts are empty files.
    """
    spark, batch = results.sparkSession, batch or uuid.uuid4().hex
    spark.dataSource.register(TextFolder)
    error = F.col("error") if "error" in results.columns else F.lit(None)
    rows = results.select(F.col(source).alias("path"), stem(F.col(source)).alias("stem"), F.col(text).alias("text"), error.cast("string").alias("error"))
    last = F.max(F.when(F.col("error").isNull(), F.col("path"))).over(Window.partitionBy("stem"))
    named = rows.withColumn("name", F.when(F.col("path") == last, F.col("stem"))).select("path", "name", "text", "error")
    named.write.format("textfolder").option("batch", batch).mode("append").save(path)
    return committed(path, batch)


def committed(path: str, batch: str) -> dict:
    system, where = file_system(path)
    with system.open_input_stream(f"{where}/{OUTCOMES}/{batch}/{COMMITTED}") as file:
        return {"batch": batch, **json.loads(file.read())}


def outcomes(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """(path, error) of a batch's documents, from the files that its commit names."""
    names = committed(path, batch)["files"]
    schema = "path string, error string"
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/{OUTCOMES}/{batch}/{n}" for n in names])


#: Characters of texts, and rows, that a task holds at once when it reads a batch's files; a longer text by itself.
READ_CHARS, READ_ROWS = 4_000_000, 1_000


def with_texts(found: DataFrame, path: str, name: str = "stem") -> DataFrame:
    """found with ``text``, that of the folder's ``<name>.txt``, null where there is none: each row opens its own file, and nothing lists the folder."""
    schema = T.StructType([*found.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, where = file_system(path)

        def text(stem: str | None) -> str | None:
            try:
                with system.open_input_stream(f"{where}/{stem}.txt", compression=None) as file:
                    return None if stem is None else file.read().decode("utf-8-sig", "replace")
            except FileNotFoundError:
                return None

        def out(batch: pa.RecordBatch, begin: int, texts: list[str | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.slice(begin, len(texts)).columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

        for batch in batches:
            begin, texts, held = 0, [], 0
            for stem in batch.column(batch.schema.get_field_index(name)):
                texts.append(text(stem.as_py()))
                held += len(texts[-1] or "")
                if held >= READ_CHARS or len(texts) >= READ_ROWS:
                    yield out(batch, begin, texts)
                    begin, texts, held = begin + len(texts), [], 0
            yield out(batch, begin, texts)

    return found.mapInArrow(run, schema)


# ---- moving ----------------------------------------------------------------------------------------------------------


def move_done(found: DataFrame, done: str) -> None:
    """Move the sources of documents that did not fail to another folder; one that is there already is replaced."""

    def move(rows) -> None:
        for r in rows:
            system, source = file_system(r.path)
            _, target = file_system(done)
            if system.get_file_info(source).type == fs.FileType.File:  # else a task before this one has moved it
                system.move(source, f"{target}/{source.rsplit('/', 1)[1]}")

    system, target = file_system(done)
    system.create_dir(target, recursive=True)
    found.filter("error IS NULL").select("path").foreachPartition(move)


# ---- the batch -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Job:
    """One folder's work."""

    enabled: bool = False
    input_folder: str | None = None
    output_folder: str | None = None
    file_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Config:
    """What a configuration file says, whatever the case of its keys."""

    extract: Job = field(default_factory=Job)
    redact: Job = field(default_factory=Job)
    move_processed_to_done: bool = False

    @classmethod
    def parse(cls, text: str) -> Config:
        def keyed(value: dict | None) -> dict:
            return {re.sub(r"[_-]", "", k).lower(): v for k, v in (value or {}).items()}

        def job(value: dict | None) -> Job:
            own = keyed(value)
            return Job(bool(own.get("enabled")), own.get("inputfolder"), own.get("outputfolder"), tuple(own.get("filepatterns") or ()))

        own = keyed(json.loads(text))
        return cls(job(own.get("ocr") or own.get("extract")), job(own.get("redact")), bool(own.get("moveprocessedtodone")))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        """From a file of any store that Spark reads."""
        return cls.parse("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def run(spark: SparkSession, config: Config, catalogue: list[Field]) -> dict:
    """Both jobs of a configuration: {"done", "failed", "exit_code"}; the code is 2 where any document failed, else 0.

    A job that is off, has no folders, or whose input folder does not exist is passed over.
    """
    total = {"done": 0, "failed": 0}
    for job, clean in ((config.extract, False), (config.redact, True)):
        if not (job.enabled and job.input_folder and job.output_folder) or file_system(job.input_folder)[0].get_file_info(file_system(job.input_folder)[1]).type != fs.FileType.Directory:
            continue
        texts = extracted(folder(spark, job.input_folder, list(job.file_patterns)))
        results = redact(texts, catalogue) if clean else texts.withColumn("redacted_text", F.col("text"))
        counted = write_texts(results, job.output_folder)
        if config.move_processed_to_done:
            move_done(outcomes(spark, job.output_folder, counted["batch"]), f"{job.input_folder.rstrip('/')}/{DONE}")
        total = {k: total[k] + counted[k] for k in total}
    return {**total, "exit_code": 2 if total["failed"] else 0}
