"""Redaction of streams: a stateless map over rows, so a batch's plan is a stream's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import Field
from ..plans.redact import redact


def redact_stream(docs: DataFrame, catalogue: list[Field], text: str = "text", dictionaries: dict[str, DataFrame] | None = None) -> DataFrame:
    """A stream of documents redacted by one catalogue, with all its fields and term lists of any size."""
    return redact(docs, catalogue, text, dictionaries=dictionaries)


def read_folder(spark: SparkSession, path: str, schema: str, archive: str | None = None, kind: str = "parquet") -> DataFrame:
    """New files of a folder as a stream; with ``archive``, files move there once they are done."""
    reader = spark.readStream.format(kind).schema(schema)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(path)


def redact_batches(docs: DataFrame, catalogue: Callable[[], list[Field]], sink: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text", dictionaries: dict[str, DataFrame] | None = None) -> StreamingQuery:
    """Redact what has arrived and stop; each micro-batch asks for the catalogue anew, and may use every pattern type."""

    def run(batch: DataFrame, number: int) -> None:
        sink(redact(batch, catalogue(), text, dictionaries), number)

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
