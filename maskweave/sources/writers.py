"""Sinks: result files, the request log by day, the event log. Text files are batch.write_texts()."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def append_log(entries: DataFrame, path: str, at: str = "requested_at") -> None:
    """Log entries in a folder a day, so that a time's entries are few folders and old ones go as folders."""
    entries.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def drop_days(spark: SparkSession, path: str, before: date) -> list[date]:
    """Delete the folders of days before a date; the others are neither read nor rewritten. Their days."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for entry in system.listStatus(where):
        name = entry.getPath().getName()
        if name.startswith("day=") and name[4:] != "__HIVE_DEFAULT_PARTITION__" and (day := date.fromisoformat(name[4:])) < before:
            system.delete(entry.getPath(), True)
            dropped.append(day)
    return sorted(dropped)


def event(results: DataFrame, debug: bool, most: int = 8192) -> DataFrame:
    """Event rows of results; only with ``debug`` do they hold texts, cut to ``most`` characters."""
    texts: list[Column] = [(truncate(F.col(c), most) if debug else F.lit(None).cast("string")).alias(c) for c in ("text", "redacted_text")]
    return results.select("doc_id", "match_count", F.array_join("fields_hit", ",").alias("fields"), *texts)
