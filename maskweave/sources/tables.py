"""Parquet tables of texts, dealt out so that all cores work on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of fewer bytes may be a single row group, which is a single task's however many splits its file has.
ROW_GROUP_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if what it scans is small; a table of several row groups is left as it is, without a shuffle."""
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= ROW_GROUP_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def text_table(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path))
