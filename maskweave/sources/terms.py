"""Term files, in UTF-8 or windows-1255: lines of terms, of two columns, or of terms between bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_term


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(term): the distinct cleaned terms of lines, whatever their case, by their upper case.

    A line with two blanks or more between two texts has columns, else one with bars has terms between them, else it is
    one term. Blank lines, lines that begin with # and terms of one character are left out.
    """
    line = F.trim(F.regexp_replace(column, "\\r$", ""))
    rows = lines.select(line.alias("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    parts = F.when(F.col("line").rlike("\\S\\s{2,}\\S"), F.split("line", "\\s{2,}")).when(F.col("line").contains("|"), F.split("line", "\\|")).otherwise(F.array("line"))
    terms = rows.select(F.explode(parts).alias("term")).select(clean_term(F.col("term")).alias("term")).filter(F.length("term") > 1)
    return terms.groupBy(F.lower("term").alias("k")).agg(F.min("term").alias("term")).orderBy(F.upper("term"), "term").select("term")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 where they are, else windows-1255 (Hebrew), bytes that it lacks replaced."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        def one(b: bytes) -> str:
            try:
                return b.decode("utf-8-sig")
            except UnicodeDecodeError:
                return b.decode("cp1255", "replace")

        return values.map(one, na_action="ignore")

    return decode(content)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The terms of files, each in UTF-8 or else windows-1255. A file is one row at first: these are lists for a catalogue."""
    files = spark.read.format("binaryFile").load(path).select(decoded(F.col("content")).alias("text"))
    return parse(files.select(F.explode(F.split("text", "\n")).alias("value")))


def serialised(terms: DataFrame) -> DataFrame:
    """One row: the terms that aren't blank, by \\n, in the order of their upper case. For lists that fit in a catalogue."""
    return terms.filter("trim(term) != ''").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.upper("term").alias("k"), "term"))), lambda s: s["term"]), "\n").alias("pattern"))


def search(terms: DataFrame, query: str, most: int = 1000) -> DataFrame:
    """The first terms that contain the query, whatever its case."""
    return terms.filter(F.lower("term").contains(query.lower())).orderBy(F.upper("term"), "term").limit(most)
