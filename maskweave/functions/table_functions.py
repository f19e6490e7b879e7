"""``find_spans`` for SQL: a table function of a text's hits, for LATERAL joins.

    register(spark)
    SELECT d.doc_id, s.* FROM documents d, LATERAL find_spans(d.text, 'WholeWord', 'the') s

A type and its pattern are checked when the query is analysed. Rows are start, length and value, from left to right.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.patterns import COMPILERS, Search, type_name

SPANS = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("value", T.StringType())])


@lru_cache(maxsize=256)
def searcher(kind: str, pattern: str) -> Search:
    """The search that a worker does itself; types that only columns know are refused."""
    compiler = COMPILERS.get(type_name(kind))  # FileList has none: its terms are a table
    search = getattr(compiler(pattern), "search", None) if compiler else None
    if search is None:
        raise ValueError(f"{kind} cannot be used as a table function")
    return search


class FindSpans:
    """Spans of one pattern in a text; null texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("find_spans searches strings")
        for name, given in (("type", kind), ("pattern", pattern)):
            if not given.isConstantExpression or given.value is None:
                raise ValueError(f"the {name} of find_spans is a constant")
        searcher(kind.value, pattern.value)
        return AnalyzeResult(SPANS)

    def eval(self, text: str | None, kind: str, pattern: str) -> Iterator[tuple[int, int, str]]:
        if text is not None:
            for start, length in searcher(kind, pattern)(text):
                yield start, length, text[start : start + length]


def register(spark: SparkSession, name: str = "find_spans") -> None:
    spark.udtf.register(name, F.udtf(FindSpans, useArrow=True))
