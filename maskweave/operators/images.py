"""Pictures in binary columns: boxes painted over, darkness measured, colours inverted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import raster

#: Pixels that darkness is measured at, at most, evenly spread; a picture is dark if over DARK of them are below HALF.
SAMPLED, HALF, DARK = 2_000, 128, 0.55


@F.pandas_udf(T.BinaryType())
def _paint(contents: pd.Series, boxes: pd.Series) -> pd.Series:
    def one(content: bytes | None, own) -> bytes | None:
        if content is None:
            return None
        found = [(b["left"], b["top"], b["right"], b["bottom"]) for b in (own if own is not None else ())]
        return raster.encode(raster.painted(raster.decode(content), found))

    return pd.Series([one(c, b) for c, b in zip(contents, boxes)], dtype=object)


def painted(images: DataFrame, boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """images(key, content, ...) with the boxes(key, left, top, right, bottom) of each painted black, as PNG.

    A picture without boxes is encoded anew as it is; a null one stays null. Keys name pictures; null keys have no boxes.
    """
    own = boxes.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct(*(F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")))).alias("_boxes"))
    joined = images.join(own, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("content", _paint("content", "_boxes")).drop("_key", "_boxes")


@F.pandas_udf(T.DoubleType())
def _dark_share(contents: pd.Series) -> pd.Series:
    def one(content: bytes) -> float:
        light = raster.luminance(raster.decode(content)).ravel()
        return float((light[:: max(1, len(light) // SAMPLED)] < HALF).mean()) if len(light) else 0.0

    return contents.map(one, na_action="ignore").astype("float64")


def is_dark(content: Column) -> Column:
    """Whether a picture has light letters on dark ground; null for none."""
    return _dark_share(content) > DARK


@F.pandas_udf(T.BinaryType())
def inverted(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: raster.encode(255 - raster.decode(c)), na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("width", "height", "total")]))
def measured(contents: pd.Series) -> pd.DataFrame:
    """Width, height, and the sum of all samples; nulls for a null picture."""
    rows = [(p.shape[1], p.shape[0], int(p.sum(dtype=np.int64))) if c is not None and (p := raster.decode(c)) is not None else (None, None, None) for c in contents]
    return pd.DataFrame(rows, columns=["width", "height", "total"], dtype="object")


@F.pandas_udf(T.BinaryType())
def from_pixels(pixels: pd.Series, width: pd.Series) -> pd.Series:
    """A grey picture of rows of ``width`` pixels (0 to 255) each; pixels that fill no row are left out."""

    def one(own, n: int) -> bytes | None:
        if own is None or not n:
            return None
        rows = np.array(own, np.int64)[: len(own) // n * n].reshape(-1, n)
        return raster.encode(np.repeat(rows[..., None], 3, axis=2).astype(np.uint8))

    return pd.Series([one(p, int(n)) for p, n in zip(pixels, width)], dtype=object)
