"""Many images to one: the i-th image's luma becomes channel i."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.raster import CHANNELS, converted
from lumenframe.operators.pixels import PIXELS

MODELS = {"srgb": "Rgb8", "displayp3": "Rgb8", "rgb": "L8", "gray": "L8", "lineargray": "L8"}


@F.pandas_udf(PIXELS)
def interleaved(px: pd.Series, widths: pd.Series, heights: pd.Series, w: pd.Series, h: pd.Series, c: pd.Series) -> pd.Series:
    """One image of ``c`` channels; cells outside an input stay 0."""
    out = []
    for planes, across, down, width, height, channels in zip(px, widths, heights, w, h, c, strict=True):
        image = np.zeros((int(height), int(width), int(channels)), np.int32)
        for k, (plane, x, y) in enumerate(zip(planes, across, down, strict=True)):
            own = np.asarray(plane, np.int32).reshape(int(y), int(x))[: int(height), : int(width)]
            image[: own.shape[0], : own.shape[1], k] = own
        out.append(image.ravel())
    return pd.Series(out, dtype=object)


def combine(df: DataFrame, group: str, model: str = "Rgb8", fallback: bool = True) -> DataFrame:
    """One image per ``group``, in order of ``seq``.

    The first image gives size, format and metadata; cells that an input lacks
    stay 0. With ``fallback`` more inputs than channels take a wider model (RGB,
    then RGBA); without it, or beyond four, they are an error. One shuffle, of a
    group's images, which are one output image's data.
    """
    gray = converted(df, F.lit("L8"))
    own = gray.select(group, "seq", F.struct("seq", "image_id", "filename", "orig_color_type", "format", "width", "height", "exif", "icc", "px").alias("i"))
    sets = own.groupBy(group).agg(F.array_sort(F.collect_list("i")).alias("items"))
    n, room = F.size("items"), CHANNELS[model]
    error = F.raise_error(F.lit("more images than channels")).cast("int")
    if fallback:
        channels = F.when(n <= room, room).when(n <= 3, 3).when(n <= 4, 4).otherwise(error)
    else:
        channels = F.when(n <= room, room).otherwise(error)
    sets = sets.withColumns({"__c": channels, "f": F.element_at("items", 1)})
    kind = F.when(F.col("__c") == 1, "L8").when(F.col("__c") == 3, "Rgb8").otherwise("Rgba8")
    return sets.select(
        group, F.col("f.image_id").alias("image_id"), F.col("f.seq").alias("seq"), F.col("f.filename").alias("filename"),
        F.col("f.orig_color_type").alias("orig_color_type"), F.col("f.format").alias("format"), F.col("f.width").alias("width"),
        F.col("f.height").alias("height"), kind.alias("color_type"), F.col("f.exif").alias("exif"), F.col("f.icc").alias("icc"),
        interleaved(*(F.col(f"items.{n}") for n in ("px", "width", "height")), F.col("f.width"), F.col("f.height"), "__c").alias("px"),
    )
