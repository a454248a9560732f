"""Image files as rows: reading through Spark, encoding to a bytes column."""

from __future__ import annotations

import os
import re
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.output import png_settings
from lumenframe.operators import pixels
from lumenframe.sources import codecs

DECODED = "orig_color_type string, format string, width long, height long, color_type string, exif binary, icc binary, px array<int>"
STDIN = "-"


def literal_path(path: str) -> str:
    """A path for Spark's readers in which no character is a wildcard."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def absolute(path: str) -> str:
    return path if re.match(r"[a-zA-Z][\w+.-]+:/", path) else os.path.abspath(path)


def read_images(spark: SparkSession, paths: list[str], explicit: str | None = None, first: int = 0) -> DataFrame:
    """The canonical schema from files, in one scan; ``seq`` counts from ``first`` in the
    order of ``paths``, and ``filename`` is the name as given. A name that is given
    twice is two images. ``-`` is standard input, read on the driver."""
    names = [(first + k, p, absolute(p)) for k, p in enumerate(paths) if p != STDIN]
    parts = []
    if names:
        wanted = spark.createDataFrame(names, "seq long, filename string, key string")
        files = spark.read.format("binaryFile").load([literal_path(p) for p in dict.fromkeys(key for *_, key in names)])
        key = F.regexp_replace("path", "^file:/+", "/")
        parts.append(files.select(key.alias("key"), "content").join(F.broadcast(wanted), "key").select("seq", "filename", "content"))
    data = None
    for k, p in enumerate(paths):
        if p == STDIN:
            data = sys.stdin.buffer.read() if data is None else b""
            parts.append(spark.createDataFrame([(first + k, STDIN, data)], "seq long, filename string, content binary"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return decoded(every, explicit)


def decoded(files: DataFrame, explicit: str | None = None) -> DataFrame:
    """The canonical schema of ``seq, filename, content``."""

    @F.pandas_udf(DECODED)
    def image(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            name, d = codecs.decode(data, explicit)
            h, w, _ = d.pixels.shape
            rows.append((d.orig, name, w, h, d.color_type, d.exif, d.icc, d.pixels.ravel().astype(np.int32)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in DECODED.split(", ")])

    rows = files.select("seq", "filename", image("content").alias("d"))
    return rows.select(F.xxhash64("filename", "seq").alias("image_id"), "seq", "filename", "d.*")


def blank(spark: SparkSession, first: int = 0) -> DataFrame:
    """The ``null:`` source: one black cell without a format."""
    return spark.range(1).select(
        F.lit(0).cast("long").alias("image_id"), F.lit(first).cast("long").alias("seq"), F.lit("null:").alias("filename"), F.lit("Rgb8").alias("orig_color_type"),
        F.lit(None).cast("string").alias("format"), F.lit(1).cast("long").alias("width"), F.lit(1).cast("long").alias("height"), F.lit("Rgb8").alias("color_type"),
        F.lit(None).cast("binary").alias("exif"), F.lit(None).cast("binary").alias("icc"), F.array(*[F.lit(0)] * 3).alias("px"),
    )


def stored_pixels(px: np.ndarray, bits: int, target: str) -> tuple[np.ndarray, int]:
    """PNG is narrowed with its precision, WebP gets three or four 8-bit channels, TIFF and
    GIF are given the pixels as they are, and all others losslessly narrowed ones."""
    if target in ("tiff", "gif"):
        return px, bits
    if target == "webp":
        kind = "Rgba8" if pixels.has_alpha(px) and (px.shape[2] == 4 and bits == 8 or not pixels.opaque(px, bits)) else "Rgb8"
        return pixels.converted(px, bits, kind), 8
    return pixels.narrowed(px, bits, target == "png")


def encoded(df: DataFrame, target: str | Column, quality: float | None = None, strip_exif: bool = False, strip_icc: bool = False) -> DataFrame:
    """Adds ``content``, the file's bytes, in the format ``target`` (of each row)."""
    kind = F.lit(target) if isinstance(target, str) else target
    if quality is not None and quality < 0:
        kind = F.when(kind == "png", F.raise_error(F.lit("PNG quality cannot be negative")).cast("string")).otherwise(kind)
    png = png_settings(F.lit(None if quality is None else max(0.0, float(quality))).cast("double"))

    @F.pandas_udf("binary")
    def written(px: pd.Series, w: pd.Series, h: pd.Series, kind: pd.Series, exif: pd.Series, icc: pd.Series, target: pd.Series, level: pd.Series, row_filter: pd.Series) -> pd.Series:
        out = []
        for values, x, y, k, e, i, t, n, f in zip(px, w, h, kind, exif, icc, target, level, row_filter, strict=True):
            cells, bits = stored_pixels(pixels.image(values, x, y, k), pixels.bits_of(k), t)
            out.append(codecs.encode(t, cells.astype(np.int64), bits, codecs.Settings(1 if n == "fast" else int(n), f, quality, e, i)))
        return pd.Series(out, dtype=object)

    kept = lambda c, gone: F.lit(None).cast("binary") if gone else F.col(c)
    return df.withColumn("content", written(*pixels.OF_IMAGE, kept("exif", strip_exif), kept("icc", strip_icc), kind, png["level"], png["row_filter"]))
