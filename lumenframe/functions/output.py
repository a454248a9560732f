"""Names, formats and quality settings of outputs, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lumenframe.functions.identify import looked_up

#: Formats by extension or prefix.
FORMATS = {"png": "png", "jpg": "jpeg", "jpeg": "jpeg", "webp": "webp", "avif": "avif", "gif": "gif", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "pbm": "pnm", "pgm": "pnm", "ppm": "pnm", "pnm": "pnm", "pam": "pnm", "qoi": "qoi", "ff": "ff", "tga": "tga", "hdr": "hdr", "exr": "exr", "ico": "ico", "dds": "dds", "jxl": "jxl", "jp2": "jp2"}
#: Filter names that stand for another kernel.
FILTER_ALIASES = {"Catrom": "CatmullRom", "Cosine": "Hann", "Jinc": "Lanczos3Jinc", "Lagrange": "Lagrange2", "Lanczos": "Lanczos3", "Lanczos2Sharp": "Lanczos2", "LanczosRadius": "Lanczos3", "LanczosSharp": "Lanczos3", "Mitchell": "MitchellNetravalli", "Parzen": "BSpline", "Point": "Nearest", "Quadratic": "Quadric", "Sinc": "Lanczos3", "SincFast": "Lanczos3", "Spline": "BSpline", "Triangle": "Bilinear"}
#: All filter names.
FILTERS = [*FILTER_ALIASES, "Bartlett", "Blackman", "Bohman", "Box", "Cubic", "Gaussian", "Hamming", "Hann", "Hermite", "Kaiser", "Lanczos2", "Robidoux", "RobidouxSharp", "Welch"]
#: PNG row filters by the last digit of the quality.
PNG_FILTERS = {0: "none", 1: "sub", 2: "up", 3: "avg", 4: "paeth", 5: "adaptive", 6: "adaptive", 7: "adaptive", 8: "adaptive", 9: "up"}


def kernel_name(name: str) -> str:
    """The kernel behind a filter name, in any case."""
    known = {f.lower(): f for f in FILTERS}
    if name.lower() not in known:
        raise ValueError(f"unknown filter: {name}")
    return FILTER_ALIASES.get(known[name.lower()], known[name.lower()])


def kernel_column(name: Column) -> Column:
    return looked_up({f.lower(): kernel_name(f) for f in FILTERS}, F.lower(name), "unknown")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def chosen_format(prefix: Column, path: Column, input_format: Column) -> Column:
    """Explicit prefix, else the path's extension, else the input's format."""
    known = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    missing = F.raise_error(F.concat(F.lit("no encoder for "), F.upper(extension(path)))).cast("string")
    return F.coalesce(F.lower(prefix), known[extension(path)], input_format, missing)


def suffixed(path: Column, number: Column) -> Column:
    """``-number`` before the last extension, or at the end if there is none. A name
    that starts with its only dot has no extension."""
    parts = r"^((?:.*/)?[^/]+)(\.[^./]*)$"
    mark = F.concat(F.lit("-"), number.cast("string"))
    return F.when(path.rlike(parts), F.concat(F.regexp_extract(path, parts, 1), mark, F.regexp_extract(path, parts, 2))).otherwise(F.concat(path, mark))


def output_name(path: Column, group: list[str]) -> Column:
    """Names of a sequence's outputs: numbered from 1 if there are several.

    For narrow rows; images themselves are numbered by their ``seq`` (``numbered``)."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("seq"))
    many = F.count("*").over(Window.partitionBy(*group)) > 1
    return F.when(many & (path != "-"), suffixed(path, rank)).otherwise(path)


def numbered(path: Column, seq: Column, many: bool) -> Column:
    """The same where ``seq`` counts a sequence's images from 0: no row needs another."""
    return F.when(path != "-", suffixed(path, seq + 1)).otherwise(path) if many else path


def png_settings(quality: Column) -> dict[str, Column]:
    """Compression level ('fast' or a digit) and row filter by quality."""
    q = F.when(quality < 0, F.raise_error(F.lit("PNG quality cannot be negative")).cast("long")).otherwise(F.floor(quality))
    units, tens = q % 10, F.least(F.floor(q / 10), F.lit(9))
    level = F.when(quality.isNull(), "7").when(units >= 8, "fast").otherwise(tens.cast("string"))
    return {"level": level, "row_filter": F.when(quality.isNull(), "adaptive").otherwise(looked_up({str(k): v for k, v in PNG_FILTERS.items()}, units.cast("string")))}


def jpeg_quality(quality: Column) -> Column:
    """92 by default; values outside 0..100 are 100."""
    whole = F.when(quality >= 0, F.floor(quality)).otherwise(F.ceil(quality)).cast("long")
    return F.when(quality.isNull(), 92).when((whole >= 0) & (whole <= 100), whole).otherwise(100).cast("long")


def webp_settings(quality: Column) -> dict[str, Column]:
    return {"webp_quality": F.coalesce(quality, F.lit(75.0)), "lossless": F.coalesce(quality == 100.0, F.lit(False))}


def avif_quality(quality: Column) -> Column:
    return F.when(quality.isNull(), 50).otherwise(F.least(F.greatest(F.floor(quality), F.lit(0)), F.lit(255))).cast("long")
