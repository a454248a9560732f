"""Images as rows, and operators on them; none shuffles. Sizes, types and metadata are
plain expressions, so what doesn't need pixels doesn't read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.geometry import Crop, ResizeTarget
from lumenframe.operators import pixels
from lumenframe.operators.pixels import CHANNELS

COLUMNS = ["image_id", "seq", "filename", "orig_color_type", "format", "width", "height", "color_type", "exif", "icc", "px"]


def from_embeddings(embeddings: DataFrame, side: int = 8) -> DataFrame:
    """8x8 grey images from the embeddings table, in the canonical schema."""
    level = lambda e: F.least(F.greatest(F.floor((e.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    return embeddings.select(
        F.col("vec_id").alias("image_id"), F.col("vec_id").alias("seq"), F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("filename"),
        F.lit("L8").alias("orig_color_type"), F.lit("png").alias("format"), F.lit(side).cast("long").alias("width"), F.lit(side).cast("long").alias("height"),
        F.lit("L8").alias("color_type"), F.lit(None).cast("binary").alias("exif"), F.lit(None).cast("binary").alias("icc"),
        F.transform("embedding", level).alias("px"),
    )


def replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """New values for several columns, all computed from the old ones. Under their own
    names, columns inside a lambda could resolve to a neighbour's new value."""
    held = {f"__new_{k}": v for k, v in new.items()}
    return df.withColumns(held).withColumns({k: F.col(f"__new_{k}") for k in new}).drop(*held)


def flip(df: DataFrame) -> DataFrame:
    return df.withColumn("px", pixels.changed(lambda px, bits: px[::-1]))


def flop(df: DataFrame) -> DataFrame:
    return df.withColumn("px", pixels.changed(lambda px, bits: px[:, ::-1]))


def crop(df: DataFrame, area: Crop) -> DataFrame:
    """A rectangle of the image; one that leaves the image is an error."""
    w = F.col("width") if area.width is None else F.lit(area.width).cast("long")
    h = F.col("height") if area.height is None else F.lit(area.height).cast("long")
    outside = (F.lit(area.x) + w > F.col("width")) | (F.lit(area.y) + h > F.col("height"))
    safe = F.when(outside, F.raise_error(F.lit("crop leaves the image")).cast("long")).otherwise(w)
    px = pixels.changed(lambda px, bits, width, height: pixels.cropped(px, bits, area.x, area.y, width, height), w, h)
    return replaced(df, {"px": px, "width": safe, "height": h})


def sample(df: DataFrame, target: ResizeTarget) -> DataFrame:
    """Nearest neighbour: the source cell under the middle of each new cell."""
    w, h = target.size(F.col("width"), F.col("height"))
    return replaced(df, {"px": pixels.changed(pixels.sampled, w, h), "width": w, "height": h})


def exif_orientation(exif: Column) -> Column:
    """Orientation 1 to 8 of an EXIF block; 1 where it has none that is valid."""
    return pixels.read_exif(exif)["orientation"]


def orient(df: DataFrame, orientation: Column) -> DataFrame:
    """Applies an orientation of 1 to 8; 5 to 8 swap the sides."""
    turned, w, h = orientation >= 5, F.col("width"), F.col("height")
    return replaced(df, {"px": pixels.changed(pixels.oriented, orientation), "width": F.when(turned, h).otherwise(w), "height": F.when(turned, w).otherwise(h)})


def auto_orient(df: DataFrame) -> DataFrame:
    """Applies the EXIF orientation and sets it to 1 in the block, which else stays as it is."""
    held = df.withColumn("__e", pixels.read_exif("exif"))
    return orient(held, F.col("__e.orientation")).withColumn("exif", F.col("__e.exif")).drop("__e")


def negate(df: DataFrame) -> DataFrame:
    """Inverts all channels but alpha."""
    return df.withColumn("px", pixels.changed(pixels.inverted))


def grayscale(df: DataFrame) -> DataFrame:
    """Rec. 709 luma; alpha stays."""
    kind = F.regexp_replace(F.regexp_replace("color_type", "^Rgba", "La"), "^Rgb", "L")
    return replaced(df, {"px": pixels.changed(pixels.grayed), "color_type": kind})


def flags() -> Column:
    """Struct ``opaque, gray, eight, steady`` of an image."""
    return pixels.flags(*pixels.OF_IMAGE)


def is_opaque() -> Column:
    return flags()["opaque"]


def constant_alpha() -> Column:
    return flags()["steady"]


def is_gray() -> Column:
    """Whether red, green and blue are equal everywhere."""
    return flags()["gray"]


def is_8bit() -> Column:
    """Whether 16-bit samples repeat their high byte."""
    return flags()["eight"]


def narrow(df: DataFrame, precision: bool = False) -> DataFrame:
    """Drops what a lossless writer needn't store: opaque alpha, equal colours and,
    with ``precision``, the low byte of samples that repeat the high one."""
    held = df.withColumn("__n", pixels.narrow_udf(precision)(*pixels.OF_IMAGE))
    return held.withColumns({"px": F.col("__n.px"), "color_type": F.col("__n.color_type")}).drop("__n")


def converted(df: DataFrame, kind: Column) -> DataFrame:
    """The images as ``kind`` (see ``pixels.converted``)."""
    return replaced(df, {"px": pixels.changed(pixels.converted, kind), "color_type": kind})


def rgb8_maybe_alpha(df: DataFrame) -> DataFrame:
    """Rgba8 where some cell is transparent, else Rgb8; images of either kind stay as they are."""
    kind = F.col("color_type")
    own = F.when(kind.isin("Rgb8", "Rgba8"), kind).when(~is_opaque(), F.lit("Rgba8")).otherwise(F.lit("Rgb8"))
    held = df.withColumn("__kind", own)
    return converted(held, F.col("__kind")).drop("__kind")


def default_filter(w: Column, h: Column, new_w: Column, new_h: Column, alpha_is_constant: Column) -> Column:
    larger = (w < new_w) | (h < new_h)
    return F.when(larger | ~alpha_is_constant, "MitchellNetravalli").otherwise("Lanczos3")
