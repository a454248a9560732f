"""Whole images in NumPy: what single operators do, and their one Arrow pass.

Array lambdas of the JVM are interpreted element by element (about a microsecond
each); these functions move an image through Arrow once and work on all its cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Channels by colour type.
CHANNELS = {"L8": 1, "La8": 2, "Rgb8": 3, "Rgba8": 4, "L16": 1, "La16": 2, "Rgb16": 3, "Rgba16": 4}
PIXELS = T.ArrayType(T.IntegerType())
OF_IMAGE = ("px", "width", "height", "color_type")


def image(values, width, height, kind: str) -> np.ndarray:
    return np.asarray(values, np.int32).reshape(int(height), int(width), CHANNELS[kind])


def bits_of(kind: str) -> int:
    return 16 if kind.endswith("16") else 8


def kind_of(px: np.ndarray, bits: int) -> str:
    return f"{ {1: 'L', 2: 'La', 3: 'Rgb', 4: 'Rgba'}[px.shape[2]] }{bits}"


def changed(f: Callable[..., np.ndarray], *more: Column | str) -> Column:
    """New pixels: ``f`` of an image, its depth in bits and the columns ``more``."""

    @F.pandas_udf(PIXELS)
    def run(*columns: pd.Series) -> pd.Series:
        made = [None if px is None else f(image(px, w, h, k), bits_of(k), *x).ravel().astype(np.int32, copy=False) for px, w, h, k, *x in zip(*columns, strict=True)]
        return pd.Series(made, dtype=object)

    return run(*OF_IMAGE, *more)


# --- places ---------------------------------------------------------------


def cropped(px: np.ndarray, bits: int, x: int, y: int, width, height) -> np.ndarray:
    h, w, _ = px.shape
    if x + width > w or y + height > h:
        raise ValueError("crop leaves the image")
    return px[int(y) : int(y + height), int(x) : int(x + width)]


def sampled(px: np.ndarray, bits: int, width, height) -> np.ndarray:
    """The cell under the middle of each new cell."""
    h, w, _ = px.shape
    near = lambda n, old: (2 * np.arange(int(n)) + 1) * old // (2 * int(n))
    return px[near(height, h)][:, near(width, w)]


def oriented(px: np.ndarray, bits: int, orientation) -> np.ndarray:
    """Orientations 5 to 8 swap the sides; the others are mirrored one way, both or none."""
    o = int(orientation)
    px = px.transpose(1, 0, 2) if o >= 5 else px
    px = px[::-1] if o in (3, 4, 7, 8) else px
    return px[:, ::-1] if o in (2, 3, 6, 7) else px


# --- values ---------------------------------------------------------------


def has_alpha(px: np.ndarray) -> bool:
    return px.shape[2] in (2, 4)


def inverted(px: np.ndarray, bits: int) -> np.ndarray:
    out = ((1 << bits) - 1) - px
    if has_alpha(px):
        out[..., -1] = px[..., -1]
    return out


def luma(px: np.ndarray) -> np.ndarray:
    """BT.709 weights in integers."""
    r, g, b = (px[..., k].astype(np.int64) for k in range(3))
    return ((r * 2126 + g * 7152 + b * 722) // 10000).astype(np.int32)


def grayed(px: np.ndarray, bits: int = 8) -> np.ndarray:
    if px.shape[2] < 3:
        return px
    return np.concatenate([luma(px)[..., None], px[..., 3:]], axis=2)


def converted(px: np.ndarray, bits: int, kind: str) -> np.ndarray:
    """An image as another colour type: grey to colour by repeating, colour to grey by
    luma, missing alpha opaque, 8 to 16 bits by v * 257 and back to the nearest."""
    c, top = CHANNELS[kind], (1 << bits) - 1
    if c == px.shape[2] and bits == bits_of(kind):
        return px
    base = px[..., : px.shape[2] - has_alpha(px)]
    base = grayed(base) if c < 3 else np.repeat(base, 3, axis=2) if base.shape[2] == 1 else base
    if c in (2, 4):
        alpha = px[..., -1:] if has_alpha(px) else np.full((*px.shape[:2], 1), top, np.int32)
        base = np.concatenate([base, alpha], axis=2)
    to = bits_of(kind)
    return base if to == bits else base * 257 if to == 16 else (base + 128) // 257


def opaque(px: np.ndarray, bits: int) -> bool:
    return not has_alpha(px) or bool((px[..., -1] == (1 << bits) - 1).all())


def steady(px: np.ndarray) -> bool:
    """Whether alpha is the same everywhere."""
    return not has_alpha(px) or not px.size or bool((px[..., -1] == px[0, 0, -1]).all())


def gray(px: np.ndarray) -> bool:
    return px.shape[2] < 3 or bool(((px[..., 0] == px[..., 1]) & (px[..., 0] == px[..., 2])).all())


def fits_8_bits(px: np.ndarray, bits: int) -> bool:
    return bits == 16 and bool((px % 257 == 0).all())


def narrowed(px: np.ndarray, bits: int, precision: bool) -> tuple[np.ndarray, int]:
    """The image without what a lossless writer needn't store, and its depth."""
    is_gray, is_opaque, shallow = gray(px), opaque(px, bits), precision and fits_8_bits(px, bits)
    if has_alpha(px) and is_opaque:
        px = px[..., :-1]
    if is_gray and px.shape[2] >= 3:
        px = np.concatenate([px[..., :1], px[..., 3:]], axis=2)
    return (px // 257, 8) if shallow else (px, bits)


FLAGS = T.StructType([T.StructField(n, T.BooleanType()) for n in ("opaque", "gray", "eight", "steady")])
NARROWED = T.StructType([T.StructField("px", PIXELS), T.StructField("color_type", T.StringType())])


@F.pandas_udf(FLAGS)
def flags(px: pd.Series, w: pd.Series, h: pd.Series, kind: pd.Series) -> pd.DataFrame:
    every = ((image(v, x, y, k), bits_of(k)) for v, x, y, k in zip(px, w, h, kind, strict=True))
    return pd.DataFrame([(opaque(p, b), gray(p), fits_8_bits(p, b), steady(p)) for p, b in every], columns=FLAGS.names)


def narrow_udf(precision: bool) -> Callable[..., Column]:
    @F.pandas_udf(NARROWED)
    def run(px: pd.Series, w: pd.Series, h: pd.Series, kind: pd.Series) -> pd.DataFrame:
        made = [narrowed(image(v, x, y, k), bits_of(k), precision) for v, x, y, k in zip(px, w, h, kind, strict=True)]
        return pd.DataFrame([(p.ravel().astype(np.int32), kind_of(p, b)) for p, b in made], columns=NARROWED.names)

    return run


# --- EXIF -----------------------------------------------------------------


def orientation_place(exif: bytes) -> tuple[int, str] | None:
    """Where the value of tag 0x0112 stands in an EXIF block, and the block's byte order.
    The first directory is read entry by entry; only one short number counts."""
    order = {b"MM\x00\x2a": "big", b"II\x2a\x00": "little"}.get(bytes(exif[:4]))
    if order is None:
        return None
    number = lambda at, size: int.from_bytes(exif[at : at + size], order)
    first = number(4, 4)
    for at in range(first + 2, min(first + 2 + 12 * number(first, 2), len(exif) - 11), 12):
        if (number(at, 2), number(at + 2, 2), number(at + 4, 4)) == (0x0112, 3, 1):
            return at + 8, order
    return None


def upright(exif: bytes | None) -> tuple[int, bytes | None]:
    """Orientation 1 to 8 of a block (1 where it has none that is valid), and the block
    with orientation 1, all its other tags as they are."""
    found = None if exif is None else orientation_place(exif)
    if found is None:
        return 1, exif
    at, order = found
    value = int.from_bytes(exif[at : at + 2], order)
    return (value, exif[:at] + (1).to_bytes(2, order) + exif[at + 2 :]) if 1 <= value <= 8 else (1, exif)


ORIENTED = T.StructType([T.StructField("orientation", T.IntegerType()), T.StructField("exif", T.BinaryType())])


@F.pandas_udf(ORIENTED)
def read_exif(exif: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([upright(None if e is None else bytes(e)) for e in exif], columns=ORIENTED.names)
