"""Black and white: two-means remapping, then jittered error diffusion, in NumPy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.raster import replaced
from lumenframe.operators import pixels

ROUNDS = 20
JITTER = 100.0
BINS = np.arange(256)


def percentile(counts: np.ndarray, share: float) -> float:
    """First bin at which the running count reaches trunc(total * share); 255 if none."""
    return float(min(255, np.searchsorted(counts.cumsum(), int(counts.sum() * share))))


def centroids(counts: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """Two-means on a histogram from the given seeds, at most 20 rounds; a round in
    which both means move less than a half is not taken. An empty image has 0 and 255."""
    n, total = counts.cumsum(), (counts * BINS).cumsum()
    if not n[-1]:
        return 0.0, 255.0
    for _ in range(ROUNDS):
        split = int((low + high) / 2)
        dark, light = n[split], n[-1] - n[split]
        new_low = total[split] / dark if dark else low
        new_high = (total[-1] - total[split]) / light if light else high
        if abs(new_low - low) < 0.5 and abs(new_high - high) < 0.5:
            break
        low, high = new_low, new_high
    return float(low), float(high)


def band(px: np.ndarray) -> tuple[np.ndarray, float, float, float, float]:
    """Histogram, both quartiles, and the means that start from them."""
    counts = np.bincount(px, minlength=256)[:256]
    p25, p75 = percentile(counts, 0.25), percentile(counts, 0.75)
    return counts, p25, p75, *centroids(counts, p25, p75)


def stretch(px: np.ndarray) -> np.ndarray:
    """Stretches the band of the means to [0, 255]; bands under one level stay as they are."""
    *_, low, high = band(px)
    if high - low < 1.0:
        return px
    levels = np.floor(np.clip((BINS - low) / (high - low) * 255.0, 0.0, 255.0)).astype(np.int32)
    return levels[px]


def diffuse(luma: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Raster-order diffusion: a half to the right, quarters below-left and below.

    Cells of equal x + 2y need nothing of one another, so they go together. The
    threshold's jitter rolls off with the luma before any error was added."""
    h, w = luma.shape
    f = np.float32
    luma, errors, out = luma.astype(f), np.zeros((h + 1, w + 2), f), np.zeros((h, w), np.int32)
    noise = np.tile(tile, (-(-h // len(tile)), -(-w // len(tile))))[:h, :w].astype(f) / f(255) - f(0.5)
    threshold = f(127.5) + noise * f(JITTER) * (f(1) - np.clip(np.abs(luma - f(127.5)) / f(127.5), f(0), f(1)))
    for t in range(w + 2 * (h - 1)):
        y = np.arange(max(0, (t - w + 2) // 2), min(h - 1, t // 2) + 1)
        x = t - 2 * y
        now = luma[y, x] + errors[y, x + 1]
        white = now > threshold[y, x]
        out[y, x] = np.where(white, 255, 0)
        rest = now - np.where(white, f(255), f(0))
        errors[y + 1, x] += rest * f(0.25)
        errors[y + 1, x + 1] += rest * f(0.25)
        errors[y, x + 2] += rest * f(0.5)
    return out


@lru_cache(maxsize=2)
def noise_tile(side: int = 256, sigma: float = 1.9, seed: int = 1993) -> np.ndarray:
    """Blue noise of 0 to 255 by the void-and-cluster method (Ulichney 1993).

    Cells are ranked by taking points out of the tightest cluster of a settled random
    tenth, then by filling the largest void, from half on by the tightest cluster of
    what is empty. ``field`` is the sum of a Gaussian around each point, on a torus."""
    n, reach = side * side, min(side // 2, 9)
    bell = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    kernel = np.outer(bell, bell)

    def add(field: np.ndarray, place: int, sign: float) -> None:
        y, x = divmod(place, side)
        field[np.ix_(np.arange(y - reach, y + reach + 1) % side, np.arange(x - reach, x + reach + 1) % side)] += sign * kernel

    def built(points: np.ndarray) -> np.ndarray:
        field = np.zeros((side, side))
        for p in np.flatnonzero(points):
            add(field, int(p), 1.0)
        return field

    far = 1e6
    points = np.zeros(n, bool)
    points[np.random.default_rng(seed).permutation(n)[: n // 10]] = True
    field = built(points)

    def tightest() -> int:
        return int(np.argmax(field.ravel() - far * ~points))

    def emptiest() -> int:
        return int(np.argmin(field.ravel() + far * points))

    def move(place: int, on: bool) -> None:
        points[place] = on
        add(field, place, 1.0 if on else -1.0)

    while True:  # settle
        out = tightest()
        move(out, False)
        into = emptiest()
        move(into, True)
        if into == out:
            break
    rank, first, settled = np.zeros(n, np.int64), int(points.sum()), points.copy()
    for k in range(first - 1, -1, -1):
        rank[place := tightest()] = k
        move(place, False)
    points[:] = settled
    field = built(points)
    for k in range(first, n // 2):
        rank[place := emptiest()] = k
        move(place, True)
    points[:] = ~points
    field = built(points)
    for k in range(n // 2, n):
        rank[place := tightest()] = k
        move(place, False)
    return (rank * 256 // n).astype(np.uint8).reshape(side, side)


BAND = T.StructType([T.StructField("hist", pixels.PIXELS), *(T.StructField(n, T.DoubleType()) for n in ("p25", "p75", "low", "high"))])


@F.pandas_udf(BAND)
def bands(px: pd.Series) -> pd.DataFrame:
    rows = [(counts.astype(np.int32), *more) for counts, *more in (band(np.asarray(v, np.int64)) for v in px)]
    return pd.DataFrame(rows, columns=["hist", "p25", "p75", "low", "high"])


@F.pandas_udf(pixels.PIXELS)
def stretched(px: pd.Series) -> pd.Series:
    return pd.Series([stretch(np.asarray(v, np.int32)) for v in px], dtype=object)


def with_band(df: DataFrame) -> DataFrame:
    """Adds ``hist, p25, p75, low, high`` to grey images, in one pass over the pixels."""
    return df.withColumn("__band", bands("px")).select("*", "__band.*").drop("__band")


def remapped(df: DataFrame) -> DataFrame:
    """Stretches [low, high] to [0, 255]; bands under one level stay as they are."""
    return df.withColumn("px", stretched("px"))


def monochrome(df: DataFrame) -> DataFrame:
    """Black and white; alpha goes. Sequential within an image, parallel over images.

    The noise tile is made once, on the driver, and travels with the function (64 kB)."""
    tile = noise_tile()

    def black_and_white(px: np.ndarray, bits: int) -> np.ndarray:
        gray = pixels.converted(px, bits, "L8")[..., 0]
        return diffuse(stretch(gray.ravel()).reshape(gray.shape), tile) if gray.size else gray

    return replaced(df, {"px": pixels.changed(black_and_white), "color_type": F.lit("L8")})
