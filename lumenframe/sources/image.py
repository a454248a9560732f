"""What all codecs share."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class CodecError(ValueError):
    """Bytes that aren't a readable image, or a format without a codec here."""


@dataclass
class Decoded:
    pixels: np.ndarray  # height, width, channels
    bits: int
    orig: str
    exif: bytes | None = None
    icc: bytes | None = None
    extra: dict = field(default_factory=dict)

    @property
    def color_type(self) -> str:
        return f"{ {1: 'L', 2: 'La', 3: 'Rgb', 4: 'Rgba'}[self.pixels.shape[2]] }{16 if self.bits == 16 else 8}"


@dataclass(frozen=True)
class Settings:
    """How to write: PNG's level and row filter, the quality as asked for, metadata."""

    level: int = 7
    row_filter: str = "adaptive"
    quality: float | None = None
    exif: bytes | None = None
    icc: bytes | None = None


def narrowed(px: np.ndarray, bits: int) -> np.ndarray:
    """8-bit samples."""
    return px if bits == 8 else (px + 128) // 257


def widened(px: np.ndarray, bits: int) -> np.ndarray:
    """RGBA in 16 bits."""
    px = px if bits == 16 else px * 257
    c = px.shape[2]
    rgb = px[..., :3] if c >= 3 else np.repeat(px[..., :1], 3, axis=2)
    alpha = px[..., -1:] if c in (2, 4) else np.full((*px.shape[:2], 1), 65535)
    return np.concatenate([rgb, alpha], axis=2)


def eight(px: np.ndarray, bits: int) -> np.ndarray:
    """RGBA in 8 bits."""
    return narrowed(widened(px, bits), 16)
