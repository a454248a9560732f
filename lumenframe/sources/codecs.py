"""Codecs by format name. All are NumPy; others can be added by ``register``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lumenframe.sources import gif, jpeg, png, simple, tiff, webp
from lumenframe.sources.image import CodecError, Decoded, Settings, eight, narrowed

__all__ = ["CodecError", "Decoded", "Settings", "decode", "encode", "register", "sniff"]


def sniff(data: bytes) -> str | None:
    """Format by first bytes."""
    marks = (
        ("png", png.MARK), ("jpeg", b"\xff\xd8\xff"), ("gif", b"GIF8"), ("bmp", b"BM"), ("ff", b"farbfeld"), ("qoi", b"qoif"), ("ico", b"\0\0\1\0"),
        ("tiff", b"II*\x00"), ("tiff", b"MM\x00*"), ("dds", b"DDS "), ("exr", b"\x76\x2f\x31\x01"), ("hdr", b"#?RADIANCE"), ("jxl", b"\xff\x0a"),
        ("jxl", b"\0\0\0\x0cJXL \r\n\x87\n"), ("jp2", b"\0\0\0\x0cjP  \r\n\x87\n"), ("pcx", b"\n\5\1"), ("sgi", b"\1\xda"),
    )
    for name, mark in marks:
        if data.startswith(mark):
            return name
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[4:12] in (b"ftypavif", b"ftypavis"):
        return "avif"
    if data[:1] == b"P" and data[1:2] in b"123456" and data[1:2]:
        return "pnm"
    # A TGA has no mark at its start; its header must make sense instead.
    tga = len(data) > 18 and data[1] in (0, 1) and data[2] in (1, 2, 3, 9, 10, 11) and data[16] in (8, 24, 32) and data[2] % 8 != 0
    return "tga" if data[-18:-2] == b"TRUEVISION-XFILE" or tga else None


DECODERS: dict[str, Callable[[bytes], Decoded]] = {
    "png": png.decode, "jpeg": jpeg.decode, "gif": gif.decode, "tiff": tiff.decode, "pnm": simple.decode_pnm, "ff": simple.decode_ff,
    "bmp": simple.decode_bmp, "qoi": simple.decode_qoi, "tga": simple.decode_tga, "pcx": simple.decode_pcx, "ico": simple.decode_ico, "webp": webp.decode,
}


def jpeg_quality(quality: float | None) -> int:
    """92 by default; what lies outside 0 to 100 is 100."""
    if quality is None:
        return 92
    whole = int(max(-1, min(101, quality))) if quality == quality else 0
    return whole if 0 <= whole <= 100 else 100


def write_jpeg(px: np.ndarray, bits: int, how: Settings) -> bytes:
    return jpeg.encode(narrowed(px, bits), jpeg_quality(how.quality), how.exif, how.icc)


def write_webp(px: np.ndarray, bits: int, how: Settings) -> bytes:
    """Without loss at quality 100, as asked for; there is no lossy writer here."""
    if how.quality != 100.0:
        raise CodecError("no encoder for lossy WEBP here; quality 100 is lossless")
    return webp.encode(eight(px, bits), px.shape[2] in (2, 4))


ENCODERS: dict[str, Callable[[np.ndarray, int, Settings], bytes]] = {
    "png": lambda px, bits, how: png.encode(px, bits, how.level, how.row_filter, how.exif, how.icc),
    "jpeg": write_jpeg, "gif": lambda px, bits, how: gif.encode(eight(px, bits)), "tiff": lambda px, bits, how: tiff.encode(px, bits, how.icc),
    "pnm": lambda px, bits, how: simple.encode_pnm(px, bits), "ff": lambda px, bits, how: simple.encode_ff(px, bits),
    "bmp": lambda px, bits, how: simple.encode_bmp(px, bits), "qoi": lambda px, bits, how: simple.encode_qoi(px, bits),
    "webp": write_webp, "tga": lambda px, bits, how: simple.encode_tga(px, bits), "pcx": lambda px, bits, how: simple.encode_pcx(px, bits), "ico": lambda px, bits, how: simple.encode_ico(px, bits),
}


def register(name: str, decoder: Callable[[bytes], Decoded] | None = None, encoder: Callable[[np.ndarray, int, Settings], bytes] | None = None) -> None:
    """Adds or replaces a codec, say of an optional library. Workers import this module
    anew, so a codec for them is registered by a module that they import too."""
    if decoder:
        DECODERS[name] = decoder
    if encoder:
        ENCODERS[name] = encoder


def decode(data: bytes, explicit: str | None = None) -> tuple[str, Decoded]:
    name = explicit or sniff(data)
    if name not in DECODERS:
        raise CodecError(f"no decoder for {(name or 'unknown').upper()} here")
    return name, DECODERS[name](data)


def encode(name: str, px: np.ndarray, bits: int, settings: Settings = Settings()) -> bytes:
    if name not in ENCODERS:
        raise CodecError(f"no encoder for {name.upper()} here")
    return ENCODERS[name](px, bits, settings)
