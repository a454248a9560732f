"""PNG in NumPy, with all row filters and interlacing."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lumenframe.sources.image import CodecError, Decoded

MARK = b"\x89PNG\r\n\x1a\n"
#: PNG colour type to channels.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column, first row, steps of the seven passes of an interlaced image.
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
FILTERS = ["none", "sub", "up", "avg", "paeth"]


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and upper left the one next to a + b - c; ties in that order."""
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def unfiltered(raw: np.ndarray, height: int, stride: int, bpp: int) -> np.ndarray:
    lines = raw[: height * (stride + 1)].reshape(height, stride + 1)
    kinds, lines = lines[:, 0], lines[:, 1:]
    if height and kinds.max() >= len(FILTERS):
        raise CodecError("no such PNG row filter")
    if (kinds >= 3).any():
        return diagonally(lines, kinds, bpp)
    out, above = np.empty((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y, (kind, line) in enumerate(zip(kinds.tolist(), lines, strict=True)):
        if kind == 1:
            for k in range(bpp):
                out[y, k::bpp] = np.cumsum(line[k::bpp], dtype=np.uint8)
        else:
            out[y] = line + above if kind == 2 else line
        above = out[y]
    return out


def diagonally(lines: np.ndarray, kinds: np.ndarray, bpp: int) -> np.ndarray:
    """Cells of equal x + y need only earlier ones, whatever their rows' filters, so they
    go together. On the flat image with a border of zeros they stand at equal steps."""
    h, n = len(lines), lines.shape[1] // bpp
    source = np.pad(lines.reshape(h, n, bpp).astype(np.int16), ((0, 0), (0, 1), (0, 0))).reshape(-1, bpp)
    out = np.zeros(((h + 1) * (n + 1) + 1, bpp), np.int16)
    kinds = kinds.astype(np.int16)[:, None]
    for d in range(n + h - 1):
        low, high = max(0, d - n + 1), min(h - 1, d)
        cells = lambda plus: slice(d + low * n + plus, d + high * n + plus + 1, n)  # noqa: E731, B023
        left, above, corner, kind = out[cells(n + 1)], out[cells(1)], out[cells(0)], kinds[low : high + 1]
        guess = np.where(kind == 4, paeth(left, above, corner), np.where(kind == 3, (left + above) >> 1, np.where(kind == 2, above, left * (kind == 1))))
        out[cells(n + 2)] = (source[cells(0)] + guess) & 255
    return out[: (h + 1) * (n + 1)].reshape(h + 1, n + 1, bpp)[1:, 1:].reshape(h, n * bpp).astype(np.uint8)


def filtered(rows: np.ndarray, bpp: int, row_filter: str) -> np.ndarray:
    """The rows after their filter's byte. ``adaptive`` takes each row's filter of the
    least sum of magnitudes."""
    h, stride = rows.shape
    wide = rows.astype(np.int16)
    left = np.pad(wide, ((0, 0), (bpp, 0)))[:, :stride]
    above = np.pad(wide, ((1, 0), (0, 0)))[:h]
    corner = np.pad(above, ((0, 0), (bpp, 0)))[:, :stride]
    guess = {"none": lambda: 0, "sub": lambda: left, "up": lambda: above, "avg": lambda: (left + above) >> 1, "paeth": lambda: paeth(left, above, corner)}
    chosen = FILTERS if row_filter == "adaptive" else [row_filter]
    kinds, lines, least = np.zeros(h, np.uint8), rows, None
    for name in chosen:
        line = (wide - guess[name]()).astype(np.uint8)
        cost = np.abs(line.view(np.int8).astype(np.int64)).sum(axis=1)
        better = np.ones(h, bool) if least is None else cost < least
        kinds = np.where(better, FILTERS.index(name), kinds).astype(np.uint8)
        lines = np.where(better[:, None], line, lines)
        least = cost if least is None else np.minimum(cost, least)
    return np.concatenate([kinds[:, None], lines], axis=1)


def samples(rows: np.ndarray, w: int, c: int, bits: int) -> np.ndarray:
    """(height, width, channels) numbers of unfiltered rows."""
    h = len(rows)
    if bits == 16:
        return np.ascontiguousarray(rows).view(">u2").astype(np.int64).reshape(h, w, c)
    if bits == 8:
        return rows.astype(np.int64).reshape(h, w, c)
    px = np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits - 1, -1, -1))
    return px[:, : w * c].reshape(h, w, c).astype(np.int64)


def pixels(raw: np.ndarray, w: int, h: int, c: int, bits: int, interlaced: bool) -> np.ndarray:
    bpp = max(1, c * bits // 8)
    if not interlaced:
        stride = (w * c * bits + 7) // 8
        return samples(unfiltered(raw, h, stride, bpp), w, c, bits)
    out, at = np.zeros((h, w, c), np.int64), 0
    for x, y, dx, dy in PASSES:
        own_w, own_h = -(-(w - x) // dx), -(-(h - y) // dy)
        if own_w <= 0 or own_h <= 0:
            continue
        stride = (own_w * c * bits + 7) // 8
        size = own_h * (stride + 1)
        out[y::dy, x::dx] = samples(unfiltered(raw[at : at + size], own_h, stride, bpp), own_w, c, bits)
        at += size
    return out


def decode(data: bytes) -> Decoded:
    at, parts, head, palette, exif, icc, clear = 8, [], None, None, None, None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"eXIf":
            exif = body
        elif kind == b"iCCP":
            icc = zlib.decompress(body[body.index(b"\0") + 2 :])
    if head is None or head[6] > 1 or head[3] not in CHANNELS:
        raise CodecError("not a PNG that can be read")
    w, h, bits, color = head[:4]
    c = CHANNELS[color]
    px = pixels(np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8), w, h, c, bits, head[6] == 1)
    if bits < 8 and color != 3:
        px = px * (255 // ((1 << bits) - 1))
    if color == 3:
        table = palette.astype(np.int64)
        if clear is not None:
            alpha = np.full((len(table), 1), 255)
            alpha[: len(clear), 0] = np.frombuffer(clear, np.uint8)
            table = np.concatenate([table, alpha], axis=1)
        px = table[px[..., 0]]
    family = {0: "L", 2: "Rgb", 3: "Rgb", 4: "La", 6: "Rgba"}[color]
    return Decoded(px, bits if color != 3 else 8, f"{family}{8 if color == 3 else bits}", exif, icc)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(px: np.ndarray, bits: int, level: int = 7, row_filter: str = "none", exif: bytes | None = None, icc: bytes | None = None) -> bytes:
    h, w, c = px.shape
    rows = np.ascontiguousarray(px.astype(">u2" if bits == 16 else np.uint8)).view(np.uint8).reshape(h, -1)
    raw = filtered(rows, c * bits // 8, row_filter).tobytes()
    color = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    out = [MARK, chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, color, 0, 0, 0))]
    if icc:
        out.append(chunk(b"iCCP", b"icc\0\0" + zlib.compress(icc)))
    if exif:
        out.append(chunk(b"eXIf", exif))
    return b"".join([*out, chunk(b"IDAT", zlib.compress(raw, level)), chunk(b"IEND", b"")])
