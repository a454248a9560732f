"""TIFF: the first image in (strips or tiles; plain, LZW, deflate, PackBits), one plain strip out."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from lumenframe.sources.image import CodecError, Decoded

#: Bytes of each field type.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
ICC = 34675


def fields(data: bytes, order: str, at: int) -> dict[int, list[int] | bytes]:
    """Whole-number and byte fields of one directory."""
    out: dict[int, list[int] | bytes] = {}
    for k in range(struct.unpack(f"{order}H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(f"{order}HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        place, size = at + 10 + 12 * k, SIZES.get(kind, 0) * n
        if size > 4:
            place = struct.unpack(f"{order}I", data[place : place + 4])[0]
        raw = data[place : place + size]
        if len(raw) < size or not size:
            continue
        if kind in (3, 4):
            out[tag] = list(struct.unpack(f"{order}{n}{'H' if kind == 3 else 'I'}", raw))
        elif kind in (1, 2, 6, 7):
            out[tag] = raw
    return out


def unpacked_bits(data: bytes) -> bytes:
    """PackBits."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def unpacked_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit, widened one entry early."""
    fresh = [bytes([k]) for k in range(256)] + [b"", b""]
    table, size, held, n, at, before, out = list(fresh), 9, 0, 0, 0, b"", []
    while True:
        while n < size:
            if at >= len(data):
                return b"".join(out)
            held, n, at = (held << 8 | data[at]) & 0xFFFFFF, n + 8, at + 1
        code = held >> (n - size) & ((1 << size) - 1)
        n -= size
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, size, before = list(fresh), 9, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise CodecError("no such LZW code")
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        if len(table) + 1 >= 1 << size and size < 12:
            size += 1


UNPACK = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpacked_bits}


def decode(data: bytes) -> Decoded:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise CodecError("not a TIFF")
    f = fields(data, order, struct.unpack(f"{order}I", data[4:8])[0])
    one = lambda tag, default=None: f[tag][0] if tag in f else default
    w, h, c = one(256), one(257), one(277, 1)
    bits, packing, kind, predictor = one(258, 1), one(259, 1), one(262), one(317, 1)
    if not w or not h or packing not in UNPACK or bits not in (1, 2, 4, 8, 16) or kind not in (0, 1, 2, 3) or one(284, 1) != 1 or one(339, 1) != 1:
        raise CodecError("a TIFF of a kind that isn't read")
    tiled = 322 in f
    bw, bh = (one(322), one(323)) if tiled else (w, min(h, one(278, h)))
    offsets, counts = (f.get(324), f.get(325)) if tiled else (f.get(273), f.get(279))
    across, stride = -(-w // bw), -(-bw * c * bits // 8)
    px = np.zeros((-(-h // bh) * bh, across * bw, c), np.int64)
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        raw = UNPACK[packing](data[at : at + size])
        rows = min(bh, len(raw) // stride)
        block = np.frombuffer(raw, np.uint8, rows * stride).reshape(rows, stride)
        if bits == 16:
            block = block.view(f"{order}u2").astype(np.int64)
        elif bits < 8:
            block = (np.unpackbits(block, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits - 1, -1, -1)))[:, : bw * c]
        block = block.reshape(rows, bw, c).astype(np.int64)
        if predictor == 2:
            block = np.cumsum(block, axis=1) % (1 << bits)
        y, x = k // across * bh, k % across * bw
        px[y : y + rows, x : x + bw] = block
    px, icc = px[:h, :w], f.get(ICC)
    icc = icc if isinstance(icc, bytes) else None
    if kind == 3:
        table = np.array(f[320], np.int64).reshape(3, -1).T
        return Decoded((table[px[..., 0]] + 128) // 257, 8, "Rgb8", None, icc)
    top = (1 << bits) - 1
    if kind == 0:
        px[..., 0] = top - px[..., 0]
    if bits < 8:
        px = px * (255 // top)
    base = 1 if kind < 2 else 3
    alpha = c > base and 338 in f and one(338) in (1, 2)
    px = px[..., : base + alpha]
    family = {(1, False): "L", (1, True): "La", (3, False): "Rgb", (3, True): "Rgba"}[base, bool(alpha)]
    return Decoded(px, 16 if bits == 16 else 8, f"{family}{bits}", None, icc)


def encode(px: np.ndarray, bits: int, icc: bytes | None = None) -> bytes:
    """Little-endian, one plain strip."""
    h, w, c = px.shape
    raw = px.astype("<u2" if bits == 16 else np.uint8).tobytes()
    raw += b"\0" * (len(raw) % 2)
    entries: list[tuple[int, int, list[int] | bytes]] = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * c), (259, 3, [1]), (262, 3, [2 if c >= 3 else 1]), (273, 4, [8]),
        (277, 3, [c]), (278, 4, [h]), (279, 4, [h * w * c * bits // 8]), (284, 3, [1]), (339, 3, [1] * c),
    ]
    if c in (2, 4):
        entries.append((338, 3, [2]))
    if icc:
        entries.append((ICC, 7, icc))
    entries.sort()
    begin = 8 + len(raw)
    later, rows = b"", []
    for tag, kind, values in entries:
        body = values if isinstance(values, bytes) else struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        n = len(values)
        if len(body) > 4:
            place = begin + 2 + 12 * len(entries) + 4 + len(later)
            later += body + b"\0" * (len(body) % 2)
            body = struct.pack("<I", place)
        rows.append(struct.pack("<HHI", tag, kind, n) + body.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<I", begin) + raw + struct.pack("<H", len(rows)) + b"".join(rows) + b"\0\0\0\0" + later
