"""Formats of few rules: PNM, farbfeld, BMP, QOI, TGA, PCX and ICO."""

from __future__ import annotations

import struct

import numpy as np

from lumenframe.sources import png
from lumenframe.sources.image import CodecError, Decoded, eight, widened

def decode_pnm(data: bytes) -> Decoded:
    fields, at = [], 2
    while len(fields) < (2 if data[1:2] in b"14" else 3):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h = fields[:2]
    c = 3 if data[1:2] in b"36" else 1
    if data[1:2] == b"4":
        bits = np.unpackbits(np.frombuffer(data[at + 1 :], np.uint8).reshape(h, -1), axis=1)[:, :w]
        return Decoded((255 * (1 - bits.astype(np.int64))).reshape(h, w, 1), 8, "L1")
    if data[1:2] == b"1":
        return Decoded(255 * (1 - np.array([int(b) for b in data[at:].decode() if b in "01"], np.int64)).reshape(h, w, 1), 8, "L1")
    most = fields[2]
    if data[1:2] in b"56":
        kind = np.dtype(">u2" if most > 255 else np.uint8)
        px = np.frombuffer(data, kind, w * h * c, at + 1).astype(np.int64)
    else:
        px = np.array(data[at:].split(), np.int64)
    deep = most > 255
    px = (px * (65535 if deep else 255) + most // 2) // most
    return Decoded(px.reshape(h, w, c), 16 if deep else 8, f"{'Rgb' if c == 3 else 'L'}{16 if deep else 8}")


def encode_pnm(px: np.ndarray, bits: int) -> bytes:
    h, w, c = px.shape
    px = px[..., : 3 if c >= 3 else 1]
    mark = b"P6" if px.shape[2] == 3 else b"P5"
    return b"%s\n%d %d\n%d\n" % (mark, w, h, (1 << bits) - 1) + px.astype(">u2" if bits == 16 else np.uint8).tobytes()


def encode_ff(px: np.ndarray, bits: int) -> bytes:
    h, w, _ = px.shape
    return b"farbfeld" + struct.pack(">II", w, h) + widened(px, bits).astype(">u2").tobytes()


def decode_ff(data: bytes) -> Decoded:
    w, h = struct.unpack(">II", data[8:16])
    return Decoded(np.frombuffer(data, ">u2", w * h * 4, 16).astype(np.int64).reshape(h, w, 4), 16, "Rgba16")


def encode_bmp(px: np.ndarray, bits: int) -> bytes:
    full = eight(px, bits)
    h, w, _ = full.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = full[::-1, :, 2::-1].reshape(h, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def decode_bmp(data: bytes) -> Decoded:
    start, w, h, bits = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0]
    if bits not in (24, 32) or struct.unpack("<I", data[30:34])[0] not in (0, 3):
        raise CodecError("only plain 24 and 32 bit BMP is read")
    c, rows = bits // 8, abs(h)
    stride = (w * c + 3) // 4 * 4
    px = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : w * c].reshape(rows, w, c)[..., :3]
    px = px[..., ::-1].astype(np.int64)
    return Decoded(px[::-1].copy() if h > 0 else px, 8, "Rgb8")


def encode_qoi(px: np.ndarray, bits: int) -> bytes:
    full = eight(px, bits)
    h, w, _ = full.shape
    c = 4 if px.shape[2] in (2, 4) else 3
    out = bytearray(b"qoif" + struct.pack(">IIBB", w, h, c, 0))
    seen, before, run = [None] * 64, (0, 0, 0, 255), 0
    for cell in map(tuple, full.reshape(-1, 4).tolist()):
        if cell == before:
            run += 1
            if run == 62:
                out.append(0xC0 | 61)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        r, g, b, a = cell
        place = (3 * r + 5 * g + 7 * b + 11 * a) % 64
        if seen[place] == cell:
            out.append(place)
        else:
            seen[place] = cell
            dr, dg, db = ((x - y + 128) % 256 - 128 for x, y in zip(cell[:3], before[:3], strict=True))
            if a != before[3]:
                out += bytes((0xFF, *cell))
            elif -3 < dr < 2 and -3 < dg < 2 and -3 < db < 2:
                out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
            elif -33 < dg < 32 and -9 < dr - dg < 8 and -9 < db - dg < 8:
                out += bytes((0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
            else:
                out += bytes((0xFE, r, g, b))
        before = cell
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + b"\0" * 7 + b"\1"


def decode_qoi(data: bytes) -> Decoded:
    w, h, c, _ = struct.unpack(">IIBB", data[4:14])
    seen, now, at, out = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 14, []
    while len(out) < w * h:
        if at >= len(data):
            raise CodecError("the QOI data ends early")
        op, at = data[at], at + 1
        if op >= 0xFE:
            n = 4 if op == 0xFF else 3
            now = (*data[at : at + n], *now[n:])
            at += n
        elif op >= 0xC0:
            out += [now] * ((op & 63) + 1)
            continue
        elif op >= 0x80:
            dg, more, at = (op & 63) - 32, data[at], at + 1
            now = ((now[0] + dg + (more >> 4) - 8) % 256, (now[1] + dg) % 256, (now[2] + dg + (more & 15) - 8) % 256, now[3])
        elif op >= 0x40:
            now = ((now[0] + (op >> 4 & 3) - 2) % 256, (now[1] + (op >> 2 & 3) - 2) % 256, (now[2] + (op & 3) - 2) % 256, now[3])
        else:
            now = seen[op]
        r, g, b, a = now
        seen[(3 * r + 5 * g + 7 * b + 11 * a) % 64] = now
        out.append(now)
    px = np.array(out[: w * h], np.int64).reshape(h, w, 4)
    return Decoded(px if c == 4 else px[..., :3], 8, "Rgba8" if c == 4 else "Rgb8")


def encode_tga(px: np.ndarray, bits: int) -> bytes:
    """Plain, from the upper left; grey or colour, with alpha where there is some."""
    h, w, c = px.shape
    if c == 1:
        flat = px if bits == 8 else (px + 128) // 257
        kind, depth = 3, 8
    else:
        full = eight(px, bits)
        flat, kind, depth = (full[..., [2, 1, 0, 3]], 2, 32) if c in (2, 4) else (full[..., 2::-1], 2, 24)
    return struct.pack("<BBBHHBHHHHBB", 0, 0, kind, 0, 0, 0, 0, 0, w, h, depth, 0x20 | (8 if depth == 32 else 0)) + flat.astype(np.uint8).tobytes()


def decode_tga(data: bytes) -> Decoded:
    skip, mapped, kind, first, n, entry, _, _, w, h, depth, flags = struct.unpack("<BBBHHBHHHHBB", data[:18])
    if kind not in (1, 2, 3, 9, 10, 11) or depth not in (8, 24, 32) or (kind & 3 == 1) != bool(mapped) or (mapped and entry not in (24, 32)):
        raise CodecError("a TGA of a kind that isn't read")
    at, size = 18 + skip, depth // 8
    table = None
    if mapped:
        table = np.frombuffer(data, np.uint8, n * entry // 8, at).reshape(n, entry // 8)
        at += n * entry // 8
    raw = data[at:]
    if kind >= 9:
        out, at = bytearray(), 0
        while len(out) < w * h * size and at < len(raw):
            head, at = raw[at], at + 1
            many = (head & 127) + 1
            out += raw[at : at + size] * many if head & 128 else raw[at : at + size * many]
            at += size if head & 128 else size * many
        raw = bytes(out)
    px = np.frombuffer(raw, np.uint8, w * h * size).reshape(h, w, size).astype(np.int64)
    if table is not None:
        px = table[px[..., 0] - first].astype(np.int64)
    if px.shape[2] >= 3:
        px = px[..., [2, 1, 0, 3][: px.shape[2]]]
    px = px if flags & 0x20 else px[::-1]
    px = px[:, ::-1] if flags & 0x10 else px
    return Decoded(px.copy(), 8, {1: "L8", 3: "Rgb8", 4: "Rgba8"}[px.shape[2]])


def decode_pcx(data: bytes) -> Decoded:
    bits, x0, y0, x1, y1 = data[3], *struct.unpack("<HHHH", data[4:12])
    planes, stride = data[65], struct.unpack("<H", data[66:68])[0]
    w, h = x1 - x0 + 1, y1 - y0 + 1
    if bits not in (1, 8) or planes not in (1, 3) or (bits, planes) == (1, 3):
        raise CodecError("a PCX of a kind that isn't read")
    out, at, need = bytearray(), 128, h * planes * stride
    while len(out) < need and at < len(data):
        b, at = data[at], at + 1
        if b >= 0xC0 and data[2]:
            out += data[at : at + 1] * (b & 63)
            at += 1
        else:
            out.append(b)
    if len(out) < need:
        raise CodecError("the PCX data ends early")
    rows = np.frombuffer(bytes(out[:need]), np.uint8).reshape(h, planes, stride)
    if bits == 1:
        return Decoded(255 * np.unpackbits(rows[:, 0], axis=1)[:, :w, None].astype(np.int64), 8, "L1")
    if planes == 3:
        return Decoded(rows[..., :w].transpose(0, 2, 1).astype(np.int64), 8, "Rgb8")
    table = np.frombuffer(data[-768:], np.uint8).reshape(256, 3)
    return Decoded(table[rows[:, 0, :w]].astype(np.int64), 8, "Rgb8")


def encode_pcx(px: np.ndarray, bits: int) -> bytes:
    full = eight(px, bits)[..., :3].astype(np.uint8)
    h, w, _ = full.shape
    stride = w + w % 2
    head = struct.pack("<BBBBHHHHHH", 10, 5, 1, 8, 0, 0, w - 1, h - 1, 72, 72) + b"\0" * 49 + struct.pack("<BHH", 3, stride, 1)
    out = bytearray(head.ljust(128, b"\0"))
    for line in full.transpose(0, 2, 1).reshape(-1, w):
        line = np.append(line, line[-1:] if w % 2 else line[:0])
        begins = np.flatnonzero(np.diff(line.astype(np.int64), prepend=-1))
        for value, run in zip(line[begins].tolist(), np.diff([*begins, len(line)]).tolist(), strict=True):
            while run:
                n = min(run, 63)
                out += bytes((0xC0 | n, value)) if n > 1 or value >= 0xC0 else bytes((value,))
                run -= n
    return bytes(out)


def encode_ico(px: np.ndarray, bits: int) -> bytes:
    """One image, as PNG."""
    h, w, _ = px.shape
    if h > 256 or w > 256:
        raise CodecError("ICO holds up to 256 cells a side")
    body = png.encode(eight(px, bits), 8)
    return struct.pack("<HHHBBBBHHII", 0, 1, 1, w % 256, h % 256, 0, 0, 1, 32, len(body), 22) + body


def decode_ico(data: bytes) -> Decoded:
    """The largest image, if it is a PNG or a 24 or 32-bit bitmap."""
    n = struct.unpack("<H", data[4:6])[0]
    entries = [struct.unpack("<BBBBHHII", data[6 + 16 * k : 22 + 16 * k]) for k in range(n)]
    if not entries:
        raise CodecError("an ICO without images")
    w, h, *_, bits, size, at = max(entries, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[5]))
    body = data[at : at + size]
    if body.startswith(png.MARK):
        return png.decode(body)
    start, w, h2, bits = struct.unpack("<I", body[:4])[0], *struct.unpack("<ii", body[4:12]), struct.unpack("<H", body[14:16])[0]
    if bits not in (24, 32):
        raise CodecError("an ICO of a kind that isn't read")
    h, c = h2 // 2, bits // 8
    stride = (w * c + 3) // 4 * 4
    px = np.frombuffer(body, np.uint8, stride * h, start).reshape(h, stride)[::-1, : w * c].reshape(h, w, c).astype(np.int64)
    if c == 4:
        return Decoded(px[..., [2, 1, 0, 3]], 8, "Rgba8")
    wide = (w + 31) // 32 * 4
    clear = np.unpackbits(np.frombuffer(body, np.uint8, wide * h, start + stride * h).reshape(h, wide), axis=1)[::-1, :w]
    return Decoded(np.concatenate([px[..., ::-1], 255 * (1 - clear[..., None].astype(np.int64))], axis=2), 8, "Rgba8")
