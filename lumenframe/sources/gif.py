"""GIF: first frame in, one frame out, colours chosen by median cut."""

from __future__ import annotations

import struct

import numpy as np

from lumenframe.sources.image import CodecError, Decoded


def unpacked_codes(data: bytes, width: int) -> bytes:
    """LZW: codes of ``width`` + 1 bits and more to the places they stand for."""
    clear, end = 1 << width, (1 << width) + 1
    held = n = at = 0
    size, table, before, out = width + 1, [], b"", []
    fresh = [bytes([k]) for k in range(clear)] + [b"", b""]
    table = list(fresh)
    while True:
        while n < size:
            if at >= len(data):
                return b"".join(out)
            held |= data[at] << n
            at, n = at + 1, n + 8
        code, held, n = held & ((1 << size) - 1), held >> size, n - size
        if code == clear:
            table, size, before = list(fresh), width + 1, b""
            continue
        if code == end:
            return b"".join(out)
        if code > len(table) or (code == len(table) and not before):
            raise CodecError("no such LZW code")
        entry = table[code] if code < len(table) else before + before[:1]
        out.append(entry)
        if before and len(table) < 4096:
            table.append(before + entry[:1])
            if len(table) == 1 << size and size < 12:
                size += 1
        before = entry


def packed_codes(places: bytes, width: int) -> bytes:
    clear, end = 1 << width, (1 << width) + 1
    codes, sizes, size, table, now = [clear], [width + 1], width + 1, {}, -1
    for p in places:
        key = now << 8 | p
        if now < 0:
            now = p
        elif key in table:
            now = table[key]
        else:
            codes.append(now)
            sizes.append(size)
            number = end + 1 + len(table)
            if number < 4096:
                table[key] = number
                if number == 1 << size and size < 12:
                    size += 1
            else:
                codes.append(clear)
                sizes.append(size)
                table, size = {}, width + 1
            now = p
    if now >= 0:
        codes.append(now)
        sizes.append(size)
        # The reader has one more entry by now.
        if end + 1 + len(table) == 1 << size and size < 12:
            size += 1
    codes.append(end)
    sizes.append(size)
    values, counts = np.array(codes), np.array(sizes)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.packbits((np.repeat(values, counts) >> inner & 1).astype(np.uint8), bitorder="little").tobytes()


def blocks_of(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def joined_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(out), at + 1


def median_cut(colors: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Boxes of colours are halved at their median, the one with the widest spread of
    cells first; a box's colour is its mean. Gives each colour's box."""
    boxes = [np.arange(len(colors))]
    spread = lambda b: (np.ptp(colors[b], axis=0).max() * counts[b].sum()) if len(b) > 1 else -1
    weight = [spread(boxes[0])]
    while len(boxes) < most and max(weight) > 0:
        k = int(np.argmax(weight))
        own = boxes[k]
        axis = int(np.ptp(colors[own], axis=0).argmax())
        own = own[np.argsort(colors[own, axis], kind="stable")]
        upto = np.cumsum(counts[own])
        cut = min(len(own) - 1, max(1, int(np.searchsorted(upto, upto[-1] / 2)) + 1))
        boxes[k], weight[k] = own[:cut], spread(own[:cut])
        boxes.append(own[cut:])
        weight.append(spread(own[cut:]))
    box = np.empty(len(colors), np.int64)
    for k, own in enumerate(boxes):
        box[own] = k
    return box


def encode(rgba: np.ndarray) -> bytes:
    """RGBA of 8 bits. Up to 256 colours (255 beside transparency) are kept exactly; a
    cell of alpha under 128 is transparent."""
    h, w, _ = rgba.shape
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise CodecError("GIF holds up to 65535 cells a side")
    clear = rgba[..., 3].ravel() < 128
    flat = rgba[..., :3].reshape(-1, 3).astype(np.int64)
    codes, which, counts = np.unique(flat @ np.array([65536, 256, 1]), return_inverse=True, return_counts=True)
    colors = np.stack([codes >> 16, codes >> 8 & 255, codes & 255], axis=1)
    most = 255 if clear.any() else 256
    if len(colors) > most:
        box = median_cut(colors, counts, most)
        total = np.bincount(box, counts)
        colors = np.stack([np.bincount(box, colors[:, k] * counts) / total for k in range(3)], axis=1)
        colors, which = np.rint(colors).astype(np.int64), box[which]
    places = which.astype(np.uint8)
    if clear.any():
        places[clear] = len(colors)
        colors = np.concatenate([colors, [[0, 0, 0]]])
    bits = max(1, (len(colors) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(colors)] = colors
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF0 | bits - 1, 0, 0), table.tobytes()]
    if clear.any():
        out.append(b"\x21\xf9\x04\x01\0\0" + bytes([len(colors) - 1]) + b"\0")
    width = max(2, bits)
    out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + bytes([width]) + blocks_of(packed_codes(places.tobytes(), width)))
    return b"".join([*out, b"\x3b"])


def decode(data: bytes) -> Decoded:
    """The first frame on its canvas, as RGBA."""
    w, h, flags = struct.unpack("<HHB", data[6:11])
    at, table, clear = 13, None, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        table, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    while at < len(data):
        mark = data[at]
        if mark == 0x21:
            body, end = joined_blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4 and body[0] & 1:
                clear = body[3]
            at = end
        elif mark == 0x2C:
            x, y, fw, fh, own = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            if own & 0x80:
                n = 2 << (own & 7)
                table, at = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
            body, _ = joined_blocks(data, at + 1)
            places = np.frombuffer(unpacked_codes(body, data[at]), np.uint8)
            if table is None or len(places) < fw * fh or (places.size and places.max() >= len(table)):
                raise CodecError("a GIF frame that isn't whole")
            places = places[: fw * fh].reshape(fh, fw)
            if own & 0x40:  # interlaced
                order = np.concatenate([np.arange(a, fh, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(places)
                straight[order] = places
                places = straight
            px = np.zeros((max(h, y + fh), max(w, x + fw), 4), np.int64)
            cell = np.concatenate([table[places], np.full((fh, fw, 1), 255)], axis=2)
            if clear is not None:
                cell = np.where((places == clear)[..., None], 0, cell)
            px[y : y + fh, x : x + fw] = cell
            return Decoded(px, 8, "Rgba8")
        else:
            break
    raise CodecError("a GIF without a frame")
