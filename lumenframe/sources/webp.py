"""Lossless WebP (VP8L, RFC 9649). Everything of it is read; files are written with
green subtracted, each cell as the difference to its left one, and no references back.
Lossy WebP is neither read nor written."""

from __future__ import annotations

import heapq
import struct

import numpy as np

from lumenframe.sources.image import CodecError, Decoded

#: The order in which the lengths of the length code are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Columns to the left and rows above of the 120 short distances.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2),
    (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2),
    (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6),
    (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICT, COLOR, GREEN, INDEX = range(4)
ALPHABETS = (280, 256, 256, 256, 40)


class Bits:
    """Reads numbers from the low bit on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def need(self, size: int) -> None:
        while self.n < size:
            if self.at > len(self.data) + 64:
                raise CodecError("the WebP data ends early")
            self.held |= int.from_bytes(self.data[self.at : self.at + 8], "little") << self.n
            self.at, self.n = self.at + 8, self.n + 64

    def take(self, size: int) -> int:
        self.need(size)
        v = self.held & ((1 << size) - 1)
        self.held, self.n = self.held >> size, self.n - size
        return v

    def symbol(self, code: tuple[int, list[tuple[int, int]]]) -> int:
        width, table = code
        self.need(width)
        length, symbol = table[self.held & ((1 << width) - 1)]
        self.held, self.n = self.held >> length, self.n - length
        return symbol


def canonical(lengths: list[int]) -> list[int]:
    """Code of each symbol, its first bit lowest."""
    out, code = [0] * len(lengths), 0
    for length in range(1, max(lengths, default=0) + 1):
        for s, n in enumerate(lengths):
            if n == length:
                out[s] = int(f"{code:0{length}b}"[::-1], 2)
                code += 1
        code <<= 1
    return out


def lookup(lengths: list[int]) -> tuple[int, list[tuple[int, int]]]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1:
        return 0, [(0, used[0] if used else 0)]
    width = max(lengths)
    if sum(1 << (width - n) for n in lengths if n) != 1 << width:
        raise CodecError("a prefix code that isn't whole")
    table: list[tuple[int, int]] = [(0, 0)] * (1 << width)
    for s, code in zip(used, (c for c, n in zip(canonical(lengths), lengths, strict=True) if n), strict=True):
        n = lengths[s]
        table[code :: 1 << n] = [(n, s)] * (1 << (width - n))
    return width, table


def read_code(bits: Bits, size: int) -> tuple[int, list[tuple[int, int]]]:
    lengths = [0] * size
    if bits.take(1):
        two = bits.take(1)
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return lookup(lengths)
    own = [0] * 19
    for k in range(4 + bits.take(4)):
        own[LENGTH_ORDER[k]] = bits.take(3)
    code, left = lookup(own), size
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(code)
        if s < 16:
            lengths[at], at, before = s, at + 1, s or before
            continue
        many = 3 + bits.take(2) if s == 16 else 3 + bits.take(3) if s == 17 else 11 + bits.take(7)
        if at + many > size:
            raise CodecError("too many code lengths")
        lengths[at : at + many] = [before if s == 16 else 0] * many
        at += many
    return lookup(lengths)


def number(bits: Bits, symbol: int) -> int:
    """A length or distance of a prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.take(extra) + 1


def read_cells(bits: Bits, w: int, h: int, outer: bool) -> list[int]:
    """ARGB numbers of an entropy-coded image."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    groups, meta, shift, across = 1, None, 0, 0
    if outer and bits.take(1):
        shift = bits.take(3) + 2
        across = -(-w // (1 << shift))
        meta = [c >> 8 & 0xFFFF for c in read_cells(bits, across, -(-h // (1 << shift)), False)]
        groups = max(meta) + 1
    codes = [[read_code(bits, n + (len(cache) if k == 0 else 0)) for k, n in enumerate(ALPHABETS)] for _ in range(groups)]
    out: list[int] = []
    total, cached = w * h, 0
    while len(out) < total:
        at = len(out)
        green, red, blue, alpha, distance = codes[meta[(at // w >> shift) * across + (at % w >> shift)] if meta else 0]
        s = bits.symbol(green)
        if s < 256:
            r = bits.symbol(red)
            b = bits.symbol(blue)
            out.append(bits.symbol(alpha) << 24 | r << 16 | s << 8 | b)
            continue
        if cache:  # cells enter the cache when it is asked
            for c in out[cached:]:
                cache[(c * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = c
            cached = at
        if s >= 280:
            out.append(cache[s - 280])
            continue
        many = number(bits, s - 256)
        d = number(bits, bits.symbol(distance))
        if d <= 120:
            x, y = NEAR[d - 1]
            d = max(1, x + y * w)
        else:
            d -= 120
        if d > at or at + many > total:
            raise CodecError("a reference out of the image")
        if d >= many:
            out += out[at - d : at - d + many]
        else:
            out += (out[at - d : at] * (many // d + 1))[:many]
    return out


def channels(cells: list[int] | np.ndarray, w: int, h: int) -> np.ndarray:
    """(h, w, 4) of alpha, red, green and blue."""
    return np.array(cells, ">u4").view(np.uint8).reshape(h, w, 4).astype(np.int64)


def predicted(mode: int, left, top, corner, right):
    """The guess of one cell from its neighbours, each a list of four channels."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 0:
        return [255, 0, 0, 0]
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7, 8, 9):
        return half(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    clip = lambda v: max(0, min(255, v))
    if mode == 12:
        return [clip(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    mean = half(left, top)
    return [clip(m + int((m - c) / 2)) for m, c in zip(mean, corner, strict=True)]


def unpredicted(px: np.ndarray, modes: np.ndarray, size: int) -> np.ndarray:
    h, w, _ = px.shape
    if (modes == 1).all():  # all from the left: running sums
        px[0, 0, 0] += 255
        px[:, 0] = np.cumsum(px[:, 0], axis=0)
        return np.cumsum(px, axis=1) % 256
    rows = px.tolist()
    for y in range(h):
        for x in range(w):
            if y == 0:
                guess = rows[0][x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = rows[y - 1][0]
            else:
                right = rows[y - 1][x + 1] if x + 1 < w else rows[y][0]
                guess = predicted(int(modes[y >> size, x >> size]), rows[y][x - 1], rows[y - 1][x], rows[y - 1][x - 1], right)
            rows[y][x] = [(a + b) & 255 for a, b in zip(rows[y][x], guess, strict=True)]
    return np.array(rows, np.int64)


def signed(v: np.ndarray) -> np.ndarray:
    return (v + 128) % 256 - 128


def decode(data: bytes) -> Decoded:
    at, body, exif, icc = 12, None, None, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        part = data[at + 8 : at + 8 + size]
        if kind == b"VP8L" and body is None:
            body = part
        elif kind == b"EXIF":
            exif = part
        elif kind == b"ICCP":
            icc = part
        elif kind == b"VP8 ":
            raise CodecError("lossy WebP is not read")
        at += 8 + size + size % 2
    if not body or body[0] != 0x2F:
        raise CodecError("a WebP without a lossless image")
    bits = Bits(body[1:])
    w, h, alpha = bits.take(14) + 1, bits.take(14) + 1, bits.take(1)
    if bits.take(3):
        raise CodecError("a WebP of another version")
    transforms, width = [], w
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICT, COLOR):
            size = bits.take(3) + 2
            bw, bh = -(-width // (1 << size)), -(-h // (1 << size))
            transforms.append((kind, size, channels(read_cells(bits, bw, bh, False), bw, bh), width))
        elif kind == INDEX:
            n = bits.take(8) + 1
            table = np.cumsum(channels(read_cells(bits, n, 1, False), n, 1)[0], axis=0) % 256
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, packing, table, width))
            width = -(-width // (1 << packing))
        else:
            transforms.append((GREEN, 0, None, width))
    px = channels(read_cells(bits, width, h, True), width, h)
    for kind, size, extra, own in reversed(transforms):
        if kind == PREDICT:
            px = unpredicted(px, extra[..., 2], size)
        elif kind == COLOR:
            full = np.repeat(np.repeat(extra, 1 << size, axis=0), 1 << size, axis=1)[:h, :own]
            by = lambda m, v: (signed(m) * signed(v)) >> 5
            px[..., 1] = (px[..., 1] + by(full[..., 3], px[..., 2])) % 256
            px[..., 3] = (px[..., 3] + by(full[..., 2], px[..., 2]) + by(full[..., 1], px[..., 1])) % 256
        elif kind == GREEN:
            px[..., 1] = (px[..., 1] + px[..., 2]) % 256
            px[..., 3] = (px[..., 3] + px[..., 2]) % 256
        else:
            per, step = 1 << size, 8 >> size
            places = np.stack([px[..., 2] >> (step * k) & ((1 << step) - 1) for k in range(per)], axis=2).reshape(h, -1)[:, :own]
            table = np.concatenate([extra, np.zeros((256, 4), np.int64)])
            px = table[places]
    rgba = px[..., [1, 2, 3, 0]]
    return Decoded(rgba if alpha else rgba[..., :3], 8, "Rgba8" if alpha else "Rgb8", exif, icc)


def code_lengths(counts: np.ndarray, most: int = 15) -> list[int]:
    """Huffman code lengths of at most ``most`` bits; one symbol alone has none."""
    lengths, held = [0] * len(counts), {int(s): int(counts[s]) for s in np.flatnonzero(counts)}
    while len(held) > 1:
        depth = dict.fromkeys(held, 0)
        heap = [(n, s, (s,)) for s, n in held.items()]
        heapq.heapify(heap)
        while len(heap) > 1:
            (n, _, one), (m, k, two) = heapq.heappop(heap), heapq.heappop(heap)
            for s in one + two:
                depth[s] += 1
            heapq.heappush(heap, (n + m, k, one + two))
        if max(depth.values()) <= most:
            for s, d in depth.items():
                lengths[s] = d
            break
        held = {s: (n + 1) // 2 for s, n in held.items()}
    return lengths


class Writer:
    """Numbers and how many bits each has, from the low bit on."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, *pairs: tuple[int, int]) -> None:
        self.values.append(np.array([v for v, _ in pairs], np.int64))
        self.sizes.append(np.array([n for _, n in pairs], np.int64))

    def cells(self, px: np.ndarray) -> None:
        """An entropy-coded image of one group: no cache, literals only."""
        flat = px.reshape(-1, 4)[:, [2, 1, 3, 0]]  # green, red, blue, alpha
        values, sizes = np.empty_like(flat), np.empty_like(flat)
        for k, size in enumerate(ALPHABETS):
            counts = np.bincount(flat[:, k], minlength=size) if k < 4 else np.zeros(size, np.int64)
            lengths = code_lengths(counts)
            if not any(lengths):
                self.put((1, 1), (0, 1), (1, 1), (int(np.argmax(counts)), 8))
            else:
                # The length code gives each of 0 to 15 four bits.
                self.put((0, 1), (15, 4), *[(4 if s < 16 else 0, 3) for s in LENGTH_ORDER], (0, 1))
                four = canonical([4] * 16)
                self.put(*[(four[n], 4) for n in lengths])
            if k < 4:
                values[:, k], sizes[:, k] = np.array(canonical(lengths))[flat[:, k]], np.array(lengths)[flat[:, k]]
        self.values.append(values.ravel())
        self.sizes.append(sizes.ravel())

    def bytes(self) -> bytes:
        values, sizes = np.concatenate(self.values), np.concatenate(self.sizes)
        out = []
        for at in range(0, len(values), 1 << 18):
            v, n = values[at : at + (1 << 18)], sizes[at : at + (1 << 18)]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((np.repeat(v, n) >> inner & 1).astype(np.uint8))
        return np.packbits(np.concatenate(out), bitorder="little").tobytes()


def encode(rgba: np.ndarray, alpha: bool) -> bytes:
    """RGBA of 8 bits, without loss."""
    h, w, _ = rgba.shape
    if not 0 < h <= 1 << 14 or not 0 < w <= 1 << 14:
        raise CodecError("WebP holds up to 16384 cells a side")
    px = rgba[..., [3, 0, 1, 2]].astype(np.int64)
    if not alpha:
        px[..., 0] = 255
    px[..., 1], px[..., 3] = (px[..., 1] - px[..., 2]) % 256, (px[..., 3] - px[..., 2]) % 256
    rest = px.copy()
    rest[:, 1:] -= px[:, :-1]
    rest[1:, 0] -= px[:-1, 0]
    rest[0, 0, 0] -= 255
    out = Writer()
    out.put((w - 1, 14), (h - 1, 14), (int(alpha), 1), (0, 3), (1, 1), (GREEN, 2), (1, 1), (PREDICT, 2), (7, 3))
    modes = np.zeros((-(-h // 512), -(-w // 512), 4), np.int64)
    modes[..., 2] = 1
    out.put((0, 1))
    out.cells(modes)
    out.put((0, 1), (0, 1), (0, 1))
    out.cells(rest % 256)
    body = b"\x2f" + out.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
