"""JPEG in NumPy: baseline is written, baseline and progressive are read. Encoding is
vectorised over all blocks; Huffman decoding reads symbol by symbol. Arithmetic,
lossless and 12-bit files are not read."""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from lumenframe.sources.image import CodecError, Decoded

#: The example quantisation tables of the JPEG standard (T.81, Annex K), for luma and for chroma.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]

#: Places of the 64 coefficients in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: Rows are the cosine basis.
BASIS = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def quantisers(quality: int) -> list[np.ndarray]:
    """Both tables at a quality of 1 to 100."""
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


def lengths_of(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits. A symbol that never comes has the last
    code, so that no code is all ones."""
    counts = dict(counts) or {0: 1}
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()] + [(0, 256, (256,))]
        heapq.heapify(heap)
        depth = dict.fromkeys([*counts, 256], 0)
        while len(heap) > 1:
            (n, _, one), (m, k, two) = heapq.heappop(heap), heapq.heappop(heap)
            for s in one + two:
                depth[s] += 1
            heapq.heappush(heap, (n + m, k, one + two))
        if max(depth.values()) <= 16:
            break
        counts = {s: (n + 1) // 2 for s, n in counts.items()}
    longest = max(depth, key=lambda s: (depth[s], s == 256))
    depth[longest], depth[256] = depth[256], depth[longest]
    return {s: d for s, d in depth.items() if s != 256}


def table_of(lengths: dict[int, int]) -> tuple[list[int], list[int]]:
    """How many codes of each length 1 to 16, and the symbols in order of their codes."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return [sum(d == k for d in lengths.values()) for k in range(1, 17)], order


def codes_of(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length): codes count up, and double from length to length."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, length)
            code += 1
        at, code = at + n, code << 1
    return out


def blocked(plane: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8) blocks of a plane, its border repeated to whole blocks."""
    h, w = plane.shape
    plane = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return plane.reshape(plane.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3)


def sizes_of(values: np.ndarray) -> np.ndarray:
    """Bits of each number's magnitude."""
    return np.frexp(np.abs(values).astype(np.float64))[1].astype(np.int64)


def events(zz: np.ndarray, component: np.ndarray, n_components: int) -> tuple[np.ndarray, ...]:
    """Symbols of all blocks in file order: table (0, 1 for DC, 2, 3 for AC), symbol,
    extra bits, and how many."""
    n, chroma = len(zz), (component > 0).astype(np.int64)
    dc = zz[:, 0].copy()
    for c in range(n_components):
        own = component == c
        dc[own] = np.diff(dc[own], prepend=0)
    row, col = np.nonzero(zz[:, 1:])
    value = zz[row, col + 1]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    before = np.where(first, -1, np.roll(col, 1)) if len(row) else col
    run = col - before - 1
    long = np.repeat(np.arange(len(row)), run // 16)
    last = np.full(n, -1)
    last[row] = col
    ends = np.flatnonzero(last < 62)
    extra = lambda v, size: np.where(v < 0, v + (1 << size) - 1, v)
    dc_size, ac_size = sizes_of(dc), sizes_of(value)
    zero = lambda k: np.zeros(len(k), np.int64)
    parts = [
        (np.arange(n) * 256, chroma, dc_size, extra(dc, dc_size), dc_size),
        (row[long] * 256 + 2 * col[long] + 1, 2 + chroma[row[long]], zero(long) + 0xF0, zero(long), zero(long)),
        (row * 256 + 2 * col + 2, 2 + chroma[row], (run % 16) * 16 + ac_size, extra(value, ac_size), ac_size),
        (ends * 256 + 255, 2 + chroma[ends], zero(ends), zero(ends), zero(ends)),
    ]
    place, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(place, kind="stable")
    return tuple(c[order] for c in columns)


def packed_bits(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Numbers of so many bits one after another, filled up with ones."""
    out = []
    for at in range(0, len(values), 1 << 17):
        v, n = values[at : at + (1 << 17)], lengths[at : at + (1 << 17)]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(((np.repeat(v, n) >> (np.repeat(n, n) - 1 - inner)) & 1).astype(np.uint8))
    bits = np.concatenate(out)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode(px: np.ndarray, quality: int, exif: bytes | None = None, icc: bytes | None = None) -> bytes:
    """Grey or RGB of 8 bits, with all planes at full size and Huffman tables made for the image."""
    h, w, c = px.shape
    if c not in (1, 3) or not 0 < h < 65536 or not 0 < w < 65536:
        raise CodecError("JPEG holds grey or RGB of up to 65535 cells a side")
    planes = px.astype(np.float64)
    if c == 3:
        r, g, b = np.moveaxis(planes, 2, 0)
        planes = np.stack([0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168735892 * r - 0.331264108 * g + 0.5 * b, 128 + 0.5 * r - 0.418687589 * g - 0.081312411 * b], axis=2)
    tables = quantisers(quality)[: 1 if c == 1 else 2]
    made = []
    for k in range(c):
        blocks = blocked(planes[..., k] - 128.0)
        spectrum = (BASIS @ blocks @ BASIS.T).reshape(-1, 64)
        made.append(np.rint(spectrum / tables[min(k, 1)])[:, ZIGZAG].astype(np.int64))
    zz = np.stack(made, axis=1).reshape(-1, 64)
    table, symbol, extra, n_extra = events(zz, np.tile(np.arange(c), len(made[0])), c)
    head = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    if exif and len(exif) < 65528:
        head.append(segment(0xE1, b"Exif\0\0" + exif))
    pieces = [icc[k : k + 65519] for k in range(0, len(icc), 65519)] if icc else []
    head += [segment(0xE2, b"ICC_PROFILE\0" + bytes([k, len(pieces)]) + p) for k, p in enumerate(pieces, 1)]
    head += [segment(0xDB, bytes([k, *t[ZIGZAG].tolist()])) for k, t in enumerate(tables)]
    head.append(segment(0xC0, struct.pack(">BHHB", 8, h, w, c) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(c))))
    code, size = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    for k in range(4) if c == 3 else (0, 2):
        found = np.bincount(symbol[table == k], minlength=256)
        bits, order = table_of(lengths_of({int(s): int(found[s]) for s in np.flatnonzero(found)}))
        for s, (value, length) in codes_of(bits, order).items():
            code[k, s], size[k, s] = value, length
        head.append(segment(0xC4, bytes([(k >> 1) << 4 | k & 1, *bits, *order])))
    head.append(segment(0xDA, bytes([c, *(x for k in range(c) for x in (k + 1, 0x11 * min(k, 1))), 0, 63, 0])))
    data = packed_bits(code[table, symbol] << n_extra | extra, size[table, symbol] + n_extra)
    return b"".join([*head, data.replace(b"\xff", b"\xff\0"), b"\xff\xd9"])


@lru_cache(maxsize=16)
def lookup(bits: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For every 16 bits: length and symbol of the code that they start with (0: none)."""
    length, symbol = [0] * 65536, [0] * 65536
    for s, (code, n) in codes_of(list(bits), list(symbols)).items():
        low, many = code << (16 - n), 1 << (16 - n)
        length[low : low + many], symbol[low : low + many] = [n] * many, [s] * many
    return length, symbol


class Bits:
    """Reads bits from entropy-coded bytes; ones follow the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def fill(self) -> None:
        more = self.data[self.at : self.at + 32]
        self.at += 32
        self.held = (self.held & ((1 << self.n) - 1)) << 256 | int.from_bytes(more.ljust(32, b"\xff"), "big")
        self.n += 256
        if self.at > len(self.data) + 4096:
            raise CodecError("the entropy-coded data ends early")

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        if self.n < 32:
            self.fill()
        peek = self.held >> (self.n - 16) & 0xFFFF
        length = table[0][peek]
        if not length:
            raise CodecError("no such Huffman code")
        self.n -= length
        return table[1][peek]

    def raw(self, size: int) -> int:
        if self.n < size:
            self.fill()
        self.n -= size
        return self.held >> self.n & ((1 << size) - 1)

    def number(self, size: int) -> int:
        """A signed number: the lower half of its bits' values stands for negative ones."""
        if not size:
            return 0
        v = self.raw(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def read_block(bits: Bits, dc: tuple, ac: tuple, out: list[int], at: int, before: int) -> int:
    """Puts a block's coefficients in zigzag order into ``out`` from ``at``; gives its DC."""
    out[at] = before = before + bits.number(bits.symbol(dc))
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        run, size = s >> 4, s & 15
        if size:
            k += run
            if k > 63:
                raise CodecError("a block is too long")
            out[at + k] = bits.number(size)
            k += 1
        elif run == 15:
            k += 16
        else:
            break
    return before


class Plane:
    """One component: its sampling, blocks (a padded grid) and their coefficients in zigzag order."""

    def __init__(self, name: int, nx: int, ny: int, quant: int, frame: tuple[int, int, int, int]):
        h, w, most_x, most_y = frame
        self.name, self.nx, self.ny, self.quant = name, nx, ny, quant
        self.across, self.down = -(-w // (8 * most_x)) * nx, -(-h // (8 * most_y)) * ny
        self.own_across, self.own_down = -(-(-(-w * nx // most_x)) // 8), -(-(-(-h * ny // most_y)) // 8)
        self.cells = [0] * (64 * self.across * self.down)


@dataclass
class Scan:
    """The state of one scan: tables by plane, band, bit positions, and the run of finished blocks."""

    dc: list
    ac: list
    first: int
    last: int
    high: int
    low: int
    progressive: bool
    run: int = 0

    def block(self, bits: Bits, plane: Plane, k: int, at: int, before: list[int]) -> None:
        out = plane.cells
        if not self.progressive:
            before[k] = read_block(bits, self.dc[k], self.ac[k], out, at, before[k])
        elif self.first == 0 and self.high == 0:
            before[k] += bits.number(bits.symbol(self.dc[k]))
            out[at] = before[k] * (1 << self.low)
        elif self.first == 0:
            out[at] |= bits.raw(1) << self.low
        elif self.high == 0:
            self.band(bits, self.ac[k], out, at)
        else:
            self.refine(bits, self.ac[k], out, at)

    def band(self, bits: Bits, ac: tuple, out: list[int], at: int) -> None:
        if self.run:
            self.run -= 1
            return
        k = self.first
        while k <= self.last:
            s = bits.symbol(ac)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                if k > 63:
                    raise CodecError("a block is too long")
                out[at + k] = bits.number(size) * (1 << self.low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                self.run = (1 << zeros) - 1 + bits.raw(zeros)
                return

    def corrected(self, bits: Bits, v: int) -> int:
        if bits.raw(1) and not abs(v) >> self.low & 1:
            return v + (1 << self.low) if v > 0 else v - (1 << self.low)
        return v

    def refine(self, bits: Bits, ac: tuple, out: list[int], at: int) -> None:
        k = self.first
        while k <= self.last and not self.run:
            s = bits.symbol(ac)
            zeros, size = s >> 4, s & 15
            if not size and zeros < 15:
                self.run = (1 << zeros) + bits.raw(zeros)
                break
            value = 0 if not size else (1 if bits.raw(1) else -1) * (1 << self.low)
            while k <= self.last:
                v = out[at + k]
                if v:
                    out[at + k] = self.corrected(bits, v)
                elif zeros:
                    zeros -= 1
                else:
                    break
                k += 1
            if value and k <= self.last:
                out[at + k] = value
            k += 1
        if self.run:
            for j in range(at + k, at + self.last + 1):
                if out[j]:
                    out[j] = self.corrected(bits, out[j])
            self.run -= 1


def read_scan(data: bytes, planes: list[Plane], scan: Scan, restart: int) -> None:
    """All blocks of a scan. One plane alone has only its own blocks, without padding."""
    if len(planes) == 1:
        p = planes[0]
        units = [[(0, 64 * (y * p.across + x))] for y in range(p.own_down) for x in range(p.own_across)]
    else:
        wide, high = planes[0].across // planes[0].nx, planes[0].down // planes[0].ny
        inner = [(c, y, x) for c, p in enumerate(planes) for y in range(p.ny) for x in range(p.nx)]
        units = [[(c, 64 * ((v * planes[c].ny + y) * planes[c].across + u * planes[c].nx + x)) for c, y, x in inner] for v in range(high) for u in range(wide)]
    stretches = split_restarts(data) if restart else [data]
    per = restart or len(units)
    for k, stretch in enumerate(stretches):
        bits, before = Bits(stretch.replace(b"\xff\0", b"\xff")), [0] * len(planes)
        scan.run = 0
        for unit in units[k * per : (k + 1) * per]:
            for c, at in unit:
                scan.block(bits, planes[c], c, at, before)


def entropy_end(data: bytes, at: int) -> int:
    """Where the next mark stands that is neither stuffing nor a restart."""
    while (at := data.find(b"\xff", at)) >= 0:
        after = data[at + 1] if at + 1 < len(data) else 0
        if after and not 0xD0 <= after <= 0xD7:
            return at
        at += 2
    return len(data)


def decode(data: bytes) -> Decoded:
    at, quant, huff, planes, restart, exif, icc, adobe = 2, {}, {}, [], 0, None, [], None
    h = w = scans = 0
    progressive = False
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        mark = data[at + 1] if at + 1 < len(data) and data[at] == 0xFF else None
        if mark == 0xD9 or (mark is None and scans):
            break
        if mark is None or at + 4 > len(data):
            raise CodecError("the JPEG's segments end early")
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide, number = body[k] >> 4, body[k] & 15
                quant[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float64)
                k += 1 + 64 * (1 + (wide > 0))
        elif mark == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huff[body[k]] = lookup(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif mark in (0xC0, 0xC1, 0xC2):
            if body[0] != 8:
                raise CodecError("only JPEG of 8 bits is read")
            progressive, (h, w) = mark == 0xC2, struct.unpack(">HH", body[1:5])
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            if len(parts) not in (1, 3) or not h or not w:
                raise CodecError("only JPEG of one or three planes is read")
            parts = [(p[0], 1, 1, p[3]) for p in parts] if len(parts) == 1 else parts
            frame = (h, w, max(p[1] for p in parts), max(p[2] for p in parts))
            planes = [Plane(*p, frame) for p in parts]
        elif 0xC3 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise CodecError("only baseline and progressive JPEG is read")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xE1 and body.startswith(b"Exif\0\0"):
            exif = body[6:]
        elif mark == 0xE2 and body.startswith(b"ICC_PROFILE\0"):
            icc.append((body[12], body[14:]))
        elif mark == 0xEE and body.startswith(b"Adobe"):
            adobe = body[11]
        elif mark == 0xDA:
            named = {p.name: p for p in planes}
            chosen = [(named.get(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0])]
            if not chosen or any(p is None for p, _ in chosen):
                raise CodecError("a scan without its frame")
            first, last, bit = body[1 + 2 * len(chosen) : 4 + 2 * len(chosen)]
            scan = Scan([huff.get(t >> 4) for _, t in chosen], [huff.get(0x10 | t & 15) for _, t in chosen], first, min(last, 63), bit >> 4, bit & 15, progressive)
            end = entropy_end(data, at)
            read_scan(data[at:end], [p for p, _ in chosen], scan, restart)
            at, scans = end, scans + 1
    if not scans:
        raise CodecError("a JPEG without a scan")
    made = []
    most_x, most_y = max(p.nx for p in planes), max(p.ny for p in planes)
    for p in planes:
        zz = np.array(p.cells, np.float64).reshape(-1, 64) * quant[p.quant]
        flat = np.empty_like(zz)
        flat[:, ZIGZAG] = zz
        blocks = BASIS.T @ flat.reshape(-1, 8, 8) @ BASIS
        plane = blocks.reshape(p.down, p.across, 8, 8).transpose(0, 2, 1, 3).reshape(p.down * 8, p.across * 8) + 128.0
        made.append(plane.repeat(most_y // p.ny, axis=0).repeat(most_x // p.nx, axis=1)[:h, :w])
    if len(made) == 3 and adobe != 0:
        y, cb, cr = made[0], made[1] - 128.0, made[2] - 128.0
        made = [y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb]
    px = np.clip(np.rint(np.stack(made, axis=2)), 0, 255).astype(np.int64)
    profile = b"".join(p for _, p in sorted(icc)) or None
    return Decoded(px, 8, "L8" if len(made) == 1 else "Rgb8", exif, profile)


def split_restarts(data: bytes) -> list[bytes]:
    out, begin, at = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append(data[begin:at])
            begin = at + 2
        at += 2
    return [*out, data[begin:]]
