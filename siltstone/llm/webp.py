"""Lossless WebP: a complete reader of the format, a writer for byte payloads, and column operators over both.

The reader takes canonical prefix codes (simple and normal), several code groups by an entropy image, back-references
with the two-dimensional distance codes, the colour cache, and inverts the predictor, cross-colour, subtract-green and
palette transforms. Literals of an image with one channel and one group of codes are read several at a time, from a
table of all next bits; other images are read symbol by symbol.

The writer makes grey images, a payload byte a pixel, 64 wide. Payloads of at most 16 different bytes are stored by a
palette with several pixels a sample; others subtract green, so one channel is left, after a predictor where that lowers the
entropy. Repeats of LEAST bytes or more become back-references, the rest literals, all by prefix codes of at most LIMIT
bits. A colour cache or cross-colour transform has nothing to gain in one channel; the reader knows them all the same.
A payload is cut into images of at most 64 x 16384 pixels, whose files stand one after another.

Defined cases: null and empty texts give 64 zero bytes; texts of any length are stored whole; equal texts give equal values;
repeated rows are independent; an empty table gives an empty result; input columns named like new ones are replaced by
those; damaged streams raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import free_name, table

WIDTH, MAX_HEIGHT, LEAST, LIMIT = 64, 16384, 8, 9
PLACE, SPREAD = np.uint64((1 << 20) - 1), np.uint64(0x9E3779B97F4A7C15)  # low bits of a sort key that hold the place in an image

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = 0x1E35A7BD


class Bits:
    """Bits of a stream, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        a, end = self.at >> 3, self.at + n
        if end > 8 * len(self.data):
            raise ValueError("the stream ends early")
        v = int.from_bytes(self.data[a : (end + 7) >> 3], "little") >> (self.at & 7)
        self.at = end
        return v & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        """The next n bits, as if zeros followed the stream."""
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 4], "little") >> (self.at & 7) & ((1 << n) - 1)


@lru_cache(maxsize=16)
def reversed_bits(n: int) -> np.ndarray:
    """The numbers below 2 ** n with their n bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class Code:
    """A canonical prefix code by its lengths (by symbol; 0: not used); one symbol alone takes no bits.

    `symbols` and `sizes` give, by the next `wide` bits, the symbol and how many bits it takes.
    """

    def __init__(self, lengths: np.ndarray | list[int], used: list[int] | None = None):
        lengths = np.asarray(lengths)
        self.used = lengths.nonzero()[0].tolist() if used is None else used
        if len(self.used) < 2:
            self.wide, self.symbols, self.sizes = 0, np.array(self.used or [0]), np.zeros(1, np.int64)
            return
        size = lengths[self.used]
        order = size.argsort(kind="stable")
        size = size[order]
        self.wide = int(size[-1])
        share = 1 << (self.wide - size)
        if self.wide > 15 or share.sum() != 1 << self.wide:
            raise ValueError("an incomplete prefix code")
        at = reversed_bits(self.wide)
        self.symbols, self.sizes = np.repeat(np.array(self.used)[order], share)[at], np.repeat(size, share)[at]

    def read(self, bits: Bits) -> int:
        i = bits.peek(self.wide)
        bits.at += int(self.sizes[i])
        return int(self.symbols[i])


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        n, wide = bits.read(1) + 1, bits.read(1)
        symbols = sorted({bits.read(8 if wide else 1), *([bits.read(8)] if n == 2 else [])})
        return Code([1] * (symbols[-1] + 1), symbols)
    first = [0] * 19
    for k in range(bits.read(4) + 4):
        first[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    symbols, sizes, mask = code.symbols.tolist(), code.sizes.tolist(), (1 << code.wide) - 1
    # the code's own bits as one number; no length takes more than 14
    a = bits.at >> 3
    held = int.from_bytes(bits.data[a : a + 2 * size + 8], "little") >> (bits.at & 7)
    used, at, last, lengths = 0, 0, 8, [0] * size
    while at < size and left > 0:
        left -= 1
        i = held & mask
        s, n = symbols[i], sizes[i]
        held >>= n
        used += n
        if s < 16:
            lengths[at] = s
            last = s or last
            at += 1
            continue
        extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
        n = least + (held & ((1 << extra) - 1))
        held >>= extra
        used += extra
        if at + n > size:
            raise ValueError("too many code lengths")
        if s == 16:
            lengths[at : at + n] = [last] * n
        at += n
    bits.at += used
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    return Code(lengths)


#: By the symbol of a length or distance code: its bits beyond the symbol, their mask, and the least it stands for.
EXTRA = [max(0, (p - 2) >> 1) for p in range(40)]
MASK = [(1 << n) - 1 for n in EXTRA]
BASE = [p + 1 if p < 4 else ((2 + (p & 1)) << EXTRA[p]) + 1 for p in range(40)]


def _prefixed(p: int, bits: Bits) -> int:
    return BASE[p] + bits.read(EXTRA[p])


def _back(code: int, width: int) -> int:
    """Pixels back, by distance code."""
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _several(code: Code) -> tuple[list[int], list[bytes]]:
    """By the next bits: how many of them the literals take that end within them, three at most, and these; no literals and
    the bits of the first symbol where that is a reference."""
    i, mask = np.arange(1 << code.wide), (1 << code.wide) - 1
    first, used = code.symbols, code.sizes.copy()
    count = (first < 256).astype(np.int64)
    values = [np.minimum(first, 255)]
    for k in (1, 2):
        j = i >> used & mask
        more = (count == k) & (used + code.sizes[j] <= code.wide) & (code.symbols[j] < 256) & (code.sizes[j] > 0)
        values.append(np.where(more, code.symbols[j], 0) & 255)
        used, count = np.where(more, used + code.sizes[j], used), count + more
    raw = np.stack(values, 1).astype(np.uint8).tobytes()
    return used.tolist(), [raw[3 * a : 3 * a + n] for a, n in enumerate(count.tolist())]


def _read_green(bits: Bits, codes: list[Code], n: int, width: int) -> bytearray:
    """The green samples of an image whose other channels and group of codes are one: literals by the few at a time, and references."""
    a = bits.at >> 3
    raw = np.frombuffer(bits.data[a:] + b"\0" * 16, np.uint8).astype(np.uint32)
    words = (raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)).tolist()
    green, back = codes[0], codes[4]
    symbols, sizes, mask = green.symbols.tolist(), green.sizes.tolist(), (1 << green.wide) - 1
    # a table of several literals pays for itself in longer images
    many = 3 if n > 4096 else 1
    steps, literals = _several(green) if many > 1 else (sizes, [])
    back_symbols, back_sizes, back_mask = back.symbols.tolist(), back.sizes.tolist(), (1 << back.wide) - 1
    out, p, left = bytearray(), bits.at & 7, n
    add = out.append
    try:
        while left > 0:
            if many == 1:
                for _ in range(left):
                    i = words[p >> 3] >> (p & 7) & mask
                    x = symbols[i]
                    if x > 255:
                        break
                    add(x)
                    p += sizes[i]
                else:
                    break
            else:
                for _ in range(left // many):  # none of these can pass the end of the image
                    i = words[p >> 3] >> (p & 7) & mask
                    x = literals[i]
                    if not x:
                        break
                    out += x
                    p += steps[i]
            left = n - len(out)
            i = words[p >> 3] >> (p & 7) & mask
            if symbols[i] < 256:
                if 0 < left < many:
                    add(symbols[i])
                    p += sizes[i]
                    left -= 1
                continue
            if not left:
                break
            p += sizes[i]
            s = symbols[i] - 256
            if s >= 24:
                raise ValueError("no such colour")
            length = BASE[s]
            if s > 3:
                length += words[p >> 3] >> (p & 7) & MASK[s]
                p += EXTRA[s]
            i = words[p >> 3] >> (p & 7) & back_mask
            p += back_sizes[i]
            s = back_symbols[i]
            d = BASE[s]
            if s > 3:
                d += words[p >> 3] >> (p & 7) & MASK[s]
                p += EXTRA[s]
            d = d - 120 if d > 120 else _back(d, width)
            at = len(out) - d
            if at < 0 or length > left:
                raise ValueError("a reference outside the image")
            out += out[at : at + length] if d >= length else (out[at:] * (length // d + 1))[:length]
            left -= length
    except IndexError:
        raise ValueError("the stream ends early") from None
    bits.at = 8 * a + p
    if bits.at > 8 * len(bits.data):
        raise ValueError("the stream ends early")
    return out


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image: uint32 ARGB, flat."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    n, groups, of, tile = width * height, 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        of = ((read_pixels(bits, across, (height + (1 << tile) - 1) >> tile, False) >> 8) & 0xFFFF).tolist()
        groups = max(of) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, s) for s in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits and not any(c.wide for c in codes[0][1:4]):
        red, blue, alpha = (int(c.symbols[0]) for c in codes[0][1:4])
        return np.frombuffer(_read_green(bits, codes[0], n, width), np.uint8).astype(np.uint32) << 8 | np.uint32(alpha << 24 | red << 16 | blue)
    out, cache, at = [0] * n, [0] * (1 << cache_bits), 0
    across = (width + (1 << tile) - 1) >> tile

    def put(v: int) -> None:
        nonlocal at
        out[at] = v
        at += 1
        if cache_bits:
            cache[(HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    while at < n:
        code = codes[of[(at // width >> tile) * across + (at % width >> tile)]] if of else codes[0]
        s = code[0].read(bits)
        if s < 256:
            r, b, al = code[1].read(bits), code[2].read(bits), code[3].read(bits)
            put(al << 24 | r << 16 | s << 8 | b)
        elif s < 280:
            length, d = _prefixed(s - 256, bits), _back(_prefixed(code[4].read(bits), bits), width)
            if d > at or at + length > n:
                raise ValueError("a reference outside the image")
            for _ in range(length):
                put(out[at - d])
        else:
            put(cache[s - 280])
    return np.array(out, np.uint32)


def _split(p: np.ndarray) -> np.ndarray:
    return np.stack([p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255], -1).astype(np.int64)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left, top, top_left, top_right):
    """The predicted ARGB channels (last axis) by a mode that needs nothing to the left."""
    if mode in (2, 3, 4):
        return (top, top_right, top_left)[mode - 2]
    if mode in (8, 9):
        return (top_left + top, top + top_right)[mode - 8] >> 1
    return np.array([255, 0, 0, 0])


def _predict_pixel(mode: int, l, t, tl, tr) -> list[int]:
    """The predicted channels of one pixel, for the modes that need the pixel to its left."""
    if mode == 5:
        return [(((a + d) >> 1) + b) >> 1 for a, b, d in zip(l, t, tr, strict=True)]
    if mode == 6:
        return [(a + c) >> 1 for a, c in zip(l, tl, strict=True)]
    if mode == 7:
        return [(a + b) >> 1 for a, b in zip(l, t, strict=True)]
    if mode == 10:
        return [(((a + c) >> 1) + ((b + d) >> 1)) >> 1 for a, b, c, d in zip(l, t, tl, tr, strict=True)]
    if mode == 11:
        to_left, to_top = sum(abs(b - c) for b, c in zip(t, tl, strict=True)), sum(abs(a - c) for a, c in zip(l, tl, strict=True))
        return l if to_left < to_top else t
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(l, t, tl, strict=True)]
    means = [((a + b) >> 1, c) for a, b, c in zip(l, t, tl, strict=True)]
    return [min(255, max(0, m + (m - c) // 2 if m >= c else m - ((c - m) >> 1))) for m, c in means]


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, width: int, height: int, tile: int) -> np.ndarray:
    """Row by row; within a row, tiles whose mode looks only above are added at once, those of the left pixel as running
    sums, and only the other modes go pixel by pixel."""
    c = _split(pixels).reshape(height, width, 4)
    across = (width + (1 << tile) - 1) >> tile
    mode = (modes >> 8 & 15).reshape(-1, across)
    c[0, 0] = (c[0, 0] + [255, 0, 0, 0]) & 255
    c[0] = c[0].cumsum(0) & 255
    for y in range(1, height):
        row, above = c[y], c[y - 1]
        row[0] = (row[0] + above[0]) & 255
        right = np.concatenate([above[1:], row[:1]])  # above and to the right; the row's own first pixel for the last one
        for k, m in enumerate(mode[y >> tile].tolist()):
            a, b = max(1, k << tile), min(width, (k + 1) << tile)
            if a >= b:
                continue
            if m in (0, 2, 3, 4, 8, 9, 14, 15):
                row[a:b] = (row[a:b] + predict(m, None, above[a:b], above[a - 1 : b - 1], right[a:b])) & 255
            elif m == 1:
                row[a:b] = (row[a - 1] + row[a:b].cumsum(0)) & 255
            else:
                left, own = row[a - 1].tolist(), row[a:b].tolist()
                top, corner, far = above[a:b].tolist(), above[a - 1 : b - 1].tolist(), right[a:b].tolist()
                for i, r in enumerate(own):
                    own[i] = left = [(x + p) & 255 for x, p in zip(r, _predict_pixel(m, left, top[i], corner[i], far[i]), strict=True)]
                row[a:b] = own
    return _join(c).reshape(-1)


def undo_cross_colour(pixels: np.ndarray, elements: np.ndarray, width: int, height: int, tile: int) -> np.ndarray:
    c, across = _split(pixels), (width + (1 << tile) - 1) >> tile
    at = np.arange(width * height)
    e = _split(elements)[(at // width >> tile) * across + (at % width >> tile)]
    signed = lambda v: (v & 255 ^ 128) - 128
    delta = lambda t, v: signed(t) * signed(v) >> 5
    red = (c[:, 1] + delta(e[:, 3], c[:, 2])) & 255
    c[:, 3] = (c[:, 3] + delta(e[:, 2], c[:, 2]) + delta(e[:, 1], red)) & 255
    c[:, 1] = red
    return _join(c)


def undo_palette(pixels: np.ndarray, palette: np.ndarray, width: int, height: int, packed: int) -> np.ndarray:
    index = (pixels >> 8 & 255).reshape(height, -1)
    if packed:
        each = 8 >> packed
        shifts = np.arange(1 << packed, dtype=np.uint32) * each
        index = (index[:, :, None] >> shifts & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    return np.concatenate([palette, np.zeros(256, np.uint32)])[index.reshape(-1)]


def decode_stream(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, flat uint32 ARGB) of one image's stream."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, seen, inner = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind < 2:
            tile = bits.read(3) + 2
            image = read_pixels(bits, (inner + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False)
            undo.append((undo_predictor if kind == 0 else undo_cross_colour, (image, inner, height, tile)))
        elif kind == 2:
            undo.append((lambda p: (p & 0xFF00FF00) | (p + (p >> 8 & 255) * 0x10000 & 0xFF0000) | (p + (p >> 8 & 255) & 255), ()))
        else:
            size = bits.read(8) + 1
            palette = _join(_split(read_pixels(bits, size, 1, False)).cumsum(0) & 255)
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((undo_palette, (palette, inner, height, packed)))
            inner = (inner + (1 << packed) - 1) >> packed
    pixels = read_pixels(bits, inner, height, True)
    for f, args in reversed(undo):
        pixels = f(pixels, *args)
    return width, height, pixels


def images(media: bytes) -> list[tuple[int, int, np.ndarray]]:
    """All images of a media value: one or more files, one after another."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        size = struct.unpack_from("<I", media, at + 16)[0]
        out.append(decode_stream(media[at + 20 : at + 20 + size]))
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return out


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of the best prefix code for the counts (Huffman's), at most limit; counts are flattened until it fits."""
    out, used = np.zeros(len(counts), np.int64), counts.nonzero()[0]
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weights, kind="stable")
        n = len(order)
        # beyond the last leaf and the last sum stand weights that are never the lightest
        leaves, sums = [*weights[order].tolist(), 1 << 60], [1 << 61] * n
        parent, i, j = [0] * (2 * n - 1), 0, 0
        for k in range(n - 1):  # a node above the two lightest of the leaves and sums not yet under one
            a, b = leaves[i], sums[j]
            if a <= b:
                parent[i] = n + k
                i += 1
                one, a = a, leaves[i]
            else:
                parent[n + j] = n + k
                j += 1
                one, b = b, sums[j]
            if a <= b:
                parent[i] = n + k
                i += 1
                sums[k] = one + a
            else:
                parent[n + j] = n + k
                j += 1
                sums[k] = one + b
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            out[used[order]] = depth[:n]
            return out
        weights = weights + (int(weights.sum()) >> (limit - 1)) // 2 + 1


def _codes(lengths: np.ndarray) -> np.ndarray:
    """By symbol, the canonical code with its first bit lowest."""
    out, used = np.zeros(len(lengths), np.int64), lengths.nonzero()[0]
    if len(used) > 1:
        size = lengths[used]
        order = size.argsort(kind="stable")
        order, size = used[order], size[order]
        wide = int(size[-1])
        start = np.cumsum(1 << (wide - size)) - (1 << (wide - size))
        out[order] = reversed_bits(wide)[start]
    return out


def _runs_of_lengths(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(symbol, extra value, extra bits) that write code lengths: 16 repeats the last one, 17 and 18 are zeros."""
    out = []
    for v, run in groupby(lengths.tolist()):
        n = len(list(run))
        if v:
            out.append((v, 0, 0))
            n -= 1
        while n >= 3:
            low, high, symbol, extra = (3, 6, 16, 2) if v else (11, 138, 18, 7) if n >= 11 else (3, 10, 17, 3)
            take = min(n, high)
            out.append((symbol, take - low, extra))
            n -= take
        out += [(v, 0, 0)] * n
    return out


def _code_fields(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(value, bits) that write a code."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and all(s < 256 for s in used):
        first, *second = used or [0]
        return [(1, 1), (len(second), 1), (1, 1), (first, 8), *((s, 8) for s in second)]
    runs = _runs_of_lengths(lengths)
    inner = code_lengths(np.bincount([s for s, _, _ in runs], minlength=19), 7)
    code, one = _codes(inner).tolist(), (inner > 0).sum() == 1
    count = max(4, 1 + max(k for k, s in enumerate(LENGTH_ORDER) if inner[s]))
    out = [(0, 1), (count - 4, 4), *((int(inner[s]), 3) for s in LENGTH_ORDER[:count]), (0, 1)]
    for s, value, extra in runs:
        if not one:
            out.append((code[s], int(inner[s])))
        if extra:
            out.append((value, extra))
    return out


def _packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Fields of at most 18 bits one after another, lowest bit first."""
    at = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    # fields do not overlap, so sums of shifted values are exact
    word = np.bincount(at >> 5, weights=(values << (at & 31)).astype(np.float64), minlength=(total >> 5) + 2).astype(np.int64)
    word[1:] += word[:-1] >> 32
    return (word & 0xFFFFFFFF).astype("<u4").tobytes()[: (total + 7) >> 3]


def repeats(samples: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, distance) of the repeats to write as references, in order and apart: greedy along stretches in
    which each place's last earlier place with the same `least` samples is equally far."""
    if len(samples) <= 8:
        return []
    x = np.ascontiguousarray(samples)
    key = np.ndarray((len(x) - 7,), "<u8", x, 0, (1,)) & np.uint64((1 << 8 * least) - 1)  # the samples from each place, 8 at most
    order = (np.sort((key * SPREAD & ~PLACE) | np.arange(len(key), dtype=np.uint64)) & PLACE).astype(np.int64)
    same = key[order[1:]] == key[order[:-1]]
    far = np.zeros(len(key), np.int64)
    far[order[1:][same]] = (order[1:] - order[:-1])[same]
    edge = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]]))
    last = np.append(edge[1:], len(far)) - 1
    keep = far[edge] > 0
    out, now = [], 0
    for a, b, d in zip(edge[keep].tolist(), last[keep].tolist(), far[edge[keep]].tolist(), strict=True):
        a = max(a, now)
        if a <= b:
            now = b + least
            if now - a <= 4096:
                out.append((a, now - a, d))
            else:
                out += [(k, min(4096, now - k), d) for k in range(a, now, 4096)]
    return out


def _prefix_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of lengths or distance codes from 1."""
    v = v - 1
    high = np.log2(np.maximum(v, 1)).astype(np.int64)
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), v & ((1 << extra) - 1), extra


@lru_cache(maxsize=1)
def _known_prefixes() -> np.ndarray:
    return np.stack(_prefix_of(np.arange(1, 1 << 16)))


def _prefixes(v: np.ndarray) -> np.ndarray:
    """As _prefix_of, looked up where all are small."""
    known = _known_prefixes()
    return known[:, v - 1] if v.max(initial=0) <= known.shape[1] else np.stack(_prefix_of(v))


def _entropy(samples: np.ndarray) -> float:
    n = np.bincount(samples)
    n = n[n > 0]
    return float((n * (np.log2(len(samples)) - np.log2(n))).sum())


def _image_fields(green: np.ndarray, alpha: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Of a main image whose pixels differ in green alone: the fields of its codes, and the values and sizes of its pixels."""
    found = repeats(green)
    start, length, far = np.array(found, np.int64).reshape(-1, 3).T
    within = np.zeros(len(green) + 1, np.int8)
    within[start] = 1
    within[start + length] -= 1
    plain = np.flatnonzero(within[:-1].cumsum(dtype=np.int8) == 0)
    (ls, lv, le), (ds, dv, de) = _prefixes(length), _prefixes(far + 120)
    first = code_lengths(np.bincount(np.concatenate([green[plain].astype(np.int64), 256 + ls]), minlength=280), LIMIT)
    back = code_lengths(np.bincount(ds, minlength=40), LIMIT)
    sizes = lambda lengths: lengths if (lengths > 0).sum() > 1 else np.zeros_like(lengths)
    codes, width, back_codes, back_width = _codes(first), sizes(first), _codes(back), sizes(back)
    # one field for a literal, four for a reference
    at = np.arange(len(plain)) + 4 * np.searchsorted(start, plain)
    here = np.searchsorted(plain, start) + 4 * np.arange(len(start))
    values, bits = np.empty((2, len(plain) + 4 * len(start)), np.int64)
    values[at], bits[at] = codes[green[plain]], width[green[plain]]
    for k, (v, n) in enumerate(((codes[256 + ls], width[256 + ls]), (lv, le), (back_codes[ds], back_width[ds]), (dv, de))):
        values[here + k], bits[here + k] = v, n
    other = lambda v: [(1, 1), (0, 1), (1, 1), (v, 8)]
    return [(0, 1), (0, 1), *_code_fields(first), *other(0), *other(0), *other(alpha), *_code_fields(back)], values, bits


def encode_samples(samples: np.ndarray, width: int = WIDTH) -> bytes:
    """One lossless WebP file of grey samples, rows of `width`."""
    height = len(samples) // width
    fields = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)]
    one = lambda v: [(1, 1), (0, 1), (1, 1), (v, 8)]  # noqa: E731  a code of one symbol
    used = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(used) <= 16:
        packed = 3 if len(used) <= 2 else 2 if len(used) <= 4 else 1
        step = np.diff(used, prepend=0)
        steps = code_lengths(np.bincount(step, minlength=280), LIMIT)
        colour, size = _codes(steps), steps if (steps > 0).sum() > 1 else np.zeros_like(steps)
        # the palette: grey steps, each channel by the same code; alpha 255 at the first, then 0
        alpha = code_lengths(np.bincount([255] + [0] * (len(used) - 1), minlength=256), LIMIT)
        alpha_code, alpha_size = _codes(alpha), alpha if len(used) > 1 else np.zeros_like(alpha)
        fields += [(1, 1), (3, 2), (len(used) - 1, 8), (0, 1), *_code_fields(steps), *_code_fields(steps[:256]), *_code_fields(steps[:256]), *_code_fields(alpha), *one(0)]
        for k, v in enumerate(step.tolist()):
            a = 0 if k else 255
            fields += [(int(colour[v]), int(size[v]))] * 3 + [(int(alpha_code[a]), int(alpha_size[a]))]
        index = np.searchsorted(used, samples).reshape(height, width >> packed, 1 << packed)
        green, opaque = (index << (np.arange(1 << packed) * (8 >> packed))).sum(2).reshape(-1).astype(np.uint8), 0
    else:
        rows = samples.reshape(height, width)
        left = rows.copy()
        left[:, 1:] -= rows[:, :-1]
        left[1:, 0] -= rows[:-1, 0]
        green, opaque = samples, 255
        if _entropy(left.reshape(-1)) < 0.9 * _entropy(samples):
            green, opaque = left.reshape(-1), 0
            fields += [(1, 1), (0, 2), (7, 3), (0, 1), *one(1), *one(0), *one(0), *one(255), *one(0)]  # tiles of 512, all of the left pixel
        fields += [(1, 1), (2, 2)]
    codes, values, bits = _image_fields(green, opaque)
    fields += [(0, 1), *codes]
    head, size = np.fromiter(chain.from_iterable(fields), np.int64, 2 * len(fields)).reshape(-1, 2).T
    data = _packed(np.concatenate([head, values]), np.concatenate([size, bits]))
    body = b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def encode_payload(payload: bytes) -> bytes:
    """Files of the payload; its length is a positive multiple of 64."""
    samples = np.frombuffer(payload, np.uint8)
    step = WIDTH * MAX_HEIGHT
    return b"".join(encode_samples(samples[a : a + step]) for a in range(0, len(samples), step))


def decode_payload(media: bytes) -> bytes:
    """The green samples of all images."""
    return b"".join((p >> 8 & 255).astype(np.uint8).tobytes() for _, _, p in images(media))


BANDS = np.arange(65)
NEXT = np.arange(1, 65) % 64


def feature_of(payload: bytes) -> str:
    """16 band means of the samples and a difference hash over 64 bands, in hex."""
    a = np.frombuffer(payload, np.uint8)
    edge = BANDS * len(a) // 64
    means = np.add.reduceat(a, edge[:-1], dtype=np.int64) / (edge[1:] - edge[:-1])
    sign = np.packbits(means[NEXT] > means).tobytes().hex()
    return bytes(means.reshape(16, 4).mean(1).astype(np.uint8)).hex() + ":" + sign


def _digests(batches, schema: pa.Schema):
    for batch in batches:
        rows = []
        for x in batch.column(1):
            n, payload = payload_of(x.as_py())
            media = encode_payload(payload)
            back = decode_payload(media)
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(back)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)


def _stored(batches, column: str, schema: pa.Schema):
    for batch in batches:
        media = pa.array([encode_payload(payload_of(x.as_py())[1]) for x in batch.column(column)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), media], schema=schema)


def _read_back(batches, column: str, schema: pa.Schema):
    for batch in batches:
        found = [[{"width": w, "height": h, "pixels": p.astype(">u4").tobytes()} for w, h, p in images(x.as_py() or b"")] for x in batch.column(column)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), pa.array(found, schema.field(-1).type)], schema=schema)


def _with(df: DataFrame, out: str, kind: str, f) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([*df.schema.fields, StructField(free_name(df, out), _parse_datatype_string(kind))])
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda it: f(it, arrow), schema)


def to_webp(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with its text stored as lossless WebP in a binary column `out`, with underscores after it where df has such a column."""
    return _with(df, out, "binary", lambda it, schema: _stored(it, text, schema))


def from_webp(df: DataFrame, media: str = "media", out: str = "images") -> DataFrame:
    """df with a list of width, height and the pixel array (bytes, ARGB) of each image stored in `media` (null: none), in `out`, with
    underscores after it where df has such a column."""
    return _with(df, out, "array<struct<width:int,height:int,pixels:binary>>", lambda it, schema: _read_back(it, media, schema))


def media_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and describe both."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType
    names = [("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    schema = pa.schema([pa.field("doc_id", to_arrow_type(kind)), *(pa.field(n, pa.int64() if t == "long" else pa.string()) for n, t in names)])
    return rows.mapInArrow(lambda it: _digests(it, schema), f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in names))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: digests of the stored form of every document's text."""
    return media_digests(table(spark, sf_dir, "documents"))
