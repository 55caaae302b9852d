"""Lossless WebP: a decoder of the whole format and an encoder for payloads, as media columns.

The decoder reads prefix codes (simple and normal, with meta codes), back-references with the
two-dimensional distance map and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. Images are decoded together: a step reads one token of
each from tables of their codes, so that a step's cost is shared by all; only images with meta
codes are read token by token.

The encoder stores bytes as the red, green and blue samples of images 64 pixels wide. Images of
few colours get a palette; those whose samples often equal the one above get a predictor (the
best of those that look at the row above) and cross-colour factors, if that takes fewer bits;
what repeats becomes back-references, what the colour cache holds its symbols, and the rest
prefix codes by frequency. A long payload is stored as several images
of ``MAX_ROWS`` rows, one after the other.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType

WIDTH = 64
UNIT = WIDTH * 3
MAX_ROWS = 32
#: Pixels of the images that are written or read together, about.
TOGETHER = 1_500_000

# Fixed values of the format: the order of code length codes, and the (x, y) of short distances.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40


class WebpError(ValueError):
    """The bytes are not a lossless WebP image that the format allows."""


class Bits:
    """Bits of a byte string, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        lo = self.at >> 3
        return (int.from_bytes(self.data[lo : lo + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def slice(self, at: int, n: int) -> int:
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise WebpError("the stream ends early")
        out = self.peek(n)
        self.at += n
        return out


@lru_cache(maxsize=16)
def _reversed_bits(width: int) -> np.ndarray:
    """For every number of ``width`` bits, the one with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate((out * 2, out * 2 + 1))
    return out


class PrefixCode:
    """A canonical prefix code; codes are read most significant bit first.

    ``table`` holds, for every value of the next ``width`` bits, symbol and code length in one number.
    """

    def __init__(self, width: int, table: np.ndarray):
        self.width, self.table = width, table
        self._items: list[int] | None = None

    @classmethod
    def of(cls, symbols: list[int], lengths: list[int]) -> PrefixCode:
        """The code in which these symbols, in order, have these lengths; one symbol alone takes no bits."""
        if len(symbols) < 2:
            return cls(0, np.array([symbols[0] << 4 if symbols else 0], np.int64))
        used, n = np.array(symbols, np.int64), np.array(lengths, np.int64)
        by = np.argsort(n, kind="stable")
        used, n = used[by], n[by]
        width = int(n[-1])
        spans = 1 << (width - n)
        if spans.sum() != 1 << width:
            raise WebpError("a prefix code is not complete")
        return cls(width, np.repeat(used << 4 | n, spans)[_reversed_bits(width)])

    def read(self, bits: Bits) -> int:
        if self._items is None:
            self._items = self.table.tolist()
        entry = self._items[bits.peek(self.width)]
        bits.at += entry & 15
        if bits.at > bits.end:
            raise WebpError("the stream ends early")
        return entry >> 4


_LENGTH_CODES: dict[tuple[int, ...], list[int]] = {}


def _length_table(own: tuple[int, ...]) -> list[int]:
    """For every value of the next 7 bits, the code length symbol and its bits in one number."""
    if own not in _LENGTH_CODES:
        if len(_LENGTH_CODES) > 256:
            _LENGTH_CODES.clear()
        code = PrefixCode.of([s for s, n in enumerate(own) if n], [n for n in own if n])
        _LENGTH_CODES[own] = np.tile(code.table, 1 << (7 - code.width)).tolist()
    return _LENGTH_CODES[own]


def _read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise WebpError("a symbol lies outside its alphabet")
        if len(set(symbols)) == 1:
            return PrefixCode(0, np.array([symbols[0] << 4], np.int64))
        return PrefixCode(1, np.array([s << 4 | 1 for s in sorted(symbols)], np.int64))
    own = [0] * len(CODE_LENGTH_ORDER)
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, at, previous = _length_table(tuple(own)), 0, 8
    symbols, lengths = [], []
    data, place, end = bits.data, bits.at, bits.end
    while at < alphabet and left:
        left -= 1
        lo = place >> 3
        word = (data[lo] | data[lo + 1] << 8 | data[lo + 2] << 16) >> (place & 7)
        entry = table[word & 127]
        s, n = entry >> 4, entry & 15
        if s == 0:
            at += 1
        elif s < 16:
            symbols.append(at)
            lengths.append(s)
            previous = s
            at += 1
        elif s == 17:
            at += 3 + (word >> n & 7)
            n += 3
        elif s == 18:
            at += 11 + (word >> n & 127)
            n += 7
        else:
            times = 3 + (word >> n & 3)
            symbols += range(at, at + times)
            lengths += [previous] * times
            at += times
            n += 2
        place += n
        if place > end:
            raise WebpError("the stream ends early")
    if at > alphabet:
        raise WebpError("code lengths run past their alphabet")
    bits.at = place
    return PrefixCode.of(symbols, lengths)


def _number(bits: Bits, prefix: int) -> int:
    """The length or distance that a prefix and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


class Stream:
    """An entropy-coded image whose codes are read and whose pixels are not."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.bits, self.width, self.total = bits, width, width * height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise WebpError("the colour cache is too large")
        groups, self.meta, self.tile = 1, None, 0
        if main and bits.read(1):
            self.tile = bits.read(3) + 2
            across, down = -(-width // (1 << self.tile)), -(-height // (1 << self.tile))
            self.meta = ((Stream(bits, across, down, False).pixels() >> 8) & 0xFFFF).reshape(down, across)
            groups = int(self.meta.max()) + 1
        sizes = (LITERALS + LENGTHS + ((1 << self.cache_bits) if self.cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
        self.codes = [self._group(sizes) for _ in range(groups)]

    def _group(self, sizes: tuple[int, ...]) -> list[PrefixCode]:
        """The five codes of a group; one that repeats the bits of the one before is that one."""
        bits, out, last = self.bits, [], (0, 0, 0)
        for size in sizes:
            at, known = bits.at, last[2] == size
            span = last[1] - last[0]
            if known and at + span <= bits.end and bits.slice(at, span) == bits.slice(last[0], span):
                bits.at += span
                out.append(out[-1])
            else:
                out.append(_read_code(bits, size))
                last = (at, bits.at, size)
        return out

    def pixels(self) -> np.ndarray:
        """ARGB numbers row by row, read token by token."""
        bits, at, out = self.bits, 0, [0] * self.total
        cache = [0] * (1 << self.cache_bits) if self.cache_bits else None
        shift = 32 - self.cache_bits
        while at < self.total:
            group = 0 if self.meta is None else int(self.meta[at // self.width >> self.tile, at % self.width >> self.tile])
            green, red, blue, alpha, far = self.codes[group]
            s = green.read(bits)
            if s < LITERALS:
                r = red.read(bits)
                b = blue.read(bits)
                fresh = [(alpha.read(bits) << 24) | (r << 16) | (s << 8) | b]
            elif s < LITERALS + LENGTHS:
                length = _number(bits, s - LITERALS)
                d = self.distance(_number(bits, far.read(bits)))
                if d > at or at + length > self.total:
                    raise WebpError("a back-reference leaves the image")
                fresh = (out[at - d : at] * (length // d + 1))[:length]
            else:
                fresh = [cache[s - LITERALS - LENGTHS]]
            out[at : at + len(fresh)] = fresh
            at += len(fresh)
            if cache is not None:
                for p in fresh:
                    cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = p
        return np.array(out, np.int64)

    def distance(self, code: int) -> int:
        """Pixels back that a distance code stands for."""
        if code > len(NEAR):
            return code - len(NEAR)
        x, y = NEAR[code - 1]
        return max(1, x + y * self.width)

    def resolved(self, symbols: np.ndarray, argb: np.ndarray, lengths: np.ndarray, far: np.ndarray) -> np.ndarray:
        """ARGB numbers of the image's tokens: literals in ``argb``, cache symbols, and back-references."""
        slots = (argb * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - self.cache_bits)
        copied = (symbols >= LITERALS) & (symbols < LITERALS + LENGTHS)
        if not copied.any():
            cached = np.flatnonzero(symbols >= LITERALS)
            if len(cached):  # each is the last literal before it that fell in its slot
                literal = np.flatnonzero(symbols < LITERALS)
                n = len(symbols)
                keys = np.sort(slots[literal] * n + literal)
                slot = symbols[cached] - LITERALS - LENGTHS
                at = np.searchsorted(keys, slot * n + cached) - 1
                known = (at >= 0) & (keys[np.maximum(at, 0)] // n == slot) if len(keys) else np.zeros(len(cached), bool)
                argb = argb.copy()
                argb[cached] = np.where(known, argb[keys[np.maximum(at, 0)] % n], 0) if len(keys) else 0
            return argb
        if not self.cache_bits:
            ends = np.cumsum(lengths)
            if ends[-1] > self.total:
                raise WebpError("a back-reference leaves the image")
            places = ends - lengths
            whole = np.zeros(self.total, np.int64)
            whole[places[~copied]] = argb[~copied]
            for at, length, code in zip(places[copied].tolist(), lengths[copied].tolist(), far[copied].tolist(), strict=True):
                d = self.distance(code)
                if d > at:
                    raise WebpError("a back-reference leaves the image")
                source = whole[at - d : at]
                whole[at : at + length] = source[:length] if d >= length else np.resize(source, length)
            return whole
        out: list[int] = []
        cache = [0] * (1 << self.cache_bits)
        shift = 32 - self.cache_bits
        for s, p, slot, length, code in zip(symbols.tolist(), argb.tolist(), slots.tolist(), lengths.tolist(), far.tolist(), strict=True):
            if s < LITERALS:
                out.append(p)
                cache[slot] = p
            elif s < LITERALS + LENGTHS:
                d = self.distance(code)
                if d > len(out) or len(out) + length > self.total:
                    raise WebpError("a back-reference leaves the image")
                fresh = (out[len(out) - d :] * (length // d + 1))[:length]
                out += fresh
                for q in fresh:
                    cache[(q * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = q
            else:
                out.append(cache[s - LITERALS - LENGTHS])
        return np.array(out, np.int64)


def _numbers(words: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_number`` for several streams: the numbers and the places after them."""
    extra = np.maximum((prefix - 2) >> 1, 0)
    more = (words[at >> 3] >> (at & 7)) & ((1 << extra) - 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + more) + 1, at + extra


def read_together(streams: list[Stream]) -> list[np.ndarray]:
    """The pixels of several streams without meta codes; a step reads one token of each."""
    if not streams:
        return []
    starts, blob, size = [], [], 0
    for s in streams:
        starts.append(8 * size + s.bits.at)
        blob.append(s.bits.data)
        size += len(s.bits.data)
    raw = np.frombuffer(b"".join([*blob, b"\0" * 512]), np.uint8).astype(np.int64)
    words = raw[:-4] | raw[1:-3] << 8 | raw[2:-2] << 16 | raw[3:-1] << 24 | raw[4:] << 32
    tables = [c.table for s in streams for c in s.codes[0]]
    sizes = np.array([len(t) for t in tables], np.int64)
    offset, mask, table = (np.cumsum(sizes) - sizes).reshape(-1, 5).T.copy(), (sizes - 1).reshape(-1, 5).T.copy(), np.concatenate(tables)
    at = np.array(starts, np.int64)
    end = at + np.array([s.bits.end - s.bits.at for s in streams])
    left = np.array([s.total for s in streams], np.int64)
    who = np.arange(len(streams), dtype=np.int16 if len(streams) < 1 << 15 else np.int64)
    ones, zeros = np.ones(len(streams), np.int64), np.zeros(len(streams), np.int64)
    seen: list[tuple[np.ndarray, ...]] = []
    clear = not mask[3].any()  # one alpha in each image, which takes no bits
    alpha = table[offset[3]] >> 4 << 24
    step = 0
    while len(who):
        entry = table[offset[0] + ((words[at >> 3] >> (at & 7)) & mask[0])]
        symbol = entry >> 4
        at = at + (entry & 15)
        literal = symbol < LITERALS
        every = bool(literal.all())
        argb = symbol << 8
        for channel, place in ((1, 16), (2, 0)) if clear else ((1, 16), (2, 0), (3, 24)):
            entry = table[offset[channel] + ((words[at >> 3] >> (at & 7)) & mask[channel])]
            argb |= entry >> 4 << place
            at = at + ((entry & 15) if every else (entry & 15) * literal)
        if clear:
            argb |= alpha
        length = far = None
        if not every:
            some = np.flatnonzero(~literal & (symbol < LITERALS + LENGTHS))
            if len(some):
                length, far = np.ones(len(who), np.int64), np.zeros(len(who), np.int64)
                length[some], then = _numbers(words, at[some], symbol[some] - LITERALS)
                entry = table[offset[4][some] + ((words[then >> 3] >> (then & 7)) & mask[4][some])]
                far[some], at[some] = _numbers(words, then + (entry & 15), entry >> 4)
        seen.append((who, symbol, argb, ones[: len(who)] if length is None else length, zeros[: len(who)] if far is None else far))
        left = left - (1 if length is None else length)
        goes_on = left > 0
        step += 1
        if not goes_on.all():
            if (at > end).any():
                raise WebpError("the stream ends early")
            who, at, end, left, alpha = who[goes_on], at[goes_on], end[goes_on], left[goes_on], alpha[goes_on]
            offset, mask = offset[:, goes_on], mask[:, goes_on]
        elif step % 16 == 0 and (at > end).any():
            raise WebpError("the stream ends early")
    who, *tokens = (np.concatenate(c) for c in zip(*seen, strict=True))
    order = np.argsort(who, kind="stable")
    cuts = np.cumsum(np.bincount(who, minlength=len(streams)))[:-1]
    return [s.resolved(*t) for s, t in zip(streams, zip(*(np.split(c[order], cuts) for c in tokens), strict=True), strict=True)]


def _channels(argb: np.ndarray) -> np.ndarray:
    """ARGB numbers as four columns of samples: alpha, red, green, blue."""
    return np.stack([(argb >> k) & 255 for k in (24, 16, 8, 0)], axis=-1)


def _predict(mode: int, left, top, right, corner):
    """The prediction of one pixel's four samples, from the neighbours' samples."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), top)
    if mode in (6, 7):
        return half(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return half(corner if mode == 8 else top, top if mode == 8 else right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(half(left, top), corner, strict=True)]
    return [255, 0, 0, 0]


def _from_above(mode: int, above: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The predictions of a row after its first pixel by a mode that looks at the row ``above`` alone."""
    if mode == 0:
        return np.broadcast_to(np.array([255, 0, 0, 0]), above[1:].shape)
    if mode == 2:
        return above[1:]
    if mode == 3:
        return right[1:]
    if mode == 4:
        return above[:-1]
    return (above[:-1] + above[1:]) >> 1 if mode == 8 else (above[1:] + right[1:]) >> 1


ABOVE = (0, 2, 3, 4, 8, 9)


def _right_of(above: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The upper right neighbours of a row: the last one's is the row's own first pixel."""
    return np.concatenate((above[1:], first[None]))


def unpredict(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Inverts the predictor transform; ``pixels`` is (rows, columns, 4) of alpha, red, green, blue.

    Rows whose modes look at the row above alone are inverted at once, others pixel by pixel.
    """
    rows, cols = pixels.shape[:2]
    out = pixels.copy()
    out[0, 0, 0] += 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, rows):
        own = modes[y >> tile]
        above = out[y - 1]
        out[y, 0] = (out[y, 0] + above[0]) & 255
        kinds = set(own.tolist())
        if kinds.issubset(ABOVE):
            right = _right_of(above, out[y, 0])
            if len(kinds) == 1:
                guess = _from_above(kinds.pop(), above, right)
            else:
                by = own[np.arange(1, cols) >> tile]
                guess = np.zeros((cols - 1, 4), np.int64)
                for k in kinds:
                    guess[by == k] = _from_above(k, above, right)[by == k]
            out[y, 1:] = (out[y, 1:] + guess) & 255
            continue
        row, up = out[y].tolist(), above.tolist()
        for x in range(1, cols):
            right = up[x + 1] if x + 1 < cols else row[0]
            p = _predict(int(own[x >> tile]), row[x - 1], up[x], right, up[x - 1])
            row[x] = [(a + b) & 255 for a, b in zip(row[x], p, strict=True)]
        out[y] = row
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def uncross(pixels: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    """Inverts the cross-colour transform; ``factors`` is the transform's own image."""
    rows, cols = pixels.shape[:2]
    f = _signed(factors[np.arange(rows)[:, None] >> tile, np.arange(cols)[None, :] >> tile])
    out = pixels.copy()
    green = _signed(out[..., 2])
    out[..., 1] = (out[..., 1] + ((f[..., 3] * green) >> 5)) & 255
    out[..., 3] = (out[..., 3] + ((f[..., 2] * green) >> 5) + ((f[..., 1] * _signed(out[..., 1])) >> 5)) & 255
    return out


def unpalette(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Inverts the palette transform, unpacking several indices from a pixel where the table is small."""
    packed = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
    x = np.arange(width)
    each = 8 >> packed
    index = (pixels[:, x >> packed, 2] >> ((x & ((1 << packed) - 1)) * each)) & ((1 << each) - 1)
    full = np.concatenate((table, np.zeros((256 - len(table), 4), np.int64)))
    return full[index]


class Image:
    """A lossless WebP file, read up to its pixels: the main stream and the transforms to undo."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25 or data[20] != 0x2F:
            raise WebpError("not a lossless WebP file")
        bits = Bits(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
        width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise WebpError("unknown version")
        self.undo, now = [], width
        down = lambda n, tile: (n + (1 << tile) - 1) >> tile
        while bits.read(1):
            kind = bits.read(2)
            if kind in [k for k, *_ in self.undo]:
                raise WebpError("a transform comes twice")
            if kind < 2:
                tile = bits.read(3) + 2
                side = _channels(Stream(bits, down(now, tile), down(self.height, tile), False).pixels()).reshape(down(self.height, tile), down(now, tile), 4)
                self.undo.append((kind, side, tile))
            elif kind == 2:
                self.undo.append((kind,))
            else:
                n = bits.read(8) + 1
                self.undo.append((kind, np.cumsum(_channels(Stream(bits, n, 1, False).pixels()), axis=0) & 255, now))
                now = down(now, 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0)
        self.width = now
        self.stream = Stream(bits, now, self.height, True)

    def undone(self, argb: np.ndarray) -> np.ndarray:
        """(rows, columns, 4) of alpha, red, green, blue, given the main stream's pixels."""
        out = _channels(argb).reshape(self.height, self.width, 4)
        for kind, *more in reversed(self.undo):
            if kind == 0:
                out = unpredict(out, more[0][..., 2] & 15, more[1])
            elif kind == 1:
                out = uncross(out, *more)
            elif kind == 2:
                out = out.copy()
                out[..., 1::2] = (out[..., 1::2] + out[..., 2:3]) & 255
            else:
                out = unpalette(out, *more)
        return out


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of several lossless WebP files: (rows, columns, 4) of alpha, red, green, blue."""
    out, images, pixels = [], [], 0
    for k, f in enumerate(files, 1):
        images.append(Image(f))
        pixels += images[-1].stream.total
        if pixels >= TOGETHER or k == len(files):
            read = iter(read_together([i.stream for i in images if i.stream.meta is None]))
            out += [i.undone(next(read) if i.stream.meta is None else i.stream.pixels()) for i in images]
            images, pixels = [], 0
    return out


def decode_one(data: bytes) -> np.ndarray:
    """The pixels of one lossless WebP file."""
    return decode_files([data])[0]


PARTS = ("predictor", "cross-colour", "green", "palette")


def parts_of(data: bytes) -> set[str]:
    """What the files in ``data`` make use of: transforms, ``cache``, ``back-references``, ``meta codes``, ``prefix codes``."""
    out = set()
    for image in map(Image, files_of(data)):
        out |= {PARTS[kind] for kind, *_ in image.undo}
        for codes in image.stream.codes:
            green = codes[0].table >> 4
            out |= {"back-references"} if ((green >= LITERALS) & (green < LITERALS + LENGTHS)).any() else set()
            out |= {"cache"} if (green >= LITERALS + LENGTHS).any() else set()
            out |= {"prefix codes"} if any(len(set((c.table & 15).tolist())) > 1 for c in codes) else set()
        out |= {"meta codes"} if image.stream.meta is not None else set()
    return out


def files_of(data: bytes) -> list[bytes]:
    """The files that stand one after the other in ``data``."""
    out, at = [], 0
    while at < len(data):
        size = 8 + struct.unpack("<I", data[at + 4 : at + 8])[0]
        out.append(data[at : at + size])
        at += size + (size & 1)
    return out


def decode(data: bytes) -> list[np.ndarray]:
    """The images that stand one after the other in ``data``."""
    return decode_files(files_of(data))


class BitWriter:
    """Collects fields: numbers of at most 31 bits, with how many bits each takes in the upper half."""

    def __init__(self) -> None:
        self.done: list[np.ndarray] = []
        self._open: list[int] = []

    def put(self, value: int, n: int) -> None:
        self._open.append(value | n << 32)

    def put_all(self, fields: np.ndarray) -> None:
        if self._open:
            self.done.append(np.array(self._open, np.int64))
            self._open = []
        self.done.append(fields)

    def fields(self) -> np.ndarray:
        """All fields, filled up to whole bytes."""
        self.put_all(np.empty(0, np.int64))
        out = np.concatenate(self.done)
        fill = -int((out >> 32).sum()) % 8
        return np.append(out, fill << 32) if fill else out


def _packed(writers: list[BitWriter]) -> list[bytes]:
    """The bytes of several writers, made together."""
    fields = [w.fields() for w in writers]
    flat = np.concatenate(fields)
    value, size = flat.astype(np.int32), (flat >> 32).astype(np.int32)
    lows = np.cumsum(size, dtype=np.int64)
    ends = (lows[np.cumsum([len(f) for f in fields]) - 1] >> 3).tolist()
    lows -= size
    out, raw = [], np.empty(0, np.uint8)
    cuts = np.searchsorted(lows, np.arange(0, int(lows[-1]) + 1, 1 << 17)).tolist()
    for lo, hi in zip(cuts, [*cuts[1:], len(size)], strict=True):  # so many bits at once
        some = size[lo:hi]
        within = np.arange(int(some.sum()), dtype=np.int32) - np.repeat((lows[lo:hi] - lows[lo]).astype(np.int32), some)
        raw = np.concatenate((raw, (np.repeat(value[lo:hi], some) >> within & 1).astype(np.uint8)))
        whole = len(raw) >> 3 << 3
        out.append(np.packbits(raw[:whole], bitorder="little").tobytes())
        raw = raw[whole:]
    data = b"".join(out)
    return [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]


#: Lengths of the code that code lengths are written with, the same in every file: no length and
#: runs of none are the commonest; longer codes than ``LONGEST`` are not made.
LENGTH_CODE = {0: 2, 17: 4, 18: 4} | dict.fromkeys(range(3, 10), 4) | dict.fromkeys((1, 2, 10, 11, 12, 13), 5)
LONGEST = 13
MODES = (2, 4, 8, 9)
CACHE_BITS = 8
#: Pixels that a back-reference copies at least, and at most.
LEAST_COPY, MOST_COPY = 4, 4096
#: Colours of an image with a palette at most, and the share of samples that equal the one above
#: from which on a predictor is tried.
PALETTE, ALIKE = 64, 0.15
_SIDE = 6  # tiles of 64 by 64


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete prefix code for at least two symbols, near to their frequencies."""
    used = np.flatnonzero(counts)
    used = used[np.argsort(-counts[used], kind="stable")]
    n = np.maximum(counts[used], -(-int(counts.sum()) >> (LONGEST - 1)))
    n = np.ceil(np.log2(n.sum() / n) - 1e-9).astype(np.int64).clip(1, LONGEST)
    left = (1 << LONGEST) - int((1 << (LONGEST - n)).sum())
    lengths = n.tolist()
    while left:  # what is left of the code space shortens codes, the commonest first
        for i, k in enumerate(lengths):
            if k > 1 and 1 << (LONGEST - k) <= left:
                left -= 1 << (LONGEST - k)
                lengths[i] = k - 1
    out = np.zeros(len(counts), np.int64)
    out[used] = lengths
    return out


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of symbols, their bits in the order in which they are written."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    width = int(lengths[used].max())
    starts = np.cumsum(1 << (width - lengths[used])) - (1 << (width - lengths[used]))
    out = np.zeros(len(lengths), np.int64)
    out[used] = _reversed_bits(width)[starts]  # leading bits of the code come first either way
    return out


_HEAD = [LENGTH_CODE.get(k, 0) for k in range(19)]
_HEAD_OF, _HEAD_SIZE = _codes(np.array(_HEAD)), np.array(_HEAD, np.int64)
_HEAD_CODES = _HEAD_OF.tolist()
#: What precedes the lengths: no simple code, the code for lengths, all of the alphabet.
_HEAD_BITS, _HEAD_LENGTH = (len(_HEAD) - 4) << 1 | sum(_HEAD[k] << (5 + 3 * i) for i, k in enumerate(CODE_LENGTH_ORDER)), 1 + 4 + 3 * len(_HEAD) + 1
_HEAD_BITS, _HEAD_LENGTH = [_HEAD_BITS & 0x3FFFFFFF, _HEAD_BITS >> 30 & 0x3FFFFFFF, _HEAD_BITS >> 60], [30, 30, _HEAD_LENGTH - 60]


def _gap_fields(most: int) -> np.ndarray:
    """For runs of up to ``most`` symbols without a code, the fields that are written for them."""
    values, sizes = np.zeros((most + 1, most // 138 + 2), np.int64), np.zeros((most + 1, most // 138 + 2), np.int64)
    for gap in range(most + 1):
        left, at = gap, 0
        while left >= 11:
            run = min(left, 138)
            values[gap, at], sizes[gap, at] = _HEAD_CODES[18] | (run - 11) << _HEAD[18], _HEAD[18] + 7
            left, at = left - run, at + 1
        if left >= 3:
            values[gap, at], sizes[gap, at] = _HEAD_CODES[17] | (left - 3) << _HEAD[17], _HEAD[17] + 3
        else:
            values[gap, at], sizes[gap, at] = _HEAD_CODES[0] * 5, left * _HEAD[0]
    return values | sizes << 32


_GAPS = _gap_fields(LITERALS + LENGTHS + (1 << CACHE_BITS))
#: The field of each code length, nothing for none at the end.
_LENGTHS = np.where(np.arange(len(_HEAD)) > 0, _HEAD_OF | _HEAD_SIZE << 32, 0)
_HEAD_FIELDS = np.array(_HEAD_BITS, np.int64) | np.array(_HEAD_LENGTH, np.int64) << 32


def _write_code(out: BitWriter, counts: np.ndarray, times: int = 1) -> np.ndarray | None:
    """Writes a prefix code for symbols with these counts, so many times; the field of each, None for one symbol, which takes no bits."""
    used = counts.nonzero()[0].tolist() or [0]
    lengths = np.zeros(len(counts), np.int64)
    alone = len(used) == 1
    if len(used) <= 2 and used[-1] < LITERALS:
        for _ in range(times):
            out.put(0b101 | (len(used) - 1) << 1, 3)  # simple, so many symbols, the first in eight bits
            for s in used:
                out.put(s, 8)
        if not alone:
            lengths[used] = np.array([0, 1]) | 1 << 32
        return None if alone else lengths
    if alone:
        written = [1]
    else:
        lengths = _code_lengths(counts)
        written = lengths[used].tolist()
    gap = np.array([*used, len(counts)])
    gap[1:] -= gap[:-1] + 1
    flat = np.concatenate((_HEAD_FIELDS, np.concatenate((_GAPS.take(gap, axis=0), _LENGTHS.take([*written, 0])[:, None]), axis=1).ravel()))
    for _ in range(times):
        out.put_all(flat)
    return None if alone else _codes(lengths) | lengths << 32


def _prefixed(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes and fields of extra bits, of lengths or distances."""
    v = n - 1
    high = np.maximum(np.frexp(v)[1].astype(np.int64) - 1, 1)
    small = v < 4
    extra = high - 1
    return np.where(small, v, 2 * high + ((v >> extra) & 1)), np.where(small, 0, v & ((1 << extra) - 1) | extra << 32)


@lru_cache(maxsize=8)
def _near(width: int) -> dict[int, int]:
    """The first short code of each distance that has one."""
    out: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR, 1):
        out.setdefault(max(1, x + y * width), code)
    return out


def _copies(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references as (place, length, distance): what stands earlier in the same image, left to right."""
    n = len(argb) - LEAST_COPY + 1
    if n < 2:
        return []
    with np.errstate(over="ignore"):
        key = argb[:n].copy()
        for k in range(1, LEAST_COPY):
            key = key * 0x9E3779B97F4A7C1 + argb[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    before = np.full(n, -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    out, at, found = [], 0, np.flatnonzero(before >= 0)
    for i, j in zip(found.tolist(), before[found].tolist(), strict=True):
        if i < at:
            continue
        most = min(len(argb) - i, MOST_COPY)
        differs = argb[i : i + most] != argb[j : j + most]
        k = int(differs.argmax()) if differs.any() else most
        if k >= LEAST_COPY:
            out.append((i, k, i - j))
            at = i + k
    return out


def _write_pixels(out: BitWriter, argb: np.ndarray, width: int, main: bool) -> None:
    """Writes an entropy-coded image."""
    n, cached = len(argb), np.zeros(len(argb), bool)
    copies = _copies(argb) if main else []
    slot = (argb * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    if main and not copies:  # one or the other, so that either is resolved without a loop over pixels
        order = np.argsort(slot, kind="stable")
        hit = (slot[order[1:]] == slot[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
        cached[order[1:][hit]] = True
    token = np.ones(n, bool)
    for i, k, _ in copies:
        token[i + 1 : i + k] = False
    cache = int(cached.sum()) >= 8
    out.put(cache, 1)
    if cache:
        out.put(CACHE_BITS, 4)
    else:
        cached[:] = False
    if main:
        out.put(0, 1)  # no meta codes
    symbol = argb >> 8 & 255
    if cache:
        symbol = np.where(cached, slot + LITERALS + LENGTHS, symbol)
    literal = token & ~cached
    if copies:
        at, lengths, back = np.array(copies).T
        near = _near(width)
        extra, far = np.zeros((2, n), np.int64), np.zeros(n, np.int64)
        prefix, extra[:, at] = _prefixed(np.stack((lengths, [near.get(d, d + len(NEAR)) for d in back.tolist()])))
        symbol[at], far[at] = LITERALS + prefix[0], prefix[1]
        literal[at] = False
        symbol, argb, literal, far, extra = symbol[token], argb[token], literal[token], far[token], extra[:, token]
    green = _write_code(out, np.bincount(symbol, minlength=LITERALS + LENGTHS + ((1 << CACHE_BITS) if cache else 0)))
    red, blue, alpha = argb >> 16 & 255, argb & 255, argb >> 24
    both = _write_code(out, np.bincount(np.concatenate((red[literal], blue[literal])), minlength=LITERALS), 2)  # red and blue share one
    fields = [] if green is None else [green.take(symbol)]
    held = (lambda x: x) if not (copies or cache) else (lambda x: x * literal)
    after = [] if both is None else [held(both.take(v)) for v in (red, blue)]
    opaque = _write_code(out, np.bincount(alpha[literal], minlength=LITERALS))
    after += [] if opaque is None else [held(opaque.take(alpha))]
    back = _write_code(out, np.bincount(far[~literal], minlength=DISTANCES) if copies else np.zeros(1, np.int64))
    if copies:
        fields += [extra[0], *after] + ([] if back is None else [back.take(far) * ~literal]) + [extra[1]]
    else:
        fields += after
    if fields:
        out.put_all(np.stack(fields, axis=1).ravel())


def _predicted(samples: np.ndarray) -> tuple[np.ndarray, int]:
    """The residuals of (rows, columns, 4) samples under the best of ``MODES``, and that mode."""
    best = None
    above = samples[:-1]
    right = np.concatenate((above[:, 1:], samples[1:, :1]), axis=1)
    for mode in MODES:
        guess = above[:, 1:] if mode == 2 else above[:, :-1] if mode == 4 else (above[:, :-1] + above[:, 1:]) >> 1 if mode == 8 else (above[:, 1:] + right[:, 1:]) >> 1
        rest = (samples[1:, 1:] - guess) & 255
        cost = int(np.minimum(rest, 256 - rest).sum())
        if best is None or cost < best[0]:
            best = (cost, mode, rest)
    out = samples.copy()
    out[1:, 1:] = best[2]
    out[1:, 0] = (samples[1:, 0] - samples[:-1, 0]) & 255
    out[0, 1:] = (samples[0, 1:] - samples[0, :-1]) & 255
    out[0, 0, 0] = (samples[0, 0, 0] - 255) & 255
    return out, best[1]


def _crossed(samples: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Samples less what green says of red, and green and red of blue; and the factors."""
    green, red, blue = (_signed(samples[..., k]).astype(np.float64) for k in (2, 1, 3))

    def factor(x: np.ndarray, y: np.ndarray) -> int:
        power = float((x * x).sum())
        return int(np.clip(round(32 * float((x * y).sum()) / power), -128, 127)) if power else 0

    red_by_green, blue_by_green = factor(green, red), factor(green, blue)
    g, r = _signed(samples[..., 2]), _signed(samples[..., 1])
    blue_by_red = factor(red, blue - (blue_by_green * g >> 5))
    out = samples.copy()
    out[..., 1] = (samples[..., 1] - (red_by_green * g >> 5)) & 255
    out[..., 3] = (samples[..., 3] - (blue_by_green * g >> 5) - (blue_by_red * r >> 5)) & 255
    return out, (blue_by_red & 255, blue_by_green & 255, red_by_green & 255)


def _bits(samples: np.ndarray) -> float:
    """About the bits that samples take by their channels' frequencies."""
    total = 0.0
    for k in (1, 2, 3):
        n = np.bincount(samples[..., k].ravel())
        n = n[n > 0]
        total += float((n * np.log2(n.sum() / n)).sum())
    return total


def _joined(samples: np.ndarray) -> np.ndarray:
    """Columns of alpha, red, green and blue as ARGB numbers."""
    a, r, g, b = (samples[..., k].ravel() for k in range(4))
    return a << 24 | r << 16 | g << 8 | b


def _written(samples: np.ndarray) -> BitWriter:
    """The bits of an image of (rows, columns, 3) samples of red, green and blue, opaque."""
    rows, cols = samples.shape[:2]
    out = BitWriter()
    out.put(cols - 1, 14)
    out.put(rows - 1, 14)
    out.put(0, 1 + 3)  # no alpha, version 0
    full = np.concatenate((np.full((rows, cols, 1), 255, np.int64), samples.astype(np.int64)), axis=2)
    argb = _joined(full)
    few, width = len(set(argb[: 4 * PALETTE].tolist())) <= PALETTE, cols
    colours = np.unique(argb) if few else argb
    if len(colours) <= PALETTE:
        index = np.searchsorted(colours, argb)
        out.put(0b111, 3)
        out.put(len(colours) - 1, 8)
        _write_pixels(out, _joined(np.diff(_channels(colours), axis=0, prepend=0) & 255), len(colours), False)
        packed = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        each, width = 8 >> packed, -(-cols >> packed)
        wide = np.zeros((rows, width << packed), np.int64)
        wide[:, :cols] = index.reshape(rows, cols)
        argb = 0xFF000000 | (wide.reshape(rows, width, 1 << packed) << (np.arange(1 << packed) * each)).sum(axis=2).ravel() << 8
    elif rows > 1 and (samples[1:] == samples[:-1]).mean() >= ALIKE:
        rest, mode = _predicted(full)
        rest, (red_blue, green_blue, green_red) = _crossed(rest)
        if _bits(rest) < _bits(full):
            tiles = -(-rows >> _SIDE) * -(-cols >> _SIDE)
            out.put(0b001 | (_SIDE - 2) << 3, 6)
            _write_pixels(out, np.full(tiles, 0xFF000000 | mode << 8), 1, False)
            out.put(0b011 | (_SIDE - 2) << 3, 6)
            _write_pixels(out, np.full(tiles, 0xFF000000 | red_blue << 16 | green_blue << 8 | green_red), 1, False)
            argb = _joined(rest)
    out.put(0, 1)  # no more transforms
    _write_pixels(out, argb, width, True)
    return out


def _file(body: bytes) -> bytes:
    chunk = b"\x2f" + body
    pad = b"\0" * (len(chunk) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + pad


def store_all(payloads: list[bytes]) -> list[list[bytes]]:
    """Payloads, their lengths positive multiples of 192, each as lossless WebP files."""
    counts, writers, bodies, size = [], [], [], 0
    for p in payloads:
        flat = np.frombuffer(p, np.uint8).reshape(-1, WIDTH, 3)
        counts.append(-(-len(flat) // MAX_ROWS))
        for at in range(0, len(flat), MAX_ROWS):
            writers.append(_written(flat[at : at + MAX_ROWS]))
            size += len(flat[at : at + MAX_ROWS]) * WIDTH
            if size >= TOGETHER:
                bodies += _packed(writers)
                writers, size = [], 0
    bodies += _packed(writers) if writers else []
    files = iter(bodies)
    return [[_file(next(files)) for _ in range(n)] for n in counts]


def store(payload: bytes) -> bytes:
    """A payload as lossless WebP, its files one after the other."""
    return b"".join(store_all([payload])[0])


def padded(text: str | None) -> bytes:
    """The text as UTF-8 (null: empty), filled with spaces up to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def features(pixels: np.ndarray) -> str:
    """Size, the channels' means and deviations, and an 8 by 8 average hash of an RGB image."""
    rows, cols = pixels.shape[:2]
    wide = pixels.astype(np.int64)
    flat = wide.reshape(-1, 3)
    mean = flat.sum(axis=0) / len(flat)
    spread = np.sqrt(np.maximum((flat * flat).sum(axis=0) / len(flat) - mean * mean, 0))
    at = np.arange(9) * rows // 8
    ends = np.maximum(at[1:], at[:-1] + 1)
    sums = np.zeros((rows + 1, 8), np.int64)
    np.cumsum(wide.sum(axis=2).reshape(rows, 8, cols // 8).sum(axis=2), axis=0, out=sums[1:])
    cells = (sums[ends] - sums[at[:-1]]) / (ends - at[:-1])[:, None]
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    numbers = ",".join(f"{v:.4f}" for v in (*mean.tolist(), *spread.tolist()))
    return f"{cols}x{rows};{numbers};{bits}"


def media_columns(df: DataFrame, text: str = "text", rows: int = 2048) -> DataFrame:
    """``df`` without ``text``, with ``media``, ``width``, ``height``, ``pixels`` and ``feature``.

    ``media`` is the stored form of the padded text, ``pixels`` the red, green and blue samples
    that decoding ``media`` gives, row by row (of several images, one below the other).
    Columns of ``df`` with the new names are replaced. Null and empty texts are one unit of spaces.
    """
    fresh = ("media", "width", "height", "pixels", "feature")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), rows):
                batch = whole.slice(at, rows)
                files = store_all([padded(t.as_py()) for t in batch.column(text)])
                media = [b"".join(some) for some in files]
                read = iter(decode_files([f for some in files for f in some]))
                images = [np.concatenate([next(read) for _ in some])[..., 1:].astype(np.uint8) for some in files]
                kept = [c for c in batch.schema.names if c != text and c not in fresh]
                new = {
                    "media": pa.array(media, pa.binary()),
                    "width": pa.array([i.shape[1] for i in images], pa.int32()),
                    "height": pa.array([i.shape[0] for i in images], pa.int32()),
                    "pixels": pa.array([i.tobytes() for i in images], pa.binary()),
                    "feature": pa.array([features(i) for i in images], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new.values()], names=[*kept, *new])

    kept = [f for f in df.schema.fields if f.name != text and f.name not in fresh]
    new = [StructField("media", BinaryType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("pixels", BinaryType()), StructField("feature", StringType())]
    return df.mapInArrow(convert, StructType([*kept, *new]))


def media_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """Per row of ``doc_id`` and ``text``: sizes and hashes of the payload read back and of its stored form."""
    source = df.select("doc_id", text, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    out = media_columns(source, text)
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
