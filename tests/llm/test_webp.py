"""The WebP decoder on streams that a second, general encoder writes here, and the payload columns."""

import hashlib
import heapq
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from citelode.llm import webp


class Out:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> k) & 1 for k in range(n)]

    def code(self, pair):
        value, n = pair
        self.bits += [(value >> k) & 1 for k in range(n - 1, -1, -1)]

    def data(self):
        return bytes(sum(b << k for k, b in enumerate(self.bits[i : i + 8])) for i in range(0, len(self.bits), 8))


def lengths_of(counts, most):
    """Code lengths of at most ``most`` bits: counts are flattened until the tree is shallow enough."""
    counts = dict(counts)
    while True:
        heap = [(c, i, [s]) for i, (s, c) in enumerate(sorted(counts.items()))]
        heapq.heapify(heap)
        depth, n = Counter(), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
            n += 1
        if max(depth.values(), default=0) <= most:
            return depth
        counts = {s: c // 2 + 1 for s, c in counts.items()}


def canonical(depth):
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in depth.items()):
        code <<= n - last
        out[s] = (code, n)
        code, last = code + 1, n
    return out


def write_code(out, counts, alphabet, rng):
    """Writes a prefix code for the symbols counted; their codes."""
    used = sorted(counts)
    if not used or (len(used) <= 2 and used[-1] < 256 and rng.random() < 0.7):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        eight = used[0] > 1 or rng.random() < 0.5
        out.put(int(eight), 1)
        out.put(used[0], 8 if eight else 1)
        if len(used) == 2:
            out.put(used[1], 8)
        return {used[0]: (0, 0)} if len(used) == 1 else {used[0]: (0, 1), used[1]: (1, 1)}
    depth = lengths_of(counts, 15) if len(used) > 1 else Counter({used[0]: 1})
    flat = [depth.get(s, 0) for s in range(alphabet)]
    tokens, i, previous = [], 0, 8
    while i < alphabet:
        run = 1
        while i + run < alphabet and flat[i + run] == flat[i]:
            run += 1
        if flat[i] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        elif flat[i] and flat[i] == previous and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            tokens.append((flat[i], 0, 0))
            previous = flat[i] or previous
        i += run
    if rng.random() < 0.5:  # the tail of zeros may be left out
        while tokens and tokens[-1][0] in (0, 17, 18):
            tokens.pop()
        limit = len(tokens) >= 2
    else:
        limit = False
        if len(tokens) < 2:
            limit = False
    if len(tokens) < 2 or not limit and sum(1 if t[0] < 16 else t[1] + (3 if t[0] < 18 else 11) for t in tokens) < alphabet:
        return write_code(out, counts, alphabet, rng)
    own = Counter(t[0] for t in tokens)
    inner = lengths_of(own, 7) if len(own) > 1 else Counter({tokens[0][0]: 1})
    out.put(0, 1)
    order = webp.CODE_LENGTH_ORDER
    n = max(4, 1 + max(order.index(s) for s in inner))
    out.put(n - 4, 4)
    for s in order[:n]:
        out.put(inner.get(s, 0), 3)
    out.put(int(limit), 1)
    if limit:
        out.put(3, 3)
        out.put(len(tokens) - 2, 8)
    codes = canonical(inner) if len(own) > 1 else {tokens[0][0]: (0, 0)}
    for s, extra, bits in tokens:
        out.code(codes[s])
        out.put(extra, bits)
    return canonical(depth) if len(used) > 1 else {used[0]: (0, 0)}


def prefix_of(value):
    """Prefix symbol, extra bits and their number of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v - ((2 + second) << (top - 1)), top - 1


def write_pixels(out, pixels, width, rng, main):
    """An entropy-coded image of ARGB numbers, with back-references, a colour cache and meta codes."""
    cache_bits = rng.choice([0, 0, 1, 4, 11])
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    groups, tile, choice = 1, 2, None
    if main:
        use = rng.random() < 0.5
        out.put(int(use), 1)
        if use:
            tile = rng.choice([2, 3])
            across, down = -(-width // (1 << tile)), -(-(len(pixels) // width) // (1 << tile))
            groups = 3
            choice = [rng.randrange(groups) for _ in range(across * down)]
            choice[0] = groups - 1
            out.put(tile - 2, 3)
            write_pixels(out, [c << 8 for c in choice], across, rng, False)
    near = {xy: i + 1 for i, xy in enumerate(webp.NEAR)}
    cache, tokens, at = {}, [], 0
    while at < len(pixels):
        group = choice[(at // width >> tile) * -(-width // (1 << tile)) + (at % width >> tile)] if choice else 0
        best, far = 0, 0
        for d in (1, width, rng.randint(1, max(1, at)), width + 1, 2):
            n = 0
            while d <= at and at + n < len(pixels) and n < 4096 and pixels[at + n] == pixels[at + n - d]:
                n += 1
            best, far = max((best, far), (n, d))
        slot = (pixels[at] * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
        if best >= 3:
            codes = [near[x, y] for (x, y) in near if max(1, x + y * width) == far]
            tokens.append((group, "copy", best, rng.choice(codes) if codes and rng.random() < 0.8 else far + 120))
            step = best
        elif cache_bits and cache.get(slot) == pixels[at]:
            tokens.append((group, "cache", slot, 0))
            step = 1
        else:
            tokens.append((group, "pixel", pixels[at], 0))
            step = 1
        for p in pixels[at : at + step]:
            if cache_bits:
                cache[(p * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += step
    counts = [[Counter() for _ in range(5)] for _ in range(groups)]

    def symbols(token):
        _, kind, value, far = token
        if kind == "pixel":
            return [(0, value >> 8 & 255, 0, 0), (1, value >> 16 & 255, 0, 0), (2, value & 255, 0, 0), (3, value >> 24, 0, 0)]
        if kind == "cache":
            return [(0, 280 + value, 0, 0)]
        s, extra, n = prefix_of(value)
        d, extra2, n2 = prefix_of(far)
        return [(0, 256 + s, extra, n), (4, d, extra2, n2)]

    for t in tokens:
        for k, s, _, _ in symbols(t):
            counts[t[0]][k][s] += 1
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[write_code(out, c, n, rng) for c, n in zip(group, sizes, strict=True)] for group in counts]
    for t in tokens:
        for k, s, extra, n in symbols(t):
            out.code(codes[t[0]][k][s])
            out.put(extra, n)


def split(p):
    return [p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255]


def join(c):
    return (c[0] & 255) << 24 | (c[1] & 255) << 16 | (c[2] & 255) << 8 | (c[3] & 255)


def predict(mode, le, t, tr, tl):
    """The format's predictions, once more, sample by sample."""
    avg = lambda a, b: (a + b) // 2
    if mode == 11:
        way = [a + b - c for a, b, c in zip(le, t, tl, strict=True)]
        return le if sum(abs(w - a) for w, a in zip(way, le, strict=True)) < sum(abs(w - a) for w, a in zip(way, t, strict=True)) else t
    out = []
    for a, b, c, d in zip(le, t, tr, tl, strict=True):
        trunc = avg(a, b) - d
        half = trunc // 2 if trunc >= 0 else -(-trunc // 2)
        out.append([None, a, b, c, d, avg(avg(a, c), b), avg(a, d), avg(a, b), avg(d, b), avg(b, c), avg(avg(a, d), avg(b, c)), None, min(255, max(0, a + b - d)), min(255, max(0, avg(a, b) + half))][mode])
    return out if mode else [255, 0, 0, 0]


def signed(x):
    return x - 256 if x > 127 else x


def encode(pixels, width, rng, kinds):
    """A file of ARGB numbers; ``kinds`` names the transforms, in the order they are applied."""
    out, rows = Out(), len(pixels) // width
    out.put(width - 1, 14)
    out.put(rows - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    now = width
    for kind in kinds:
        out.put(1, 1)
        out.put(("predict", "cross", "green", "palette").index(kind), 2)
        if kind == "green":
            pixels = [join([a, r - g, g, b - g]) for a, r, g, b in map(split, pixels)]
        elif kind == "palette":
            colors = sorted(set(pixels))
            out.put(len(colors) - 1, 8)
            deltas = [join([x - y for x, y in zip(split(c), split(p), strict=True)]) for c, p in zip(colors, [0, *colors], strict=False)]
            write_pixels(out, deltas, len(colors), rng, False)
            packed = 3 if len(colors) <= 2 else 2 if len(colors) <= 4 else 1 if len(colors) <= 16 else 0
            across, each, fresh = -(-now // (1 << packed)), 8 >> packed, []
            for y in range(rows):
                line = [colors.index(p) for p in pixels[y * now : (y + 1) * now]]
                fresh += [0xFF000000 | sum(v << (k * each) for k, v in enumerate(line[x << packed : (x + 1) << packed])) << 8 for x in range(across)]
            pixels, now = fresh, across
        else:
            tile = rng.choice([2, 3])
            across = -(-now // (1 << tile))
            side = [rng.randrange(14) << 8 | 0xFF000000 if kind == "predict" else join([255, *(rng.randrange(256) for _ in range(3))]) for _ in range(across * -(-rows // (1 << tile)))]
            out.put(tile - 2, 3)
            write_pixels(out, side, across, rng, False)
            src, fresh = [split(p) for p in pixels], []
            for i, p in enumerate(src):
                y, x = divmod(i, now)
                own = side[(y >> tile) * across + (x >> tile)]
                if kind == "predict":
                    guess = ([255, 0, 0, 0] if not x else src[i - 1]) if not y else src[i - now] if not x else predict(own >> 8 & 15, src[i - 1], src[i - now], src[i - now + 1], src[i - now - 1])
                    fresh.append(join([a - b for a, b in zip(p, guess, strict=True)]))
                else:
                    _, rb, gb, gr = split(own)
                    g, r = signed(p[2]), signed(p[1])
                    fresh.append(join([p[0], p[1] - (signed(gr) * g >> 5), p[2], p[3] - (signed(gb) * g >> 5) - (signed(rb) * r >> 5)]))
            pixels = fresh
    out.put(0, 1)
    write_pixels(out, pixels, now, rng, True)
    body = b"\x2f" + out.data()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


KINDS = [[], ["green"], ["predict"], ["cross"], ["palette"], ["predict", "cross", "green"], ["palette", "predict"], ["green", "cross", "predict"]]


@pytest.mark.parametrize("kinds", KINDS, ids="-".join)
@pytest.mark.parametrize("seed", range(4))
def test_every_feature_decodes(kinds, seed):
    rng = random.Random(seed)
    width, rows, n = rng.randint(1, 23), rng.randint(1, 19), rng.choice([1, 2, 3, 4, 9, 16, 40])
    colors = [rng.getrandbits(32) for _ in range(n)]
    pixels = []
    while len(pixels) < width * rows:
        pixels += pixels[-width:] if pixels and rng.random() < 0.3 else [rng.choice(colors)] * rng.choice([1, 1, 2, 9])
    pixels = pixels[: width * rows]
    got = webp.decode_one(encode(pixels, width, rng, kinds))
    assert got.shape == (rows, width, 4) and got.reshape(-1, 4).tolist() == [split(p) for p in pixels]


@pytest.mark.parametrize("text", [None, "", "a", "x" * 192, "naïve 日本 🙂 \x00\x7f", "abc " * 900_000], ids=["null", "empty", "one", "unit", "wide", "tiles"])
def test_payload_round_trip(text):
    payload = webp.padded(text)
    assert len(payload) % 192 == 0 and payload.startswith((text or "").encode())
    images = webp.decode(webp.store(payload))
    assert b"".join(i[..., 1:].astype(np.uint8).tobytes() for i in images) == payload
    assert (len(images) > 1) == (len(payload) > 192 * webp.MAX_ROWS)


def test_every_byte_round_trips():
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 17, 128, 129, 255, 256):
        payload = bytes(rng.randrange(n) for _ in range(192 * 9))
        assert webp.decode(webp.store(payload))[0][..., 1:].astype(np.uint8).tobytes() == payload


@pytest.mark.parametrize("data", [b"", b"RIFF", b"x" * 40, webp.store(b"ab" * 96)[:-9]])
def test_broken_files_are_errors(data):
    with pytest.raises((webp.WebpError, struct.error)):
        webp.decode_one(data)


def test_digest(spark):
    texts = [None, "", "one", "two " * 100, "one"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media_bytes string")
    out = {r.doc_id: r for r in webp.media_digest(df).collect()}
    for i, t in enumerate(texts):
        p = webp.padded(t)
        m = webp.store(p)
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256) == (len(t or ""), len(p), hashlib.sha256(p).hexdigest())
        assert (out[i].tail_crc32, out[i].media_bytes, out[i].media_sha256) == (zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest())
    assert out[2].feature == out[4].feature and webp.media_digest(df.where("false")).count() == 0
