"""The lossless WebP decoder on hand-written streams of every feature."""

from __future__ import annotations

import numpy as np
import pytest

from clausework.llm import webp


def random_pixels(rng, height, width, colours=None):
    if colours:
        table = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
        return table[rng.integers(0, colours, (height, width))]
    return rng.integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)


class Stream(webp.Writer):
    """Writes images of literal pixels, back-references and cache hits with full prefix codes."""

    def start(self, width, height):
        self.bits(webp.SIGNATURE, 8), self.bits(width - 1, 14), self.bits(height - 1, 14), self.bits(1, 1), self.bits(0, 3)

    def entropy(self, items, main=False, cache_bits=0):
        """``items``: an int is a pixel, (length, distance code) a reference, (index,) a cache hit."""
        self.bits(cache_bits << 1 | 1, 5) if cache_bits else self.bits(0, 1)
        if main:
            self.bits(0, 1)
        self.codes_and_items(items, 1 << cache_bits if cache_bits else 0)

    def codes_and_items(self, items, cache_size):
        symbols = [[], [], [], [], []]
        plan = []
        for item in items:
            if isinstance(item, tuple) and len(item) == 1:
                plan.append([(0, 280 + item[0], 0, 0)])
            elif isinstance(item, tuple):
                (lp, le, lv), (dp, de, dv) = self.prefix(item[0]), self.prefix(item[1])
                plan.append([(0, 256 + lp, le, lv), (4, dp, de, dv)])
            else:
                p = int(item)
                plan.append([(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)])
            for place, symbol, *_ in plan[-1]:
                symbols[place].append(symbol)
        codes = []
        for place, size in enumerate(webp.ALPHABETS):
            counts = np.bincount(symbols[place] or [0], minlength=size + (cache_size if place == 0 else 0))
            lengths = webp.huffman_lengths(counts.tolist())
            if sum(map(bool, lengths)) == 1 and lengths.index(1) > 255:
                lengths[0] = 1
            self.code(lengths)
            codes.append((webp.canonical(lengths), lengths if sum(map(bool, lengths)) > 1 else [0] * len(lengths)))
        for step in plan:
            for place, symbol, extra, value in step:
                self.bits(codes[place][0][symbol], codes[place][1][symbol])
                self.bits(value, extra)

    @staticmethod
    def prefix(value):
        if value <= 4:
            return value - 1, 0, 0
        value -= 1
        extra = value.bit_length() - 2
        return 2 * (extra + 1) + (value >> extra & 1), extra, value & ((1 << extra) - 1)

    def file(self):
        data = self.done()
        data += bytes(len(data) % 2)
        return b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (17, 23)])
def test_literal_pixels(shape):
    pixels = random_pixels(np.random.default_rng(1), *shape)
    s = Stream()
    s.start(shape[1], shape[0])
    s.bits(0, 1)
    s.entropy(pixels.ravel().tolist(), main=True)
    assert (webp.decode(s.file()) == pixels).all()


def test_back_references_and_colour_cache():
    rng = np.random.default_rng(2)
    width, height, bits = 20, 12, 4
    items, out, cache = [], [], [0] * (1 << bits)

    def add(ps):
        for p in ps:
            out.append(p)
            cache[(webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - bits)] = p

    while len(out) < width * height:
        kind, left = rng.integers(3), width * height - len(out)
        if kind == 0 or len(out) < 25:
            p = int(rng.integers(0, 1 << 32))
            items.append(p)
            add([p])
        elif kind == 1:
            code = int(rng.integers(1, 121 + len(out)))
            x, y = webp.NEAR[code - 1] if code <= 120 else (0, 0)
            distance = max(1, x + y * width) if code <= 120 else code - 120
            if distance > len(out):
                continue
            length = min(left, int(rng.integers(1, 30)))
            items.append((length, code))
            start = len(out) - distance
            for k in range(length):
                add([out[start + k]])
        else:
            index = int(rng.integers(1 << bits))
            items.append((index,))
            add([cache[index]])
    s = Stream()
    s.start(width, height)
    s.bits(0, 1)
    s.entropy(items, main=True, cache_bits=bits)
    assert webp.decode(s.file()).ravel().tolist() == out


def test_code_groups_by_block():
    rng = np.random.default_rng(3)
    width, height = 9, 6
    pixels = random_pixels(rng, height, width)
    blocks = rng.integers(0, 2, (2, 3))
    blocks[0, 0], blocks[1, 2] = 0, 1
    s = Stream()
    s.start(width, height)
    s.bits(0, 1), s.bits(0, 1), s.bits(1, 1), s.bits(0, 3)
    s.entropy([int(b) << 8 for b in blocks.ravel()])
    codes = []
    for _ in range(2):
        own = []
        for size in webp.ALPHABETS:
            lengths = [8] * 256 + [0] * (size - 256) if size > 40 else [1]
            s.code(lengths)
            own.append((webp.canonical(lengths), lengths))
        codes.append(own)
    for y in range(height):
        for x in range(width):
            p, own = int(pixels[y, x]), codes[blocks[y >> 2, x >> 2]]
            for place, v in zip((0, 1, 2, 3), (p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24)):
                s.bits(own[place][0][v], own[place][1][v])
    assert (webp.decode(s.file()) == pixels).all()


def test_predictor_modes():
    rng = np.random.default_rng(4)
    height, width, bits = 19, 22, 2
    pixels = random_pixels(rng, height, width)
    modes = rng.integers(0, 14, (5, 6))
    modes[1], modes[2] = 2, 1
    c, residual = webp._channels(pixels).astype(int), np.zeros((height, width, 4), int)
    for y in range(height):
        for x in range(width):
            if y == 0 or x == 0:
                guess = [0, 0, 0, 255] if x == y == 0 else c[y, x - 1].tolist() if y == 0 else c[y - 1, x].tolist()
            else:
                right = c[y - 1, x + 1] if x + 1 < width else c[y, 0]
                guess = webp.predict(int(modes[y >> bits, x >> bits]), *(v.tolist() for v in (c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])))
            residual[y, x] = (c[y, x] - guess) & 255
    s = Stream()
    s.start(width, height)
    s.bits(1 | webp.PREDICTOR << 1, 3), s.bits(bits - 2, 3)
    s.entropy([int(m) << 8 for m in modes.ravel()])
    s.bits(0, 1)
    s.entropy(webp._packed(residual.astype(np.uint8)).ravel().tolist(), main=True)
    assert (webp.decode(s.file()) == pixels).all()


@pytest.mark.parametrize("mode, want", [(5, [3, 3, 3, 3]), (10, [4, 4, 4, 4]), (11, [2, 2, 2, 2]), (12, [0, 0, 0, 0]), (13, [0, 0, 0, 0])])
def test_predictions_by_hand(mode, want):
    left, top, right, corner = [2] * 4, [4] * 4, [3] * 4, [9] * 4
    assert webp.predict(mode, left, top, right, corner) == want


def test_cross_colour_and_subtract_green():
    rng = np.random.default_rng(5)
    height, width, bits = 10, 13, 2
    pixels, factors = random_pixels(rng, height, width), random_pixels(rng, 3, 4)
    coded = webp.cross_colour(pixels, factors, bits, -1)
    c = webp._channels(coded).copy()
    c[..., 0] -= c[..., 1]
    c[..., 2] -= c[..., 1]
    s = Stream()
    s.start(width, height)
    s.bits(1 | webp.CROSS_COLOUR << 1, 3), s.bits(bits - 2, 3)
    s.entropy(factors.ravel().tolist())
    s.bits(1 | webp.SUBTRACT_GREEN << 1, 3)
    s.bits(0, 1)
    s.entropy(webp._packed(c).ravel().tolist(), main=True)
    assert (webp.decode(s.file()) == pixels).all()


def test_colour_deltas_by_hand():
    assert webp._delta(np.uint8([64, 0xC0, 16]), np.uint8([32, 32, 0x80])).tolist() == [64, -64, -64]


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    height, width = 7, 21
    table = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    index = rng.integers(0, colours, (height, width))
    each = 8 if colours <= 2 else 4 if colours <= 4 else 2 if colours <= 16 else 1
    across = -(-width // each)
    padded = np.zeros((height, across * each), np.int64)
    padded[:, :width] = index
    packed = (padded.reshape(height, across, each) << (np.arange(each) * (8 // each if each > 1 else 0))).sum(axis=2)
    deltas = np.diff(webp._channels(table).astype(int), axis=0, prepend=0) & 255
    s = Stream()
    s.start(width, height)
    s.bits(1 | webp.PALETTE << 1, 3), s.bits(colours - 1, 8)
    s.entropy(webp._packed(deltas.astype(np.uint8)).ravel().tolist())
    s.bits(0, 1)
    s.entropy([0xFF000000 | int(p) << 8 for p in packed.ravel()], main=True)
    assert (webp.decode(s.file()) == table[index]).all()


def test_payloads_round_trip():
    rng = np.random.default_rng(6)
    steps = [1, 1]
    while sum(steps) < 100_000:
        steps.append(steps[-1] + steps[-2])
    cases = [b"", b"a", b"ab" * 40, b"abc" * 100, bytes(range(256)) * 3, "Hello wörld ".encode() * 500, b"\0" * 64, rng.bytes(5000), b"".join(bytes([i + 30]) * n for i, n in enumerate(steps)), rng.integers(60, 90, 64 * 16384 + 640, dtype=np.uint8).tobytes()]
    for text in cases:
        data = webp.payload(text)
        images = webp.encode_payload(data)
        assert len(data) % 64 == 0 and data and webp.decode_payload(images) == data
        assert all(i[:4] == b"RIFF" and int.from_bytes(i[4:8], "little") == len(i) - 8 for i in images)


def test_broken_files_are_refused():
    image = webp.encode_payload(webp.payload(b"some text " * 50))[0]
    with pytest.raises(ValueError):
        webp.decode(b"RIFX" + image[4:])
    with pytest.raises(ValueError):
        webp.decode(image[:16] + (40).to_bytes(4, "little") + image[20:60])
