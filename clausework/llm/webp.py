"""Lossless WebP images: payloads stored as green samples, and a decoder of the whole format."""

from __future__ import annotations

import hashlib
import heapq
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausework.llm.common import map_rows, slices
from clausework.scratch import shared_folder

# Fixed values of the format.
SIGNATURE = 0x2F
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LENGTH_CODES = 24
ALPHABETS = (256 + LENGTH_CODES, 256, 256, 256, 40)  # green with lengths, red, blue, alpha, distance
CACHE_MULTIPLIER = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE, MAX_LENGTH = 16384, 15

WIDTH = 64


# Prefix codes.


def canonical(lengths: list[int]) -> list[int]:
    """Codes of the given lengths, with the first bit to be read in the lowest place."""
    codes, code, before = [0] * len(lengths), 0, 0
    for size, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= size - before
        codes[symbol] = int(f"{code:0{size}b}"[::-1], 2)
        code, before = code + 1, size
    return codes


def huffman_lengths(counts: list[int]) -> list[int]:
    """Code lengths of at most 15 bits; symbols that do not occur get none."""
    lengths = [0] * len(counts)
    used = [s for s, n in enumerate(counts) if n]
    if len(used) == 1:
        lengths[used[0]] = 1
        return lengths
    weights = [counts[s] for s in used]
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(used) - 1)
        for tag in range(len(used), 2 * len(used) - 1):
            wa, a = heapq.heappop(heap)
            wb, b = heap[0]
            heapq.heapreplace(heap, (wa + wb, tag))
            parent[a] = parent[b] = tag
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= MAX_LENGTH:
            for s, n in zip(used, depth):
                lengths[s] = n
            return lengths
        weights = [w // 2 + 1 for w in weights]


class Code:
    """A prefix code with a table over the next ``bits`` bits (symbol << 4 | length); a code of one symbol reads nothing."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = None if len(used) > 1 else (used or [0])[0]
        self.top = used[-1] if used else 0
        if self.only is not None:
            return
        self.bits = max(lengths)
        if sum(1 << (MAX_LENGTH - lengths[s]) for s in used) != 1 << MAX_LENGTH:
            raise ValueError("prefix code is not complete")
        self.mask, self.table = (1 << self.bits) - 1, [0] * (1 << self.bits)
        codes = canonical(lengths)
        for s in used:
            n = lengths[s]
            self.table[codes[s] :: 1 << n] = [s << 4 | n] * (1 << (self.bits - n))


class Reader:
    """Bits of a stream, lowest first. Behind the end lie zeros; ``check`` says whether they were used."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        byte = self.at >> 3
        value = (int.from_bytes(self.data[byte : byte + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return value

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        byte = self.at >> 3
        entry = code.table[(int.from_bytes(self.data[byte : byte + 3], "little") >> (self.at & 7)) & code.mask]
        self.at += entry & 15
        return entry >> 4

    def check(self) -> None:
        if self.at > 8 * len(self.data):
            raise ValueError("stream ends early")

    def code(self, alphabet: int) -> Code:
        lengths = [0] * alphabet
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            lengths[self.read(8 if wide else 1)] = 1
            if two:
                lengths[self.read(8)] = 1
            return Code(lengths)
        own = [0] * 19
        for place in LENGTH_ORDER[: 4 + self.read(4)]:
            own[place] = self.read(3)
        code = Code(own)
        left = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else alphabet
        at, last = 0, 8
        while at < alphabet and left:
            left -= 1
            s = self.symbol(code)
            if s < 16:
                lengths[at] = s
                at, last = at + 1, s or last
            else:
                times = 3 + self.read(2) if s == 16 else 3 + self.read(3) if s == 17 else 11 + self.read(7)
                times = min(times, alphabet - at)
                lengths[at : at + times] = [last if s == 16 else 0] * times
                at += times
        return Code(lengths)

    def amount(self, prefix: int) -> int:
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


# Decoding.


def _green_samples(reader: Reader, code: Code, n: int) -> np.ndarray:
    """``n`` symbols of one code in a row.

    The code is looked up at every bit position at once; the positions that symbols really start at are
    then found by following the lengths, four symbols a step.
    """
    data = np.frombuffer(reader.data[reader.at >> 3 :] + bytes(4), np.uint8).astype(np.uint32)
    words = data[:-2] | (data[1:-1] << np.uint32(8)) | (data[2:] << np.uint32(16))
    windows = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32(code.mask)).ravel()
    entries = np.array(code.table, np.int32)[windows]
    jump = np.minimum(np.arange(len(windows), dtype=np.int32) + (entries & 15), np.int32(len(windows) - 1))
    twice = jump[jump]
    four = memoryview(twice[twice])
    starts, at = [], reader.at & 7
    for _ in range((n + 3) // 4):
        starts.append(at)
        at = four[at]
    first = np.array(starts, np.int32)
    at = np.stack([first, jump[first], twice[first], jump[twice[first]]], axis=1).ravel()[:n]
    found = entries[at]
    reader.at = (reader.at & ~7) + int(at[-1]) + int(found[-1] & 15)
    reader.check()
    return found >> 4


def _entropy_image(reader: Reader, width: int, height: int, main: bool = False) -> np.ndarray:
    """Pixels as 32-bit ARGB, row by row: literals, back-references and colour cache under one or more code groups."""
    cache_bits = reader.read(4) if reader.read(1) else 0
    groups, which, block = 1, None, 0
    if main and reader.read(1):
        block = reader.read(3) + 2
        across = -(-width >> block)
        which = (_entropy_image(reader, across, -(-height >> block)) >> np.uint32(8)) & np.uint32(0xFFFF)
        groups, which = int(which.max()) + 1, which.reshape(-1, across).tolist()
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = [[reader.code(a + (cache_size if i == 0 else 0)) for i, a in enumerate(ALPHABETS)] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, _ = codes[0]
    if groups == 1 and not cache_bits and green.only is None and all(c.only is not None for c in (red, blue, alpha)) and green.top < 256:
        rest = (alpha.only << 24) | (red.only << 16) | blue.only
        return (_green_samples(reader, green, total).astype(np.uint32) << np.uint32(8)) | np.uint32(rest)
    pixels, cache, at = [0] * total, [0] * cache_size, 0
    while at < total:
        reader.check()
        group = codes[which[at // width >> block][at % width >> block]] if which else codes[0]
        s = reader.symbol(group[0])
        if s < 256:
            r, b = reader.symbol(group[1]), reader.symbol(group[2])
            new = [(reader.symbol(group[3]) << 24) | (r << 16) | (s << 8) | b]
        elif s < 256 + LENGTH_CODES:
            length = reader.amount(s - 256)
            code = reader.amount(reader.symbol(group[4]))
            if code > len(NEAR):
                distance = code - len(NEAR)
            else:
                x, y = NEAR[code - 1]
                distance = max(1, x + y * width)
            if distance > at or at + length > total:
                raise ValueError("back-reference leaves the image")
            source = pixels[at - distance : min(at, at - distance + length)]
            new = (source * (length // len(source) + 1))[:length]
        else:
            new = [cache[s - 256 - LENGTH_CODES]]
        pixels[at : at + len(new)] = new
        at += len(new)
        if cache_size:
            for p in new:
                cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(pixels, np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """The bytes of ARGB pixels: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels.astype("<u4")).view(np.uint8).reshape(*pixels.shape, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels).view("<u4")[..., 0].astype(np.uint32)


def predict(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """The predicted channels of a pixel from its left, top, top-right and top-left neighbours."""
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return mean(mean(left, right), top)
    if mode in (6, 7):
        return mean(left, corner if mode == 6 else top)
    if mode in (8, 9):
        return mean(corner if mode == 8 else right, top)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        from_left = sum(abs(t - c) for t, c in zip(top, corner))
        from_top = sum(abs(a - c) for a, c in zip(left, corner))
        return left if from_left < from_top else top
    if mode == 12:
        return [clamp(a + t - c) for a, t, c in zip(left, top, corner)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), corner)]
    return [0, 0, 0, 255]


def invert_predictor(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Add predictions to residuals. ``pixels`` is height x width; rows whose blocks look left or up only are summed at once."""
    out = _channels(pixels).copy()
    height, width = pixels.shape
    out[0, 0] += np.array([0, 0, 0, 255], np.uint8)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    kinds = (modes >> np.uint32(8)) & np.uint32(15)
    for y in range(1, height):
        out[y, 0] += out[y - 1, 0]
        row = kinds[y >> bits]
        if (row == 2).all():
            out[y, 1:] += out[y - 1, 1:]
        elif (row == 1).all():
            out[y] = np.cumsum(out[y], axis=0, dtype=np.uint8)
        else:
            above, own = out[y - 1].tolist(), out[y].tolist()
            for x in range(1, width):
                right = above[x + 1] if x + 1 < width else own[0]
                guess = predict(int(row[x >> bits]), own[x - 1], above[x], right, above[x - 1])
                own[x] = [(a + b) & 255 for a, b in zip(own[x], guess)]
            out[y] = np.array(own, np.uint8)
    return _packed(out)


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * colour.astype(np.int8).astype(np.int32)) >> 5


def cross_colour(pixels: np.ndarray, factors: np.ndarray, bits: int, sign: int = 1) -> np.ndarray:
    """Undo (``sign`` 1) or apply (-1) the correlation of red and blue with green."""
    height, width = pixels.shape
    c = _channels(pixels).astype(np.int32)
    spread = np.repeat(np.repeat(_channels(factors), 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]
    blue, green, red = c[..., 0], c[..., 1], c[..., 2].copy()
    new_red = (red + sign * _delta(spread[..., 0], green)) & 255
    true_red = new_red if sign > 0 else red
    c[..., 0] = (blue + sign * (_delta(spread[..., 1], green) + _delta(spread[..., 2], true_red))) & 255
    c[..., 2] = new_red
    return _packed(c.astype(np.uint8))


def invert_palette(pixels: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Colours of indexes in green; tables of up to 16 colours hold several indexes a pixel, lowest bits first."""
    index = ((pixels >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    each = 8 if len(table) <= 2 else 4 if len(table) <= 4 else 2 if len(table) <= 16 else 1
    if each > 1:
        size = 8 // each
        index = ((index[:, :, None] >> (np.arange(each) * size)) & ((1 << size) - 1)).reshape(len(index), -1)[:, :width]
    return np.r_[table, np.zeros(256, np.uint32)][index]


def decode(image: bytes) -> np.ndarray:
    """Pixels (height x width, 32-bit ARGB) of one lossless WebP file."""
    if image[:4] != b"RIFF" or image[8:16] != b"WEBPVP8L" or image[20] != SIGNATURE:
        raise ValueError("not a lossless WebP file")
    reader = Reader(image[21 : 20 + int.from_bytes(image[16:20], "little")])
    width, height = reader.read(14) + 1, reader.read(14) + 1
    reader.read(1)
    if reader.read(3):
        raise ValueError("unknown version")
    coded, undo = width, []
    while reader.read(1):
        kind = reader.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = reader.read(3) + 2
            across, down = -(-coded >> bits), -(-height >> bits)
            undo.append((kind, coded, bits, _entropy_image(reader, across, down).reshape(down, across)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, coded, 0, None))
        else:
            size = reader.read(8) + 1
            table = _packed(np.cumsum(_channels(_entropy_image(reader, size, 1)), axis=0, dtype=np.uint8))
            undo.append((kind, coded, 0, table))
            coded = -(-coded // (8 if size <= 2 else 4 if size <= 4 else 2 if size <= 16 else 1))
    pixels = _entropy_image(reader, coded, height, main=True).reshape(height, coded)
    for kind, before, bits, data in reversed(undo):
        if kind == PREDICTOR:
            pixels = invert_predictor(pixels, data, bits)
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, data, bits)
        elif kind == SUBTRACT_GREEN:
            c = _channels(pixels).copy()
            c[..., 0] += c[..., 1]
            c[..., 2] += c[..., 1]
            pixels = _packed(c)
        else:
            pixels = invert_palette(pixels, data, before)
    return pixels


# Encoding of payloads.


class Writer:
    """Bits in writing order: small fields gather in one integer, long runs of symbols in an array."""

    def __init__(self):
        self.head, self.size = 0, 0
        self.body = np.zeros(0, np.uint8)

    def bits(self, value: int, n: int) -> None:
        self.head |= value << self.size
        self.size += n

    def code(self, lengths: list[int]) -> None:
        """A prefix code: one symbol in the short form, more with four bits for each length."""
        used = [s for s, n in enumerate(lengths) if n]
        if len(used) == 1:
            self.bits(0b101 | used[0] << 3, 11)
            return
        self.bits(0, 1)
        self.bits(19 - 4, 4)
        for place in LENGTH_ORDER:
            self.bits(4 if place < 16 else 0, 3)
        count = max(2, used[-1] + 1)
        self.bits(1 | (4 << 1), 4)
        self.bits(count - 2, 10)
        for n in lengths[:count]:
            self.bits(_NIBBLES[n], 4)

    def symbols(self, values: np.ndarray, lengths: list[int]) -> None:
        """The codes of ``values`` in a row, last of all; a code of one symbol writes nothing."""
        if max(lengths) > 1 or sum(lengths) > 1:
            size, places = np.array(lengths), np.arange(max(lengths))
            table = ((np.array(canonical(lengths))[:, None] >> places) & 1).astype(np.uint8)
            self.body = table[values][(places < size[:, None])[values]]

    def done(self) -> bytes:
        head = np.frombuffer(self.head.to_bytes(self.size // 8 + 1, "little"), np.uint8)
        return np.packbits(np.r_[np.unpackbits(head, count=self.size, bitorder="little"), self.body], bitorder="little").tobytes()


#: Sixteen lengths of four bits each: the code of a length is its bits in reading order.
_NIBBLES = canonical([4] * 16)


def encode_samples(samples: np.ndarray) -> bytes:
    """A lossless WebP file of 64 samples a row: green is the sample, through a sorted palette and one prefix code."""
    height = len(samples) // WIDTH
    seen = np.bincount(samples, minlength=256)
    values = np.flatnonzero(seen)
    place = np.zeros(256, np.uint8)
    place[values] = np.arange(len(values))
    packed, counts = place[samples], seen[values]
    each = 8 if len(values) <= 2 else 4 if len(values) <= 4 else 2 if len(values) <= 16 else 1
    out = Writer()
    out.bits(SIGNATURE, 8), out.bits(WIDTH - 1, 14), out.bits(height - 1, 14), out.bits(0, 4)
    out.bits(1 | PALETTE << 1, 3), out.bits(len(values) - 1, 8)
    _literals(out, np.diff(values, prepend=0).tolist(), [255] + [0] * (len(values) - 1))
    out.bits(0, 1)
    if each > 1:
        size = 8 // each
        packed = (packed.reshape(height, -1, each).astype(np.int64) << (np.arange(each) * size)).sum(axis=2).ravel()
        counts = np.bincount(packed, minlength=256)
    lengths = huffman_lengths(counts.tolist())
    out.bits(0, 1), out.bits(0, 1)
    out.code(lengths)
    for only in (0, 0, 255, 0):
        out.code(_single(only))
    out.symbols(packed, lengths)
    data = out.done()
    data += bytes(len(data) % 2)
    return b"RIFF" + (len(data) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def _single(symbol: int) -> list[int]:
    return [0] * symbol + [1]


def _literals(out: Writer, greens: list[int], alphas: list[int]) -> None:
    """A small entropy-coded image of literal pixels that differ in green and alpha only."""
    out.bits(0, 1)
    codes = []
    for i, values in enumerate((greens, [0], [0], alphas, [0])):
        counts = [0] * (max(values) + 1)
        for v in values:
            counts[v] += 1
        lengths = huffman_lengths(counts)
        out.code(lengths)
        if i in (0, 3):
            codes.append((canonical(lengths), lengths if sum(lengths) > 1 else [0] * len(lengths)))
    for pair in zip(greens, alphas):
        for v, (code, lengths) in zip(pair, codes):
            out.bits(code[v], lengths[v])


def payload(text: bytes) -> bytes:
    """The bytes padded with zeros to a positive multiple of 64."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def encode_payload(data: bytes) -> list[bytes]:
    """Images of at most 16,384 rows, in order."""
    samples = np.frombuffer(data, np.uint8)
    step = WIDTH * MAX_SIDE
    return [encode_samples(samples[i : i + step]) for i in range(0, len(samples), step)]


def decode_payload(images: list[bytes]) -> bytes:
    return b"".join(((decode(i) >> np.uint32(8)) & np.uint32(255)).astype(np.uint8).tobytes() for i in images)


def write_media(docs: DataFrame, folder: str) -> None:
    """Store every text (null: empty) as images: (doc_id, n_bytes, images), one row per input row, no shuffle."""

    def run(batch):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        images = [encode_payload(payload(t)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(images, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "images"])

    kind = dict(docs.dtypes)["doc_id"]
    map_rows(docs.select("doc_id", "text"), "text", run, f"doc_id {kind}, n_bytes long, images array<binary>", 1 << 20).write.parquet(folder)


def read_media(media: DataFrame) -> DataFrame:
    """Decode stored images into payloads and features.

    Columns: doc_id, n_bytes, payload, media_bytes, media_sha256 (of the files in a row) and feature: counts of
    samples by their four high bits, then height and mean sample in thousandths, joined by commas.
    """

    def run(batches):
        for batch in slices(batches, "_size", 1 << 20):
            rows = [row(images) for images in batch.column("images").to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "feature"])

    def row(images):
        data, stored = decode_payload(images), b"".join(images)
        samples = np.frombuffer(data, np.uint8)
        bins = np.bincount(samples >> 4, minlength=16)
        mean = int(samples.sum(dtype=np.int64)) * 1000 // len(samples)
        return data, len(stored), hashlib.sha256(stored).hexdigest(), ",".join(map(str, [*bins.tolist(), len(samples) // WIDTH, mean]))

    kind = dict(media.dtypes)["doc_id"]
    sized = media.withColumn("_size", F.col("images")[0])
    return sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame) -> DataFrame:
    """Write the documents as media into the shared folder and read them back."""
    folder = f"{shared_folder(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    write_media(docs, folder)
    return read_media(docs.sparkSession.read.parquet(folder))
