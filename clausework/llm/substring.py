"""Repeated passages: joins of winnowed blocks and windows with all earlier text, in place of a greedy relative Lempel-Ziv parse."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausework.llm.common import map_rows, materialize
from clausework.llm.neardup import _scramble

WINDOW = 20
ANCHOR = 6
REACH = WINDOW - ANCHOR + 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to the longest document seen."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        made = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS[size] = tuple(made)
    return _POWERS[size]


class Parsed:
    """Word hashes of one document with the blocks its windows fall into.

    A window of 20 words belongs to the anchor that has the least hash among its 15 six-word runs, so equal
    windows have equal anchors wherever they stand. A block is the stretch of words that the consecutive
    windows of one anchor cover.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, down = _powers(n + 1)
        self.prefix = np.r_[np.zeros(1, np.uint64), np.cumsum(_scramble(words + np.uint64(1)) * up[:n], dtype=np.uint64)]
        self.down = down
        runs = _scramble(self.span(np.arange(n - ANCHOR + 1), ANCHOR))
        at = np.lib.stride_tricks.sliding_window_view(runs, REACH).argmin(axis=1) + np.arange(n - WINDOW + 1)
        self.first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        self.windows = np.diff(np.r_[self.first, len(at)])
        place = at[self.first]
        self.anchors = runs[place]
        self.blocks = _scramble(self.span(self.first, self.windows + WINDOW - 1)) ^ _scramble((place - self.first).astype(np.uint64) + np.uint64(64) * self.windows.astype(np.uint64))

    def span(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of the words from ``start`` on, the same wherever they stand."""
        return (self.prefix[start + length] - self.prefix[start]) * self.down[start]


def _word_hashes():
    return F.transform(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _rows(batch: pa.RecordBatch):
    words = batch.column("words")
    ends, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b - a >= WINDOW:
            yield i, flat[a:b]


def _table(batch: pa.RecordBatch, found: list, names: list[str]) -> pa.RecordBatch:
    """Rows of several documents as one batch: the document's id, then the arrays of ``found`` (index, arrays)."""
    index = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
    doc_id = batch.column("doc_id").take(pa.array(index))
    columns = [pa.array(np.concatenate([f[1 + k] for f in found]) if found else np.zeros(0, np.int64)) for k in range(len(names) - 1)]
    return pa.RecordBatch.from_arrays([doc_id, *columns], names=names)


def index_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, anchor, block, start, windows): every reference block of every document."""

    def run(batch):
        found = []
        for i, words in _rows(batch):
            p = Parsed(words)
            found.append((i, p.anchors.view(np.int64), p.blocks.view(np.int64), p.first.astype(np.int32), p.windows.astype(np.int32)))
        return _table(batch, found, ["doc_id", "anchor", "block", "start", "windows"]) if found else _table(batch, [(0, *(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)))], ["doc_id", "anchor", "block", "start", "windows"])

    rows = docs.select("doc_id", _word_hashes().alias("words"))
    return map_rows(rows, "words", run, f"doc_id {dict(docs.dtypes)['doc_id']}, anchor long, block long, start int, windows int", 1 << 19)


def window_rows(opened: DataFrame) -> DataFrame:
    """(doc_id, anchor, window, start): the windows of the blocks that start at ``starts`` in each document."""

    def run(batch):
        found, starts = [], batch.column("starts").to_pylist()
        for i, words in _rows(batch):
            p = Parsed(words)
            at = np.isin(p.first, np.array(starts[i]))
            sizes = p.windows[at]
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = np.repeat(p.first[at], sizes) + inside
            found.append((i, np.repeat(p.anchors[at], sizes).view(np.int64), p.span(start, WINDOW).view(np.int64), start.astype(np.int32)))
        return _table(batch, found or [(0, *(np.zeros(0, t) for t in (np.int64, np.int64, np.int32)))], ["doc_id", "anchor", "window", "start"])

    rows = opened.select("doc_id", _word_hashes().alias("words"), "starts")
    return map_rows(rows, "words", run, f"doc_id {dict(opened.dtypes)['doc_id']}, anchor long, window long, start int", 1 << 19)


def factors(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, ref_doc, ref_start): stretches of words whose windows all start earlier elsewhere.

    The index holds each block of all documents with its first place. Parsing a document, a block that
    the index has from an earlier place is a factor as a whole. A first block whose anchor also stands in
    other surroundings lies at a factor's border: its windows are looked up one by one among the
    windows of the other first blocks of that anchor. Anchors that occur once are dropped
    after being counted. Hash keys are 128 bits wide (anchor with block or window). Keys of any
    frequency are pre-aggregated before the shuffle; the joins back have one row on the index side.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    blocks = index_blocks(known)
    counts = blocks.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("block") != F.max("block")).alias("mixed")).where("n > 1").select("anchor", "mixed")
    repeated = materialize(blocks.join(counts, "anchor"), "passages-blocks")
    place = F.struct("doc_id", "start")
    firsts = repeated.groupBy("anchor", "block").agg(F.min(place).alias("ref"))
    placed = materialize(repeated.join(firsts, ["anchor", "block"]), "passages-placed")
    own = (F.col("ref.doc_id") == F.col("doc_id")) & (F.col("ref.start") == F.col("start"))
    whole = placed.where(~own).select("doc_id", "start", (F.col("windows") + WINDOW - 1).alias("length"), F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start"))
    starts = placed.where(own & F.col("mixed")).groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    windows = materialize(window_rows(known.select("doc_id", "text").join(starts, "doc_id")), "passages-windows")
    earliest = windows.groupBy("anchor", "window").agg(F.min(place).alias("ref"), F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.join(earliest, ["anchor", "window"]).where(~own).select("doc_id", "start", F.lit(WINDOW).alias("length"), F.col("ref.doc_id").alias("ref_doc"), F.col("ref.start").alias("ref_start"))
    return materialize(whole.unionByName(single), "passages-factors")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (words joined by one space), kept_sha256 and n_factors, one row per input row.

    Removed is each word covered by a window of 20 words that also starts earlier (smaller doc_id, or same
    document and earlier start), judged on the input. Null text has no words. Rows with a null doc_id are compared with
    nothing. Rows that repeat a doc_id count as one place in the order: equal texts are treated alike, and
    of different texts under one id each loses the stretches found in any.
    """
    spans = factors(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "ref_doc", "ref_start")).alias("spans"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")

    def run(batch):
        sizes, removed, texts, digests, n_factors = [], [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            words = (text or "").encode().split()  # splits at exactly the six ASCII blanks
            gone, parts, following = np.zeros(len(words) + 1, np.int32), 0, None
            for s in sorted(spans or [], key=lambda s: (s["start"], s["length"])):
                gone[min(s["start"], len(words))] += 1
                gone[min(s["start"] + s["length"], len(words))] -= 1
                shift = (s["ref_doc"], s["ref_start"] - s["start"])
                parts += shift != following  # blocks that go on in the same reference are one factor
                following = shift
            covered = np.cumsum(gone)[:-1] > 0
            kept = b" ".join([w for w, c in zip(words, covered.tolist()) if not c] if spans else words)
            sizes.append(len(words)), removed.append(int(covered.sum())), texts.append(kept.decode())
            digests.append(hashlib.sha256(kept).hexdigest()), n_factors.append(parts)
        columns = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.string()), pa.array(n_factors, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "n_factors"])

    return map_rows(joined, "text", run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_text string, kept_sha256 string, n_factors long")
