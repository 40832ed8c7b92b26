"""Phrase collocations: Rabin-Karp fingerprints count n-grams, and only the text of frequent ones is ever built."""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from clausework.llm.common import map_rows, slices
from clausework.llm.pretokens import flat
from clausework.scratch import materialize

LONGEST, LEAST, TOP = 5, 100, 2000
#: Fingerprints a task gathers before it sorts and counts them, windows hashed at once, and the largest bit map of frequent ones (2^26 bits: 8 MB).
BUFFER, WINDOWS, MAP_BITS = 3_000_000, 1 << 15, 26
#: Tasks among which a language's phrases are ranked before its best ones meet.
SALTS = 64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 … base^(n - 1) modulo 2^64."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 1 << 18), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][:n]


def window_hashes(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial of every window [start, end) of ``values`` (plus one), from differences of prefix sums scaled by inverse powers.

    Windows come in order. They are handled some ten thousand at a time, so the tables of powers stay small.
    """
    inverse = pow(base, -1, 1 << 64)
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), WINDOWS):
        part = slice(i, i + WINDOWS)
        first, last = starts[part][0], ends[part][-1]
        own = values[first:last].astype(np.uint64) + np.uint64(1)
        prefix = np.r_[np.uint64(0), np.cumsum(own * powers(inverse, len(own)), dtype=np.uint64)]
        out[part] = (prefix[ends[part] - first] - prefix[starts[part] - first]) * powers(base, len(own) + 1)[ends[part] - first]
    return out


class Words:
    """Words of a slice of texts: where they lie, the piece each belongs to, and their fingerprints."""

    def __init__(self, texts: pa.StringArray, langs: pa.StringArray):
        import pyarrow.compute as pc

        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.data = _LOWER[np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        kind = _KIND[self.data]
        inside = kind == 0
        edge = np.zeros(len(self.data) + 1, bool)
        edge[begins] = True
        edge[len(self.data)] = True
        self.starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]] | inside & edge[:-1]) if len(inside) else np.zeros(0, np.int64)
        self.ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1 if len(inside) else np.zeros(0, np.int64)
        breaks = np.flatnonzero((kind == 2) | edge[:-1])
        self.piece = np.searchsorted(breaks, self.starts, "right")
        codes = langs.dictionary_encode()
        self.langs = codes.dictionary.to_pylist()
        self.lang = codes.indices.to_numpy()[np.searchsorted(ends, self.starts, "right")] if len(self.starts) else np.zeros(0, np.int64)
        self.word = mix(window_hashes(self.data, BYTE_BASE, self.starts, self.ends))
        salts = np.array([_salt(l) for l in self.langs], np.uint64)
        self.salt = salts[self.lang] if len(self.langs) else np.zeros(0, np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every run of ``n`` words inside one piece; language and length go into the fingerprint."""
        count = max(0, len(self.starts) - n + 1)
        at = np.flatnonzero(self.piece[:count] == self.piece[n - 1 :][:count])
        return at, mix(window_hashes(self.word, WORD_BASE, at, at + n) ^ self.salt[at] ^ np.uint64(n))

    def text(self, at: int, n: int) -> str:
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + n)).decode()

    @functools.cached_property
    def first(self) -> np.ndarray | None:
        """For every word the first word of the slice with its fingerprint; None if two different words share one."""
        _, index, inverse = np.unique(self.word, return_index=True, return_inverse=True)
        first, size = index[inverse], self.ends - self.starts
        if not np.array_equal(size, size[first]):
            return None
        same = np.array_equal(self.data[flat(self.starts, size)], self.data[flat(self.starts[first], size)])
        return first if same else None

    def counted(self, at: np.ndarray, prints: np.ndarray, n: int) -> Iterator[tuple[int, str, int]]:
        """(language, phrase, times) of the given runs. Each run is compared with the text behind the first occurrence of its fingerprint."""
        _, index, inverse, times = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        origin = at[index][inverse]
        same = self.first is not None and np.array_equal(self.lang[at], self.lang[origin])
        same = same and all(np.array_equal(self.first[at + j], self.first[origin + j]) for j in range(n))
        if same:
            for i, t in zip(at[index].tolist(), times.tolist()):
                yield int(self.lang[i]), self.text(i, n), t
        else:  # two phrases share a fingerprint: count by text
            for (lang, phrase), t in Counter((int(self.lang[i]), self.text(i, n)) for i in at.tolist()).items():
                yield lang, phrase, t


def _salt(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang)


def known(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the bit map may hold each fingerprint."""
    place = prints >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def linked_runs(words: Words, n: int, pairs: np.ndarray | None, good: np.ndarray | None):
    """Runs of ``n`` words all of whose neighbouring pairs may be frequent (``good`` by first word)."""
    at, prints = words.grams(n)
    if n > 2 and pairs is not None:
        keep = np.ones(len(at), bool)
        for j in range(n - 1):
            keep &= good[at + j]
        at, prints = at[keep], prints[keep]
    return at, prints


def good_pairs(words: Words, pairs: np.ndarray | None) -> np.ndarray | None:
    if pairs is None:
        return None
    at, prints = words.grams(2)
    good = np.zeros(len(words.starts) + 1, bool)
    good[at[known(pairs, prints)]] = True
    return good


def count_fingerprints(docs: DataFrame, lengths: tuple[int, ...], pairs=None) -> DataFrame:
    """(print, times) of the runs of the given lengths; a task sorts and counts its fingerprints before they are shuffled."""

    def flush(found: list[np.ndarray]):
        values = np.sort(np.concatenate(found))
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        times = np.diff(np.r_[starts, len(values)])
        for i in range(0, len(starts), 1 << 18):
            part = slice(i, i + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(values[starts[part]].view(np.int64)), pa.array(times[part])], names=["print", "times"])

    def run(batches):
        found, size = [], 0
        bits = pairs.value if pairs is not None else None
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), batch.column("lang"))
            good = good_pairs(words, bits)
            for n in lengths:
                found.append(linked_runs(words, n, bits, good)[1])
                size += len(found[-1])
            if size > BUFFER:
                yield from flush(found)
                found, size = [], 0
        if size:
            yield from flush(found)

    return docs.mapInArrow(run, "print long, times long").groupBy("print").agg(F.sum("times").alias("times"))


def bit_map(frequent: DataFrame, bits: int = MAP_BITS):
    """Broadcast a bit map of the fingerprints, of at most 2^``bits`` bits. What shares a bit with them is sorted out by exact counts."""
    count = frequent.count()
    bits = max(16, min(bits, (count * 16).bit_length()))
    place = F.shiftrightunsigned("print", 64 - bits)
    one = F.expr("shiftleft(1L, int(place & 63))")
    cells = frequent.select(place.alias("place")).groupBy((F.col("place") / 64).cast("long").alias("cell")).agg(F.bit_or(one).alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells["cell"].to_numpy()] = cells["value"].to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(out)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Exact counts of all phrases of one to five words that occur at least ``least`` times in a language.

    Three passes over the texts. Words and pairs are counted by fingerprint; longer runs only where each neighbouring pair
    is frequent, as it must be; the last pass looks for frequent fingerprints, checks every occurrence against
    the text behind the first one of its slice and counts by text. A shared fingerprint can only let a rare phrase through to
    these counts, never change or lose one. Rows: lang, words, phrase, times; one row per language with words 0 holds
    the number of its words. Null text has no words, null lang is ``und``.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    short = materialize(count_fingerprints(docs, (1, 2)).where(F.col("times") >= least), "prints")
    pairs = bit_map(short)
    long = count_fingerprints(docs, tuple(range(3, LONGEST + 1)), pairs).where(F.col("times") >= least)
    every = bit_map(materialize(short.unionByName(long), "prints"))

    def run(batch):
        words, rows = Words(batch.column("text"), batch.column("lang")), []
        bits = every.value
        good = good_pairs(words, bits)
        for n in range(1, LONGEST + 1):
            at, prints = linked_runs(words, n, bits, good)
            keep = known(bits, prints)
            rows += [(lang, n, phrase, t) for lang, phrase, t in words.counted(at[keep], prints[keep], n)]
        rows += [(lang, 0, "", t) for lang, t in enumerate(np.bincount(words.lang, minlength=len(words.langs)).tolist())]
        lang, n, phrase, times = zip(*rows) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array([words.langs[i] for i in lang], pa.string()), pa.array(n, pa.int32()), pa.array(phrase, pa.string()), pa.array(times, pa.int64())], names=["lang", "words", "phrase", "times"]
        )

    counted = map_rows(docs, "text", run, "lang string, words int, phrase string, times long")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("times").alias("times")).where((F.col("times") >= least) | (F.col("words") == 0))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of two to five words of each language by the association of their weakest cut.

    A phrase is left out if a phrase one word longer around it occurs as often: any longer phrase that occurs as often
    holds such a one, because counts never rise with length. Products are decimals of 38 digits. Phrases are ranked in salted parts of a
    language first, so its candidates never meet in one task. Equal scores: the more frequent, then the smaller phrase
    in byte order. Columns: lang, rank, phrase, a, l, r, n, score. An empty table has no rows; columns other than text and lang are not read.
    """
    grams = materialize(frequent_phrases(docs, least), "phrases")
    totals = grams.where("words = 0").select("lang", F.col("times").alias("n"))
    parts = grams.where("words > 0").select("lang", "phrase", "times")
    candidates = grams.where("words > 1")
    ends = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))
    longer = candidates.where("words > 2").select("lang", F.explode(ends).alias("phrase"), "times")
    kept = candidates.join(longer, ["lang", "phrase", "times"], "left_anti")
    cuts = kept.select("lang", "phrase", "words", F.col("times").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("times").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("times").alias("r"))
    score = F.expr("(cast(1000 * a as decimal(22, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang").withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
