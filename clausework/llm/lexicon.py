"""BPE by a lexicon: frequent words are read off a minimal acyclic transducer, all others are merged exactly.

The transducer accepts the frequent pre-tokenizer matches of a corpus. Its states are shared between equal
suffixes; the numbers on the path of a word add up to the word's place in the table of token ids. It is compiled once
on the driver (at most ``WORDS`` words), written as one flat file that Spark hands to every executor, and mapped into
memory there, so that the workers of a machine share its pages. A slice of documents is cut into matches with
numpy, each distinct match is looked up once, and all distinct unseen matches are merged together, one merge a word and round.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import tempfile
import uuid
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from clausework.llm.common import lists, map_rows
from clausework.llm.pretokens import character_classes, cut_texts, flat
from clausework.scratch import materialize

#: Words of the lexicon. Bounds speed, never results.
WORDS = 65_536
#: Bytes from which a match is merged alone by a queue instead of with the others in rounds.
LONG = 256
NONE = np.iinfo(np.int64).max


class IntTable(NamedTuple):
    """Open-addressing table from non-negative integers to integers, looked up for whole arrays."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def _slots(keys: np.ndarray, size: int) -> np.ndarray:
        bits = np.uint64(64 - (size.bit_length() - 1))
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> bits).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> IntTable:
        size = 1 << max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        table, stored = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        slots, left = cls._slots(keys, size), np.arange(len(keys))
        while len(left):
            free = left[table[slots[left]] < 0]
            table[slots[free]] = keys[free]  # of several in one slot the last stays
            stored[slots[free]] = values[free]
            left = left[table[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & (size - 1)
        return cls(table, stored)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        out = np.full(len(keys), default, np.int64)
        slots, left = self._slots(keys, len(self.keys)), np.arange(len(keys))
        while len(left):
            found = self.keys[slots[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (found >= 0)]
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
        return out


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary: visible Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Merger:
    """The vocabulary of a tokenizer file: exact merging of byte strings, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [b""] * size
        for token, i in vocab.items():
            names[i] = bytes(map(letters.__getitem__, token))
        for content, i in self.special.items():
            names[i] = content
        lengths = np.array(list(map(len, names)), np.int64)
        self.token_bytes, self.token_size = np.frombuffer(b"".join(names), np.uint8), lengths
        self.token_start = np.cumsum(lengths) - lengths
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.base = size
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        # rank above, id of the merged token below
        self.ranks = IntTable.build(keys, np.array([(r << 32) | vocab[a + b] for r, (a, b) in enumerate(pairs)], np.int64))

    def merge_all(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every byte string (none empty) of ``data``: (ids, number of ids of each string).

        Every round makes one merge in each string that still has one: the pair of lowest rank, leftmost first.
        """
        long = np.flatnonzero(sizes > LONG)
        if len(long):
            return self._with_long(data, sizes, long)
        out = np.zeros(len(data), np.int64)  # ids of string w lie from its first byte on
        counts = sizes.copy()
        base = np.cumsum(sizes) - sizes
        symbols = self.byte_ids[data]
        word = np.repeat(np.arange(len(sizes)), sizes)
        ranks = self._ranks(symbols, word)
        size = sizes.copy()
        alive = np.arange(len(sizes))
        while len(alive):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat((ranks >> 32 << 9) | np.where(ranks == NONE, 0, np.arange(len(ranks)) - np.repeat(starts, size)), starts)
            done = best >> 9 == NONE >> 32
            if done.any():
                ends = np.repeat(done, size)
                out[flat(base[alive[done]], size[done])] = symbols[ends]
                counts[alive[done]] = size[done]
                keep = ~ends
                symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
                alive, size, best = alive[~done], size[~done], best[~done]
                starts = np.cumsum(size) - size
                if not len(alive):
                    break
            at = starts + (best & 511)
            symbols[at] = ranks[at] & 0xFFFFFFFF
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, ranks = symbols[keep], word[keep], ranks[keep]
            at -= np.arange(len(at))  # one symbol left in every string before it
            size = size - 1
            changed = np.r_[at, at[at > 0] - 1]
            ranks[changed] = self._pair_ranks(symbols, word, changed)
        return out[flat(base, counts)], counts

    def _ranks(self, symbols, word):
        return self._pair_ranks(symbols, word, np.arange(len(symbols)))

    def _pair_ranks(self, symbols, word, at):
        after = np.minimum(at + 1, len(symbols) - 1)
        found = self.ranks.get(symbols[at] * self.base + symbols[after], NONE)
        return np.where((after > at) & (word[at] == word[after]), found, NONE)

    def _with_long(self, data, sizes, long):
        ends = np.cumsum(sizes)
        short = sizes <= LONG
        ids, counts = self.merge_all(data[np.repeat(short, sizes)], sizes[short]) if short.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts, per = np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [], np.zeros(len(sizes), np.int64)
        queue = iter(parts)
        out = [self.merge_long(data[ends[i] - sizes[i] : ends[i]]) if sizes[i] > LONG else next(queue) for i in range(len(sizes))]
        per[:] = [len(x) for x in out]
        return np.concatenate(out), per

    def merge_long(self, data: np.ndarray) -> np.ndarray:
        """The same merges for one long string, from a queue of pairs: n log n."""
        symbols = self.byte_ids[data].tolist()
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        first = self._ranks(np.array(symbols), np.zeros(n, np.int64)).tolist()
        queue = [(r >> 32, i, r & 0xFFFFFFFF, symbols[i], symbols[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(queue)
        while queue:
            _, i, merged, a, b = heapq.heappop(queue)
            j = after[i] if symbols[i] == a else -1
            if j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = merged, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    r = int(self.ranks.get(np.array([symbols[x] * self.base + symbols[y]]), NONE)[0])
                    if r != NONE:
                        heapq.heappush(queue, (r >> 32, x, r & 0xFFFFFFFF, symbols[x], symbols[y]))
        return np.array([s for s in symbols if s >= 0], np.int64)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        return self.token_bytes[flat(self.token_start[ids], self.token_size[ids])]


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def minimal_automaton(words: list[bytes]) -> tuple[list[dict[int, int]], list[bool]]:
    """Transitions and final flags of the minimal acyclic automaton of sorted distinct ``words``; state 0 is the start.

    Words come in order, so what hangs below the last common prefix never changes again and is
    replaced by an equal state met before, deepest first.
    """
    moves: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]
    previous = b""

    def close(depth: int) -> None:
        for i in range(len(path) - 1, depth, -1):
            state = path.pop()
            key = (final[state], tuple(moves[state].items()))
            same = known.setdefault(key, state)
            if same != state:
                moves[path[-1]][previous[i - 1]] = same
                free.append(state)

    free: list[int] = []
    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(word, previous)) if a != b), min(len(word), len(previous)))
        close(common)
        for byte in word[common:]:
            if free:
                state = free.pop()
                moves[state], final[state] = {}, False
            else:
                state = len(moves)
                moves.append({})
                final.append(False)
            moves[path[-1]][byte] = state
            path.append(state)
        final[path[-1]] = True
        previous = word
    close(0)
    for state in free:
        moves[state] = {}
    return moves, final


class Lexicon(NamedTuple):
    """The compiled transducer: transitions by (state, byte), whether a state ends a word, and the ids of each word."""

    longest: int
    moves: IntTable  # state * 256 + byte -> next state << 32 | words that sort before
    final: np.ndarray
    first: np.ndarray  # ids of word w are ids[first[w] : first[w + 1]]
    ids: np.ndarray

    def words_of(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each byte string in the lexicon, or -1: all strings take their steps together."""
        number = np.full(len(sizes), -1, np.int64)
        left = np.flatnonzero(sizes <= self.longest)
        state, total = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        step = 0
        while len(left):
            ends = sizes[left] == step
            won = ends & self.final[state]
            number[left[won]] = total[won]
            left, state, total = left[~ends], state[~ends], total[~ends]
            move = self.moves.get(state * 256 + data[starts[left] + step], -1)
            on = move >= 0
            left, state, total = left[on], move[on] >> 32, total[on] + (move[on] & 0xFFFFFFFF)
            step += 1
        return number


def compile_lexicon(words: list[bytes], tool: Merger) -> Lexicon:
    words = sorted(set(w for w in words if w))
    moves, final = minimal_automaton(words)
    below = [0] * len(moves)  # words that can be read from a state; targets of a state are counted first
    seen = [False] * len(moves)
    stack = [0]
    while stack:
        state = stack[-1]
        open_ = [t for t in moves[state].values() if not seen[t]]
        if open_:
            stack += open_
            continue
        stack.pop()
        if not seen[state]:
            seen[state] = True
            below[state] = final[state] + sum(below[t] for t in moves[state].values())
    keys, values = [], []
    for state, out in enumerate(moves):
        before = int(final[state])
        for byte, target in sorted(out.items()):
            keys.append(state * 256 + byte)
            values.append((target << 32) | before)
            before += below[target]
    data = np.frombuffer(b"".join(words), np.uint8)
    ids, counts = tool.merge_all(data, np.array(list(map(len, words)), np.int64)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Lexicon(max(map(len, words), default=-1), IntTable.build(np.array(keys, np.int64), np.array(values, np.int64)), np.array(final), np.r_[0, np.cumsum(counts)], ids)


def save_lexicon(lexicon: Lexicon, path: str) -> None:
    """One flat file of 64-bit integers: the sizes of its parts, then the parts."""
    parts = [np.array([lexicon.longest]), lexicon.moves.keys, lexicon.moves.values, lexicon.final.astype(np.int64), lexicon.first, lexicon.ids]
    np.concatenate([np.array([len(p) for p in parts]), *parts]).astype("<i8").tofile(path)


@functools.lru_cache(maxsize=2)
def open_lexicon(path: str) -> Lexicon:
    """The file of ``save_lexicon`` mapped into memory; nothing is read but the pages that lookups touch."""
    data = np.memmap(path, "<i8", "r")
    ends = 6 + np.cumsum(data[:6])
    longest, keys, values, final, first, ids = (data[e - n : e] for n, e in zip(data[:6], ends))
    return Lexicon(int(longest[0]), IntTable(keys, values), final != 0, first, ids)


def frequent_words(docs: DataFrame, path: str, text: str = "text", words: int = WORDS) -> list[bytes]:
    """At most ``words`` matches, the most frequent ones of all texts.

    The least number of times is read off a histogram first, so no more than ``words`` rows reach the driver.
    """

    def count(batch):
        pieces = cut_texts(batch.column(text), character_classes(path)).values.dictionary_encode()
        times = np.bincount(pieces.indices.to_numpy(), minlength=len(pieces.dictionary))
        return pa.RecordBatch.from_arrays([pieces.dictionary, pa.array(times.astype(np.int64))], names=["word", "times"])

    counts = map_rows(docs.select(text).where(F.col(text).isNotNull()), text, count, "word binary, times long").where("length(word) <= 64").groupBy("word").agg(F.sum("times").alias("times"))
    counts = materialize(counts, "words")
    least, total = 1, 0
    for times, n in sorted(map(tuple, counts.groupBy("times").count().collect()), reverse=True):  # few rows: the sum of all different times is at most that of the words
        total += n
        if total > words:
            least = times + 1
            break
    return [bytes(r[0]) for r in counts.where(F.col("times") >= least).select("word").collect()]


def distribute(docs: DataFrame, path: str, **bounds) -> str:
    """Compile the lexicon of ``docs`` and hand its file to all executors; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}"
    local = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / name
    save_lexicon(compile_lexicon(frequent_words(docs, path, **bounds), merger(path)), str(local))
    docs.sparkSession.sparkContext.addFile(str(local))
    return name


class Encoded(NamedTuple):
    ids: np.ndarray
    sizes: np.ndarray


def encode_texts(texts: pa.StringArray, path: str, lexicon: Lexicon) -> Encoded:
    """Ids of every text (no nulls), as the tokenizers library gives them without a post-processor."""
    tool = merger(path)
    if len(tool.special) > 1:
        raise ValueError("more than one added token")
    name = next(iter(tool.special), b"")
    pieces = cut_texts(texts, character_classes(path), name)
    coded = pieces.values.dictionary_encode()
    # starts and ids of each distinct match in one pool: the lexicon's ids, then those of unseen matches, then the added token
    offsets, data = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: len(coded.dictionary) + 1].astype(np.int64), coded.dictionary.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin, length = offsets[:-1], np.diff(offsets)
    number = lexicon.words_of(data, begin, length)
    known = number >= 0
    first, size = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    first[known] = lexicon.first[number[known]]
    size[known] = lexicon.first[number[known] + 1] - first[known]
    unseen = np.flatnonzero(~known)
    ids, counts = tool.merge_all(data[flat(begin[unseen], length[unseen])], length[unseen]) if len(unseen) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    first[unseen] = len(lexicon.ids) + np.cumsum(counts) - counts
    size[unseen] = counts
    pool = np.concatenate([lexicon.ids, ids, [tool.special.get(name, 0)]])
    if name:
        added = coded.dictionary.index(pa.scalar(name, pa.binary())).as_py()
        if added >= 0:
            first[added], size[added] = len(pool) - 1, 1
    which = coded.indices.to_numpy()
    per_piece = size[which]
    totals = np.r_[0, np.cumsum(per_piece)]
    bounds = np.r_[0, np.cumsum(pieces.per_text)]
    return Encoded(pool[flat(first[which], per_piece)], np.diff(totals[bounds]))


def decode_ids(ids: np.ndarray, sizes: np.ndarray, path: str) -> list[str]:
    """Text of each run of ids; bytes that are not UTF-8 become replacement characters."""
    tool = merger(path)
    raw = tool.bytes_of(ids).tobytes()
    ends = np.r_[0, np.cumsum(tool.token_size[ids])][np.r_[0, np.cumsum(sizes)]].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]


def encode_documents(docs: DataFrame, path: str, text: str = "text", **bounds) -> DataFrame:
    """Ids of every whole text with the digests of ids and of the decoded text, one row per input row.

    Null text is the empty text, which has no ids; the added token's name in a text is that token. Repeated
    rows stay, a null doc_id stays null, other columns are not read. Two passes over the rows without a shuffle of texts: one counts
    the words for the lexicon, one encodes. The lexicon never changes a result. Columns: doc_id, ids, n_tokens,
    ids_sha256, decoded_sha256.
    """
    name = distribute(docs, path, text=text, **bounds)

    def run(batch):
        coded = encode_texts(batch.column(text).fill_null(""), path, open_lexicon(SparkFiles.get(name)))
        ends = np.r_[0, np.cumsum(coded.sizes)]
        raw = coded.ids.astype("<u4").tobytes()
        digests = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        decoded = [hashlib.sha256(t.encode()).hexdigest() for t in decode_ids(coded.ids, coded.sizes, path)]
        ids = lists(ends, coded.ids.astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(coded.sizes), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", text), text, run, f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
