"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from clausework.llm.common import lists, map_rows, slices
from clausework.llm.pretokens import BLANK, character_classes, cut_texts, flat

ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


#: Matches that are remembered, and the longest of them.
CACHE_ENTRIES, CACHE_BYTES = 400_000, 48


class PieceEncoder:
    """Ids of all texts of a slice: texts are cut into pre-tokenizer matches, and the library encodes each distinct one once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.classes = character_classes(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if len(added) > 1:
            raise ValueError("more than one added token")
        self.special = next((t.content.encode() for t in added.values()), b"")
        self.known, self.pool, self.sizes = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int64)
        (self.line_feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def distinct(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece). Pieces that are not blank are encoded as the lines of one text."""
        text = [p.decode() for p in pieces]
        blank = np.array([self.classes[ord(t[-1])] == BLANK for t in text], bool)
        lines = [t for t, b in zip(text, blank) if not b]
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(ids == self.line_feed)
        if len(lines) != len(cuts) + 1 and lines:
            raise ValueError("pieces and their ids do not line up")
        sizes = np.zeros(len(pieces), np.int64)
        sizes[~blank] = np.diff(np.r_[-1, cuts, len(ids)]) - 1 if lines else 0
        odd = [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int32) for t, b in zip(text, blank) if b]
        sizes[blank] = [len(x) for x in odd]
        out = np.zeros(sizes.sum(), np.int32)
        starts = np.cumsum(sizes) - sizes
        out[flat(starts[~blank], sizes[~blank])] = ids[ids != self.line_feed]
        out[flat(starts[blank], sizes[blank])] = np.concatenate(odd) if odd else []
        return out, sizes

    def ids(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Matches of earlier slices are looked up, new short ones are remembered."""
        pieces = cut_texts(texts, self.classes, self.special)
        coded = pieces.values.dictionary_encode()
        seen = pc.index_in(coded.dictionary, self.known)
        missing = coded.dictionary.filter(pc.is_null(seen))
        ids, size = self.distinct(missing.to_pylist())
        pool, sizes = np.concatenate([self.pool, ids]), np.r_[self.sizes, size]
        slot = seen.to_numpy(zero_copy_only=False)
        new = np.isnan(slot) if slot.dtype.kind == "f" else np.zeros(len(slot), bool)
        slot = np.where(new, len(self.known) + np.cumsum(new) - 1, slot).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        which = slot[coded.indices.to_numpy()]
        per_piece = sizes[which]
        out = pool[flat(starts[which], per_piece)], np.diff(np.r_[0, np.cumsum(per_piece)][np.r_[0, np.cumsum(pieces.per_text)]])
        self._remember(missing, starts[len(self.known) :], size, pool)
        return out

    def _remember(self, pieces: pa.BinaryArray, starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> None:
        if len(self.known) > CACHE_ENTRIES:
            half = len(self.known) // 2
            self.pool = self.pool[self.sizes[:half].sum() :]
            self.known, self.sizes = self.known.slice(half), self.sizes[half:]
        short = pc.binary_length(pieces).to_numpy(zero_copy_only=False) <= CACHE_BYTES
        self.known = pa.concat_arrays([self.known, pieces.filter(pa.array(short))])
        self.pool = np.concatenate([self.pool, pool[flat(starts[short], sizes[short])]])
        self.sizes = np.r_[self.sizes, sizes[short]]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0) -> None:
    """Encode texts (null: empty; the added token's name in a text is that token), append ``end_id`` to each, write ORC in ascending order of doc_id.

    Documents are range-partitioned by doc_id before encoding, so ids are never shuffled. Null ids come
    first; repeated ids are ordered by text. Rows: doc_id, n_tokens, first (ids of the same file part
    before it), part, ids. Files and stripes follow the order, so readers prune by doc_id statistics.
    """

    def encode(batches):
        part, first = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, sizes = encoder(vocabulary).ids(batch.column("text").fill_null(""))
            ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(first + ends - sizes), pa.array(np.full(len(sizes), part, np.int64)), lists(np.r_[0, ends], ids)],
                names=["doc_id", "n_tokens", "first", "part", "ids"],
            )
            first += int(ends[-1])

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    ranged.mapInArrow(encode, f"doc_id {kind}, n_tokens long, first long, part long, ids array<int>").write.options(**ORC).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The stored rows with ``start``: the ids of all documents before each one.

    The offsets come from a scan of two columns (the ids are pruned). They are broadcast: one row per file part,
    of which there are as many as shuffle partitions.
    """
    stored = spark.read.orc(folder)
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    return stored.join(F.broadcast(offsets), "part").select("doc_id", (F.col("first") + F.col("_offset")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """crc32 of each row's ids as little-endian unsigned 32-bit integers."""

    def crc(batch):
        ids = batch.column("ids")
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
        sums = np.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], np.int64)
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "start", "n_tokens")], pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = dict(tokens.dtypes)["doc_id"]
    return map_rows(tokens, "ids", crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
