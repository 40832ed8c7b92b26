"""Byte-level BPE encoding as a monoid: halves are encoded on their own and joined at the cut."""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clausework.llm.common import map_rows

LEAF_CHARS = 4096
LONG_PIECE = 512
CACHE_ENTRIES = 300_000


class TreeEncoder:
    """An element of the monoid is a list of (piece, ids): the pattern's matches in a span of text.

    ids are kept as little-endian uint32 bytes. Joining L and R keeps every match of L that the text
    after it cannot change and every match of R from the first boundary that both parses share.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.cache: dict[str, bytes] = {}
        self.fits = functools.lru_cache(1 << 16)(self._fits)

    # Tokens inside one piece.

    def merge(self, piece: bytes) -> list[int]:
        return self.bpe._encode_single_piece(piece)

    def _fits(self, a: int, b: int) -> bool:
        return self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """Join two encodings inside one piece, re-encoding a window that doubles around the cut.

        Merges never cross a border at which the two tokens encode to themselves together: the first merge
        to cross it would also be made in the pair alone. So once both edges of the window fit
        their neighbours, the tokens outside it are final.
        """
        k = 1
        while True:
            a, b = left[-k:], right[:k]
            new = self.merge(b"".join(map(self.bytes_of.__getitem__, a + b)))
            ok_left = k >= len(left) or self.fits(left[-k - 1], new[0])
            ok_right = k >= len(right) or self.fits(new[-1], right[k])
            if ok_left and ok_right:
                return left[: max(0, len(left) - k)] + new + right[k:]
            k *= 2

    def piece_tokens(self, piece: bytes) -> list[int]:
        if len(piece) <= LONG_PIECE:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join_tokens(self.piece_tokens(piece[:half]), self.piece_tokens(piece[half:]))

    def code(self, piece: str) -> bytes:
        found = self.cache.get(piece)
        if found is None:
            found = np.array(self.piece_tokens(piece.encode()), "<u4").tobytes()
            if len(piece) < 64:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    # Pieces of a text.

    def leaf(self, text: str) -> tuple[list[str], list[bytes]]:
        pieces = self.pattern.findall(text)
        try:
            return pieces, list(map(self.cache.__getitem__, pieces))
        except KeyError:
            return pieces, list(map(self.code, pieces))

    def join(self, left, right):
        """Re-match a window from the first match of L that could still change, growing into R.

        A match is final if the text shows the character after it and three from its start (the
        longest look-ahead of the pattern); matching has no memory, so from a common boundary on
        R's own matches hold.
        """
        (lp, lc), (rp, rc) = left, right
        if not lp or not rp:
            return (lp + rp, lc + rc)
        back, tail = 0, 0
        while back < len(lp) and (tail == 0 or tail + len(lp[-back - 1]) < 3):
            back += 1
            tail += len(lp[-back])
        front = 2
        while True:
            head = rp[:front]
            window = "".join(lp[len(lp) - back :] + head)
            bounds, at = {tail: 0}, tail
            for i, p in enumerate(head):
                at += len(p)
                bounds[at] = i + 1
            pieces, end = [], 0
            for m in self.pattern.finditer(window):
                whole = front >= len(rp)
                if not whole and (m.end() >= len(window) or m.start() + 3 > len(window)):
                    break
                pieces.append(m.group())
                end = m.end()
                if end in bounds:
                    break
            if end in bounds and pieces:
                used = bounds[end]
                codes = [self._joined(p, lp[-1], lc[-1], rp[0], rc[0]) for p in pieces]
                return lp[: len(lp) - back] + pieces + rp[used:], lc[: len(lc) - back] + codes + rc[used:]
            front *= 2

    def _joined(self, piece: str, a: str, code_a: bytes, b: str, code_b: bytes) -> bytes:
        if len(piece) > LONG_PIECE and len(piece) == len(a) + len(b) and piece.startswith(a):
            both = (np.frombuffer(c, "<u4").tolist() for c in (code_a, code_b))
            return np.array(self.join_tokens(*both), "<u4").tobytes()
        return self.code(piece)

    def encode(self, text: str) -> tuple[list[str], list[bytes]]:
        if len(text) <= LEAF_CHARS:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.encode(text[:half]), self.encode(text[half:]))

    def encode_ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode(text)[1]), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids: halves decoded on their own and concatenated."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TreeEncoder:
    return TreeEncoder(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Ids of every text with the digests of ids and of the decoded bytes, one row per input row.

    Null text is the empty text, which has no ids. Rows are independent: no shuffle, and memory holds
    a few megabytes of text and one document at a time. Columns: doc_id, ids, n_tokens, ids_sha256,
    decoded_sha256.
    """

    def run(batch):
        tool, codes, decoded = encoder(path, pattern), [], []
        for value in batch.column(text).to_pylist():
            ids = tool.encode_ids(value or "")
            codes.append(ids)
            decoded.append(hashlib.sha256(tool.decode(ids)).hexdigest())
        sizes = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate(codes).astype(np.int32) if codes else np.zeros(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat))
        digests = [hashlib.sha256(c.tobytes()).hexdigest() for c in codes]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(sizes), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(docs.select("doc_id", text), text, run, f"doc_id {kind}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
