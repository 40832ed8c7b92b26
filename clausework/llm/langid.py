"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clausework.llm.common import map_rows

#: Buckets of an n-gram: 2^15 for up to 256 labels, fewer for more, so that the matrix stays at 64 MB.
MOST_BITS, MATRIX_BITS = 15, 23
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
SLICE = 1 << 20
#: Odd multipliers of the n-gram hash, one per place.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def bucket_bits(labels: int) -> int:
    return max(4, min(MOST_BITS, MATRIX_BITS - (labels - 1).bit_length()))


def grams(text: str, bits: int = MOST_BITS) -> np.ndarray:
    """Bucket numbers of all n-grams of one lower-cased text; ASCII characters but letters count as blanks."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    points[(points < 128) & ((points < 97) | (points > 122))] = 32
    shift, found, mixed = np.uint64(64 - bits), [], np.zeros(len(points), np.uint64)
    for order in ORDERS:
        if len(points) < order:
            break
        mixed = (mixed[: len(points) - order + 1] ^ (points[order - 1 :] * PLACES[order - 1])) * PLACES[0]
        found.append((mixed >> shift).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    """Labels in code point order, log priors, log probabilities by label and bucket, and the bits of a bucket number."""

    labels: tuple[str, ...]
    priors: np.ndarray
    weights: np.ndarray
    bits: int = MOST_BITS

    def scores(self, texts: list[str]) -> np.ndarray:
        """Joint log probabilities of texts that hold a letter: texts x labels.

        Only the n-grams present are looked up; each label's row (256 KB at most) stays in cache.
        """
        rows = [grams(t, self.bits) for t in texts]
        starts = np.r_[0, np.cumsum([len(r) for r in rows])[:-1]]
        index = np.concatenate(rows)
        return np.stack([p + np.add.reduceat(w[index], starts) for p, w in zip(self.priors, self.weights)], axis=1)


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_label: int = 4000) -> Model | None:
    """Fit on about ``per_label`` documents of each label, chosen by hash. Every label can be predicted.

    Sampled texts are counted whole on the executors; the driver gets one sum per label and bucket.
    Returns None where nothing is labelled.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().collect()  # one row a label
    if not counts:
        return None
    labels = tuple(sorted(r["lang"] for r in counts))
    count = {r["lang"]: r["count"] for r in counts}
    bits = bucket_bits(len(labels))
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, per_label / count[k]))])
    turn = (F.abs(F.xxhash64(F.lit("langid"), "doc_id")) % (1 << 30)) / float(1 << 30)
    sample = labelled.where(turn < share[F.col("lang")]).select("lang", "text")

    def tally(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text and lang in count:
                    own = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                    own += np.bincount(grams(text, bits), minlength=1 << bits)
        for lang, own in sums.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen.astype(np.int32)), pa.array(own[seen])], names=["lang", "bucket", "n"])

    table = sample.mapInArrow(tally, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {k: i for i, k in enumerate(labels)}
    sums = np.full((len(labels), 1 << bits), SMOOTHING)
    rows = np.array([place[k] for k in table["lang"].to_pylist()], np.int64)
    sums[rows, table["bucket"].to_numpy()] += table["n"].to_numpy()
    totals = np.array([count[k] for k in labels], float)
    return Model(labels, np.log(totals / totals.sum()), np.log(sums / sums.sum(axis=1, keepdims=True)), bits)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior of the prediction, six places) of every row's whole text.

    A text that is null or has no letter, and any text where no model could be trained, gets ``und`` and
    score 0. Equal posteriors go to the first label in code point order. Only the text is scored; the
    model is sent once per executor (64 MB at most up to half a million labels).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        values = batch.column("text").to_pylist()
        known = [i for i, t in enumerate(values) if t and any(map(str.isalpha, t))]
        labels, score = ["und"] * len(values), np.zeros(len(values))
        if known and shared.value is not None:
            joint = shared.value.scores([values[i] for i in known])
            best = joint.argmax(axis=1)
            score[known] = np.round(1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1), 6)
            for i, b in zip(known, best):
                labels[i] = shared.value.labels[b]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_rows(rows, "text", run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double", SLICE)
