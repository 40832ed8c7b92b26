"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausework.llm.common import running_totals

#: Hash values are the first 13 hex digits of an md5, so they are exact as doubles.
_SPAN = float(16**13)


def rendezvous(key: Column, weights: list[float], seed: str = "shard") -> Column:
    """The shard with the highest score ``-weight / ln(u)``, where ``u`` is a hash of key and shard in (0, 1).

    A shard's score does not depend on the others, so adding one moves only the rows that it wins, and a
    changed weight moves rows only to or from that shard. A null key counts as the empty string.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = []
    for shard, weight in enumerate(weights):
        digest = F.md5(F.concat(F.lit(f"{seed}:{shard}:"), text).cast("binary"))
        u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(_SPAN)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("rest")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["rest"]).cast("int")


def shard_documents(docs: DataFrame, weights: list[float], grown: list[float]) -> DataFrame:
    """Shard, slot within the shard, and the shard under ``grown`` weights, one row per input row.

    Law: doc_id and the weights decide, nothing else. Slots run without gaps from 0 in order of doc_id
    (nulls first), ties by checksum and size. Null text is the empty text; null ids go to the shard of
    the empty key; repeated rows get slots of their own. Only numbers are shuffled, never texts, and
    one shard is spread over many tasks.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), grown).alias("grown_shard"),
        F.lit(1).cast("long").alias("_one"),
    )
    placed = running_totals(rows, "shard", ["doc_id", "text_crc32", "size"], "_one", "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
