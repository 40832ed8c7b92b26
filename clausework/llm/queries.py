"""One query per operator, over the whole documents table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clausework.llm import oracle
from clausework.llm.common import load_documents, ready
from clausework.scratch import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {
    "op4_passages": oracle.PASSAGES,
    "op5_quality": oracle.QUALITY,
    "op7_near_duplicates": oracle.NEAR_DUPLICATES,
    "op9_mixing": oracle.MIXING,
    "op12_phrases": oracle.COLLOCATIONS,
    "op13_hard_negatives": oracle.HARD_NEGATIVES,
}

SHARDS = 8


def registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ready(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@registered
def op2_sharding(spark, sf_dir):
    from clausework.llm.sharding import shard_documents

    return shard_documents(load_documents(spark, sf_dir), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


@registered
def op6_bpe(spark, sf_dir):
    from clausework.llm.bpe import encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(load_documents(spark, sf_dir), path, public_tokenizers.PATTERN).drop("ids")


@registered
def op8_token_files(spark, sf_dir):
    from clausework.llm.token_files import checksums, read_tokens, write_tokens

    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(load_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return checksums(read_tokens(spark, folder))


@registered
def op9_mixing(spark, sf_dir):
    from clausework.llm.mixing import mix

    mixed = mix(load_documents(spark, sf_dir))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "taken", "explode(sequence(1, int(n_rows))) as copy").drop("copy")


@registered
def op1_langid(spark, sf_dir):
    from clausework.llm.langid import predict, train

    docs = load_documents(spark, sf_dir)
    return predict(docs, train(docs))


@registered
def op3_pii(spark, sf_dir):
    from clausework.llm.pii import KINDS, find_personal_data, train

    docs = load_documents(spark, sf_dir)
    found = find_personal_data(docs.select("doc_id", "text"), train(docs))
    return found.selectExpr("doc_id", *[f"pii.n_{k}" for k in KINDS], "pii.base_sha256", "pii.spans")


@registered
def op4_passages(spark, sf_dir):
    from clausework.llm.substring import remove_repeats

    return remove_repeats(load_documents(spark, sf_dir)).drop("kept_text", "n_factors")


@registered
def op5_quality(spark, sf_dir):
    from clausework.llm.quality import judge

    return judge(load_documents(spark, sf_dir), ["doc_id"]).drop("distance")


@registered
def op7_near_duplicates(spark, sf_dir):
    from clausework.llm.neardup import near_duplicates

    return near_duplicates(load_documents(spark, sf_dir)).drop("text_key")


@registered
def op10_webp(spark, sf_dir):
    from clausework.llm.webp import media_column

    media = media_column(load_documents(spark, sf_dir))
    return media.selectExpr(
        "doc_id",
        "n_bytes",
        "octet_length(payload) + 0L as payload_bytes",
        "sha2(payload, 256) as payload_sha256",
        "crc32(substring(payload, -64, 64)) as tail_crc32",
        "media_bytes",
        "media_sha256",
        "feature",
    )


@registered
def op11_lexicon(spark, sf_dir):
    from clausework.llm.lexicon import encode_documents

    return encode_documents(load_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


@registered
def op12_phrases(spark, sf_dir):
    from clausework.llm.phrases import collocations

    return collocations(load_documents(spark, sf_dir))


@registered
def op13_hard_negatives(spark, sf_dir):
    from clausework.llm.rtree import hard_negatives

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved))
