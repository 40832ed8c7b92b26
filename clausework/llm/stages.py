"""Stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``; all but the last keep the columns of documents.

Columns beyond those of documents are dropped by the first stage. Every stage works on all rows of its
input: nulls, empty tables and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from clausework.llm import bpe, mixing, neardup, pii, quality
from clausework.llm.common import COLUMNS, ready


def quality_rules(spark, docs, sf_dir):
    """Documents that the base rule and their cell's estimate accept."""
    ready(spark)
    return quality.judge(docs, list(COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate group."""
    ready(spark)
    return neardup.first_documents(docs.select(*COLUMNS))


def personal_data(spark, docs, sf_dir):
    """All documents with personal data replaced by its kind in brackets, and n_chars to match."""
    ready(spark)
    found = pii.find_personal_data(docs.select(*COLUMNS), pii.train(docs))
    clean = F.col("pii.redacted")
    return found.select("doc_id", clean.alias("text"), "lang", "source", F.coalesce(F.length(clean).cast("long"), F.col("n_chars")).alias("n_chars"))


def mixed_sources(spark, docs, sf_dir):
    """The mix of the sources: rows as often as they were taken."""
    ready(spark)
    return mixing.mixed_documents(docs.select(*COLUMNS))


def token_ids(spark, docs, sf_dir):
    """Ids of every document, and the digests of ids and of decoded bytes."""
    ready(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
