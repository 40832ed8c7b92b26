"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clausework.llm import stages
from clausework.llm.common import load_documents, ready
from clausework.scratch import shared_folder

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("personal_data", stages.personal_data),
    ("mixed_sources", stages.mixed_sources),
    ("token_ids", stages.token_ids),
]

#: SQL cannot express byte-pair encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; every stage but the last is stored in the shared folder."""
    docs = load_documents(ready(spark), sf_dir)
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{number}-{name}")
            docs = spark.read.parquet(f"{root}/{number}-{name}")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
