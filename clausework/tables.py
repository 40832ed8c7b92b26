"""Logical corpus tables on top of the stored Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausework.functions import text as T
from clausework.scratch import spread


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governed documents: language is the corpus, labels give status and review state."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = docs.join(labels, "doc_id", "left")
    status = (
        F.when(F.col("toxic").isNull(), "unverified")
        .when(F.col("toxic") == 1, "repealed")
        .otherwise("current")
    )
    review = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved_for_service").otherwise(
        "pending_review"
    )
    return joined.select(
        F.col("doc_id").alias("document_id"),
        F.col("lang").alias("corpus"),
        F.col("source").alias("document_type"),
        F.lit("internal").alias("visibility"),
        status.alias("effective_status"),
        review.alias("review_status"),
        "text",
        "n_chars",
    ).withColumn("title", T.first_line("text"))


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text line; the line number is the unit order inside the document."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("document_id"),
        F.posexplode(T.lines("text")).alias("pos", "text"),
    ).select("document_id", (F.col("pos") + 1).cast("long").alias("unit_order"), "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("unit_id"), F.col("label").cast("long").alias("document_id"), "embedding"
    )


def retrieval_units(spark: SparkSession, sf_dir: str, scope: DataFrame | None = None) -> DataFrame:
    """Line units with the three normalised search fields; with ``scope`` (source, scope) only of these sources, with what belongs to each."""
    docs = spread(load(spark, sf_dir, "documents"))
    more = ["scope"] if scope is not None else []
    docs = docs.join(scope, "source") if more else docs
    # What all lines of a document share is made before its lines are, so once and not for every line.
    shared = docs.select(
        F.col("doc_id").alias("document_id"),
        T.normalize(F.concat_ws(" ", "lang", "source")).alias("heading_text"),
        T.normalize(T.first_line("text")).alias("document_text"),
        T.lines("text").alias("lines"),
        *more,
    )
    return shared.select("document_id", "heading_text", "document_text", *more, F.posexplode("lines").alias("pos", "line")).select(
        "document_id",
        (F.col("pos") + 1).cast("long").alias("unit_order"),
        T.normalize("line").alias("search_text"),
        "heading_text",
        "document_text",
        *more,
    )
