"""Writers: JSONL, metadata-only inventories, versioned rule tables, manifest-checked outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausework.operators.corpus import content_digest

BODY_COLUMNS = ("raw_text", "clean_text", "citation_text", "search_text", "context_text", "text", "html")


def jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def inventory(df: DataFrame, path: str) -> None:
    """Metadata only, as JSON and CSV; body text never leaves through an inventory."""
    kept = df.drop(*BODY_COLUMNS)
    kept.write.mode("overwrite").json(f"{path}/json")
    kept.write.mode("overwrite").csv(f"{path}/csv", header=True)


def postings(index: DataFrame, path: str, buckets: int = 256) -> None:
    """Inverted index partitioned by term hash, so a query reads only its terms' folders."""
    index.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def active_rules(entries: DataFrame, path: str, version: int) -> None:
    """Active entries, ordered, as one version of the rule table other jobs read."""
    entries.where("status = 'active'").orderBy(F.desc("priority"), "lexicon_id").write.mode("overwrite").parquet(f"{path}/version={version}")


def current_rules(spark: SparkSession, path: str) -> DataFrame:
    """The newest version only: the filter on the partition column prunes older ones."""
    table = spark.read.parquet(path)
    newest = table.agg(F.max("version").alias("version"))
    return table.join(newest, "version", "left_semi").drop("version")


def write_checked(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Write a table and, next to it, its row count and order-insensitive digest."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    manifest = content_digest(df.sparkSession.read.parquet(f"{path}/data"), columns)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_checked(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Read a table only if it still matches its manifest; fail closed otherwise."""
    data = spark.read.parquet(f"{path}/data")
    want = spark.read.schema("rows long, digest string").json(f"{path}/manifest").first()
    got = content_digest(data, columns).first()
    if want is None or (want["rows"], want["digest"]) != (got["rows"], got["digest"]):
        raise ValueError(f"{path} does not match its manifest")
    return data
