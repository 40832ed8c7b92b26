"""Corpus-wide counts, checks, findings, snapshots, upserts and deletions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausework.functions import ids, text as T


def counts_by(df: DataFrame, names: list[str]) -> DataFrame:
    """(dimension, value, n) for several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(n).cast("string").alias("value")) for n in names])
    return df.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def length_statistics(units: DataFrame, by: str) -> DataFrame:
    """Unit counts and lengths per group with a column per length band."""
    bands = ("<20", "20-49", "50-149", "150-299", "300-599", "600-1199", ">=1200")
    size, band = F.char_length("text"), T.length_band(F.char_length("text"))
    return units.groupBy(by).agg(
        F.count("*").alias("units"), F.min(size).cast("long").alias("min_len"), F.round(F.avg(size), 6).alias("avg_len"), F.max(size).cast("long").alias("max_len"),
        F.count_distinct("document_id").alias("documents"), *[F.count_if(band == b).alias(f"band_{i}") for i, b in enumerate(bands)],
    )


def checks(*parts: tuple[str, DataFrame]) -> DataFrame:
    """(check, violations): each part is a DataFrame of violating rows."""
    counted = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in parts]
    return reduce(DataFrame.unionByName, counted)


def duplicate_groups(df: DataFrame, key: str) -> DataFrame:
    """Members of keys held by more than one row, one row per member; a group is never gathered in one place."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return df.join(sizes, key)


def dependent_counts(keys: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each dependent table per key, zero where there are none."""
    out = keys.select(key)
    for name, df in tables.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def finding(kind: str, severity: str, rows: DataFrame, evidence: Column, unit: Column | None = None) -> DataFrame:
    unit_no = F.lit(0).cast("long") if unit is None else unit.cast("long")
    base = rows.select("document_id", unit_no.alias("unit_order"), F.lit(severity).alias("severity"), F.lit(kind).alias("finding_type"), evidence.cast("string").alias("evidence"))
    return base.withColumn("finding_id", ids.stable_id("finding", "document_id", "unit_order", "severity", "finding_type", "evidence"))


def upsert(base: DataFrame, delta: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last write wins by key; aggregation instead of a sort keeps the shuffle to one partial row per key."""
    both = base.unionByName(delta)
    rest = [c for c in both.columns if c not in key]
    # Highest version, then highest remaining values, so equal versions resolve the same way every time.
    best = both.groupBy(*key).agg(F.max(F.struct(version, *[c for c in rest if c != version])).alias("b"))
    return best.select(*key, "b.*")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted documents."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def content_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-insensitive digest: sums of 48-bit slices of the row hashes."""
    h = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), F.concat_ws("-", part(0), part(1)).alias("digest"))


def catalog_page(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of a sorted catalog with the total; top-k by limit, no driver offset."""
    total = df.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    head = df.orderBy(*order).limit(page * size)
    placed = head.withColumn("position", F.row_number().over(W.orderBy(*order)).cast("long"))
    return placed.where(F.col("position") > (page - 1) * size).withColumn("_k", F.lit(1)).join(total, "_k").drop("_k")
