"""Rankings, first appearances, latest rows and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def with_previous_turn(turns: DataFrame, key: str, order: str, text: str, follows: Column) -> DataFrame:
    """Prefix a follow-up turn with the turn before it."""
    prev = F.lag(text).over(W.partitionBy(key).orderBy(order))
    joined = F.when(prev.isNotNull() & follows, F.concat(prev, F.lit("\n"), F.col(text))).otherwise(F.col(text))
    return turns.withColumn("question", joined)


def scoped_documents(scope: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Documents each query may use: its known scope values, or all of them when none is known."""
    inside = scope.join(catalog, key).select("query_id", "document_id")
    known = scope.join(catalog.select(key).distinct(), key, "left_semi").select("query_id").distinct()
    free = scope.select("query_id").distinct().join(known, "query_id", "left_anti").withColumn("k", F.lit(1))
    return inside.unionByName(free.join(catalog.select("document_id").withColumn("k", F.lit(1)), "k").select("query_id", "document_id"))


def status_lookup(queries: DataFrame, catalog: DataFrame, top: int) -> DataFrame:
    """Documents by number, else by title; the first ``top`` per query."""
    by_number = queries.select("query_id", "number").join(catalog, "number").select("query_id", "document_id", "status", F.lit("number").alias("how"))
    rest = queries.join(by_number.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "title")
    by_title = rest.join(catalog.select("title", "document_id", "status"), "title").select("query_id", "document_id", "status", F.lit("title").alias("how"))
    w = W.partitionBy("query_id").orderBy("document_id")
    return by_number.unionByName(by_title).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def prioritize(rows: DataFrame, key: str, anchor: str, order: list[str]) -> DataFrame:
    """Anchor rows first, otherwise the given order."""
    return positions(rows.withColumn("_late", ~F.col(anchor)), [key], ["_late", *order]).drop("_late")


def positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Position of every row inside its key, for keys of any size.

    Rows are range-partitioned by key and order, numbered inside each partition, and shifted by the
    rows the same key has in earlier partitions, so a key holding a third of all rows is spread over
    many tasks instead of one window.
    """
    from clausework.scratch import materialize

    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    stored = materialize(ranged, "positions")
    # One row per key and partition; a key spans only the partitions its range touches.
    sizes = stored.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = stored.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)))
    return local.join(offsets, [*keys, "_part"]).withColumn("position", (F.col("_row") + F.col("_before")).cast("long")).drop("_part", "_row", "_before")


def collapse_requests(requests: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Identical requests share one execution: the request key and the request that runs it."""
    keyed = requests.select(key, F.sha2(F.concat_ws("|", *fields), 256).alias("request_key"))
    first = keyed.groupBy("request_key").agg(F.min(key).alias("executed_by"))
    return keyed.join(first, "request_key")
