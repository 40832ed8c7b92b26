"""Retrieval quality, latency and mapping checks."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausework.operators.ranking import positions


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Share of the exact top k that the other ranking also has in its top k, per query."""
    found = approx.where(F.col("rank") <= k).select("query_id", "unit_id").withColumn("hit", F.lit(1))
    truth = exact.where(F.col("rank") <= k).select("query_id", "unit_id")
    return truth.join(found, ["query_id", "unit_id"], "left").groupBy("query_id").agg((F.count("hit") / k).alias("recall"))


def recall_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.min("recall").alias("min_recall"), F.count("*").alias("queries"))


def select_setting(results: DataFrame, threshold: float) -> DataFrame:
    """Cheapest setting whose mean recall reaches the threshold."""
    best = results.where(F.col("mean_recall") >= threshold).agg(F.min(F.struct("cost", "mean_recall")).alias("b"))
    return best.select("b.cost", "b.mean_recall")


def merge_variants(hits: DataFrame, heads: int, top: int) -> DataFrame:
    """Hits of query variants by parent query: each variant's head first, then by best score."""
    merged = hits.groupBy("parent", "unit_id").agg(
        F.max("score").alias("score"), F.max(F.col("rank") <= heads).alias("target_head"), F.count_distinct("variant").alias("variants")
    )
    w = W.partitionBy("query_id").orderBy(F.desc("target_head"), F.desc("score"), "unit_id")
    return (
        merged.withColumnRenamed("parent", "query_id").withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    )


def retrieval_stats(routes: dict[str, DataFrame]) -> DataFrame:
    """Hits per route, distinct candidates and documents, duplicate share, per query."""
    rows = None
    for name, df in routes.items():
        part = df.select("query_id", "unit_id", "document_id", F.lit(name).alias("route"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id").agg(
        *[F.count_if(F.col("route") == n).alias(f"{n}_hits") for n in routes],
        F.count_distinct("unit_id").alias("candidate_count"),
        F.count_distinct("document_id").alias("documents"),
        F.round(1 - F.count_distinct("unit_id") / F.count("*"), 6).alias("duplicate_ratio"),
    )


def hit_mrr_coverage(rankings: DataFrame, gold: DataFrame, k: int = 10, depth: int = 20) -> DataFrame:
    """Per query: unit and document hit at k, reciprocal first gold rank and share of gold groups in ``depth``.

    ``gold``: query_id, group_id, document_id, unit_id; ``rankings``: query_id, document_id, unit_id, rank.
    """
    ranked = rankings.where(F.col("rank") <= depth)
    units = gold.join(ranked.select("query_id", "unit_id", "rank"), ["query_id", "unit_id"], "left")
    per_group = units.groupBy("query_id", "group_id").agg(F.min("rank").alias("rank"))
    scores = per_group.groupBy("query_id").agg(
        F.coalesce(F.max(F.col("rank") <= k), F.lit(False)).alias("unit_hit"),
        F.coalesce(1.0 / F.min("rank"), F.lit(0.0)).alias("rr"),
        (F.count("rank") / F.count("*")).alias("coverage"),
    )
    docs = gold.select("query_id", "document_id").distinct().join(
        ranked.where(F.col("rank") <= k).select("query_id", "document_id").distinct().withColumn("dh", F.lit(True)), ["query_id", "document_id"], "left"
    )
    doc_hit = docs.groupBy("query_id").agg(F.coalesce(F.max("dh"), F.lit(False)).alias("doc_hit"))
    return scores.join(doc_hit, "query_id")


def audit_gold(mapped: DataFrame) -> DataFrame:
    """Issues of each gold case and the status that follows. ``mapped``: item_id, document_id (null = unresolved), n = source length."""
    flags = mapped.groupBy("item_id").agg(
        F.max(F.col("document_id").isNull()).alias("unresolved"),
        F.coalesce(F.max(F.col("n") >= 1200), F.lit(False)).alias("oversized"),
        F.coalesce(F.max(F.col("n") < 20), F.lit(False)).alias("short"),
    )
    issue = lambda c, name: F.when(F.col(c), F.lit(name))
    status = F.when(F.col("unresolved"), "boundary_blocked").when(F.col("oversized"), "needs_preprocessing").when(F.col("short"), "needs_context").otherwise("ready")
    return flags.select("item_id", F.concat_ws("|", issue("unresolved", "unresolved_source"), issue("oversized", "oversized_source"), issue("short", "short_source")).alias("issues"), status.alias("status"))


def order_statistics(samples: DataFrame, by: str, value: str, points: dict[str, Column]) -> DataFrame:
    """Per group its size ``n`` and the values at 1-based positions, given as expressions over ``n``; nulls are left out.

    Positions come from range partitions and counts, so a group that holds most of the table is spread over
    many tasks, and only the wanted rows reach the last aggregation.
    """
    known = samples.select(by, value).where(F.col(value).isNotNull())
    sizes = known.groupBy(by).agg(F.count("*").alias("n"))
    placed = positions(known, [by], [value]).join(sizes, by)
    wanted = placed.where(functools.reduce(operator.or_, [F.col("position") == p for p in points.values()]))
    return wanted.groupBy(by).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("position") == p, F.col(value))).alias(name) for name, p in points.items()])


def _between(fraction: float) -> tuple[Column, Column]:
    """The lower neighbour's position of an interpolated percentile, and the weight of the upper one."""
    at = F.lit(fraction) * (F.col("n") - 1)
    return F.floor(at) + 1, at - F.floor(at)


def percentiles(samples: DataFrame, by: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """Interpolated percentiles, six places, and the lower neighbour of each as ``<name>_nearest``."""
    points = {}
    for name, f in fractions.items():
        low, _ = _between(f)
        points |= {f"{name}_nearest": low, f"{name}_up": F.least(low + 1, F.col("n"))}
    found = order_statistics(samples, by, value, points)
    mixed = [F.round(F.col(f"{n}_nearest") + _between(f)[1] * (F.col(f"{n}_up") - F.col(f"{n}_nearest")), 6).alias(n) for n, f in fractions.items()]
    return found.select(by, *mixed, *[f"{n}_nearest" for n in fractions])


def latency_percentiles(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Interpolated P50 and P95, and P95 as the sample at index floor(0.95 (n - 1))."""
    return percentiles(samples, by, value, {"p50": 0.5, "p95": 0.95}).drop("p50_nearest")


def expected_found(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Share of cases per variant whose expected labels were all found."""
    hit = expected.join(found.withColumn("ok", F.lit(True)), ["case_id", "label"], "left")
    per_case = hit.groupBy("variant", "case_id").agg(F.min(F.coalesce("ok", F.lit(False))).alias("ok"))
    return per_case.groupBy("variant").agg(F.count("*").alias("cases"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("rate"))


def vector_mapping(leaves: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Leaves and vectors that do not pair up, and vectors of another dimension."""
    both = leaves.join(vectors, leaves["leaf_id"] == vectors["vector_id"], "full")
    lone = F.col("leaf_id").isNull() | F.col("vector_id").isNull()
    return both.agg(F.count("leaf_id").alias("leaves"), F.count("vector_id").alias("vectors"), F.count_if(lone).alias("mismatches"), F.count_if(F.col("dim") != dimension).alias("bad_dimension"))
