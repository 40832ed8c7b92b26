"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from clausework.llm.common import materialize, running_totals, word_count

WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Words wanted from each source: ``share`` of all words by weight, at most ``cap`` times its own words.

    Resharing the excess until no source is above its cap gives ``min(cap, level * weight)`` with one
    level for all; the level is read off the sources in order of cap per weight. One row per source.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_point = W.orderBy(F.col("source").asc_nulls_last())
    ranked = own.withColumn("source_rank", F.row_number().over(by_point).cast("long") - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    capped = ranked.withColumn("weight", F.element_at(cycle, (F.col("source_rank") % len(weights) + 1).cast("int"))).withColumn("most", cap * F.col("source_size"))
    order = W.orderBy((F.col("most") / F.col("weight")).asc(), "source_rank")
    everything = W.partitionBy()
    filled = (
        capped.withColumn("_used", F.sum("most").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("most"))
        .withColumn("_weights", F.sum("weight").over(everything) - F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("weight"))
        .withColumn("_level", (share * F.sum("source_size").over(everything) - F.col("_used")) / F.col("_weights"))
    )
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("most"), F.struct((F.col("most") / F.col("weight")).alias("r"), "source_rank", "_level"))).over(everything)["_level"]
    return filled.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), "most"))).select("source", "source_rank", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 9) -> DataFrame:
    """Words taken from each distinct row: (doc_id, source, row_key, n_rows, size, source_size, target, taken).

    Every source queues its documents in a hashed order, the whole queue ``cap`` times over. A copy's
    virtual finish time is the source's words so far divided by the source's target, so all sources
    advance at the same rate; copies are range-sorted by finish time over all sources and taken while
    the running total stays within the budget. Copies that finish exactly with the last one taken are
    taken too. ``taken`` counts words of one row. Null or blank text has size 0 and is never taken;
    null is a source of its own, last in order; equal rows (``n_rows``) queue together. Sources of any
    size are spread over tasks: only numbers are range-partitioned, and prefix sums need one row per
    source and partition.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("row_key"), word_count().alias("size"))
    sizes = materialize(rows.groupBy("doc_id", "source", "row_key", "size").agg(F.count("*").alias("n_rows")), "mix-sizes")
    weighted = sizes.select("source", (F.col("size") * F.col("n_rows")).alias("size"))
    targets = materialize(source_targets(weighted, weights, share, cap), "mix-targets")
    queued = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    queued = queued.withColumn("_all", F.col("size") * F.col("n_rows")).withColumn("_turn", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    queue = materialize(running_totals(queued, "source_rank", ["_turn", "doc_id", "row_key"], "_all", "_before"), "mix-queue")
    rounds = range(int(cap))
    finish = [(F.col("_before") + F.col("_all") + F.lit(r) * F.col("source_size")) / F.col("target") for r in rounds]
    copies = queue.where("_all > 0 and target > 0").select(F.explode(F.array(*finish)).alias("finish"), "source_rank", "_turn", "row_key", "_all").withColumn("_line", F.lit(0).cast("long"))
    ordered = running_totals(copies, "_line", ["finish", "source_rank", "_turn", "row_key"], "_all", "_total")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    last = ordered.where(F.col("_total") + F.col("_all") <= budget * (1 + 1e-12)).agg(F.max("finish")).first()[0]
    cut = F.lit(-1.0 if last is None else last)
    times = sum((F.when(f <= cut, 1).otherwise(0) for f in finish), F.lit(0))
    taken = F.when((F.col("_all") > 0) & (F.col("target") > 0), times * F.col("size")).otherwise(0).cast("long")
    return queue.select("doc_id", "source", "row_key", "n_rows", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix: every row as many times as it was taken, with its own columns."""
    chosen = mix(docs, **settings).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), F.expr("int(taken div size)").alias("_times"))
    keyed = docs.withColumn("_row_key", F.xxhash64("doc_id", "source", "text"))
    found = keyed.join(chosen, (keyed["_row_key"] == chosen["_key"]) & keyed["doc_id"].eqNullSafe(chosen["_id"]))
    copies = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*[docs[c] for c in docs.columns])
