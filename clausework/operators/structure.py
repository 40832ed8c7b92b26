"""Structure packages over clause families and candidate pools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausework.functions import text as T
from clausework.scratch import materialize


def branch_quarantine(asked: DataFrame, candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates of sibling branches the query did not ask for are set apart with a reason."""
    wanted = asked.join(rules, "asked", "left")
    joined = candidates.join(wanted, "query_id")
    ok = F.col("wanted").isNull() | (F.col("wanted") == F.col("branch"))
    return joined.withColumn("allowed", ok).withColumn("reason", F.when(ok, "").otherwise(F.concat(F.lit("sibling_branch:"), F.col("branch"))))


FAMILY_MIN, FAMILY_MAX = 2, 12  # fixed values: sizes of a usable clause family


def child_catalog(rows: DataFrame) -> DataFrame:
    """Direct children per (document, parent clause): families of 2 to 12 with unique numbers.

    Sizes are checked before any list is built, so a list never exceeds twelve entries.
    """
    placed = rows.withColumn("parent", T.parent_clause("clause_no")).withColumn("number", T.final_number("clause_no")).where("parent is not null")
    fit = placed.groupBy("document_id", "parent").agg(F.count("*").alias("n"), F.count_distinct("number").alias("numbers")).where(
        F.col("n").between(FAMILY_MIN, FAMILY_MAX) & (F.col("n") == F.col("numbers"))
    )
    return placed.join(fit.select("document_id", "parent"), ["document_id", "parent"])


def gap_completion(pool: DataFrame, catalog: DataFrame) -> DataFrame:
    """Members missing from the pool whose neighbours n-1 and n+1 are in it, and whether the relation check holds.

    ``pool``: document_id, parent, number; ``catalog``: the same plus unit_id and relation_ok.
    """
    flagged = catalog.join(pool.select("document_id", "parent", "number").distinct().withColumn("present", F.lit(True)), ["document_id", "parent", "number"], "left")
    w = W.partitionBy("document_id", "parent").orderBy("number")
    near = lambda fn, step: (fn("number").over(w) == F.col("number") + step) & fn("present").over(w).isNotNull()
    gaps = flagged.withColumn("gap", F.col("present").isNull() & near(F.lag, -1) & near(F.lead, 1)).where("gap")
    return gaps.select("document_id", "parent", "number", "unit_id", F.col("relation_ok").alias("selected"))


def family_reservation(named: DataFrame, children: DataFrame, minimum: int = 2) -> DataFrame:
    """Children of parents a question names, where at least two parents of one document are named.

    ``named``: query_id, document_id, parent; ``children``: document_id, parent, unit_id.
    """
    enough = named.groupBy("query_id", "document_id").agg(F.count_distinct("parent").alias("parents")).where(F.col("parents") >= minimum)
    picked = named.join(enough, ["query_id", "document_id"]).select("query_id", "document_id", "parent").distinct()
    return picked.join(children, ["document_id", "parent"]).select("query_id", "document_id", "parent", "unit_id").distinct()


def paired_families(rows: DataFrame, keys: list[str], first: Column, second: Column) -> DataFrame:
    """Families holding both kinds of rows."""
    return rows.groupBy(*keys).agg(F.max(first).alias("a"), F.max(second).alias("b"), F.count("*").alias("members")).where("a AND b").drop("a", "b")


def section_completion(rows: DataFrame, keys: list[str], seed: Column, minimum: int = 2) -> DataFrame:
    """Sections with enough seed clauses add their other clauses; every row gets its role."""
    marked = rows.withColumn("seed", seed)
    enough = marked.groupBy(*keys).agg(F.count_if(F.col("seed")).alias("seeds")).where(F.col("seeds") >= minimum)
    return marked.join(enough, keys).withColumn("role", F.when(F.col("seed"), "seed").otherwise("completion"))


def unique_best(rows: DataFrame, key: str, group: str, score: str) -> DataFrame:
    """The best-scoring group per key; none where the best score is shared."""
    best = rows.groupBy(key).agg(F.max(score).alias(score))
    tied = rows.join(best, [key, score]).groupBy(key, score).agg(F.min(group).alias(group), F.count("*").alias("ties"))
    return tied.where("ties = 1").drop("ties")


def concept_protection(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """First candidate, by authority then position, that covers every concept family the query asks for.

    ``wanted``: query_id, family; ``found``: family, candidate_id, authority, position.
    """
    need = wanted.groupBy("query_id").agg(F.count("*").alias("need"))
    covered = wanted.join(found, "family").groupBy("query_id", "candidate_id", "authority", "position").agg(F.count("*").alias("hit"))
    full = covered.join(need, "query_id").where("hit = need")
    return full.groupBy("query_id").agg(F.min(F.struct((-F.col("authority")).alias("a"), "position", "candidate_id")).alias("b")).select("query_id", F.col("b.candidate_id").alias("candidate_id"))


def structure_pipeline(order: DataFrame, quarantined: DataFrame, packages: list[tuple[str, Callable[[DataFrame], DataFrame]]], size: int) -> DataFrame:
    """One pool of ``size`` units per query for which packages compete in order: every candidate with its decision.

    ``order``: query_id, unit_id, rank. ``quarantined``: query_id, unit_id, reason. A package maps the seed pool (query_id, unit_id) to
    the units it reserves (query_id, unit_id, position); the seed is the clean pool and all that earlier packages reserved. A unit belongs to
    the first package that names it. Reserved units are seated first, by package and position, up to ``size``; clean candidates fill the rest in
    order, and the pool is returned in candidate order, units from outside it last. Decisions: ``reserved`` (with its package), ``filled``,
    ``over_capacity`` (reserved but no seat), ``conflict`` (reserved but quarantined), ``quarantined`` (with its reason), ``displaced``
    (in the clean pool, but its seat went to a reservation), ``left``.
    """
    key = ["query_id", "unit_id"]
    by = lambda *o: W.partitionBy("query_id").orderBy(*o)
    barred = quarantined.groupBy(*key).agg(F.min("reason").alias("reason"))
    clean = materialize(order.join(barred, key, "left_anti").withColumn("clean_rank", F.row_number().over(by("rank"))), "clean")
    seed = clean.where(F.col("clean_rank") <= size).select(*key)
    reserved = None
    for n, (name, package) in enumerate(packages):
        rows = package(seed).groupBy(*key).agg(F.min("position").alias("position")).withColumns({"package": F.lit(name), "package_no": F.lit(n)})
        rows = materialize(rows, "package")
        reserved = rows if reserved is None else reserved.unionByName(rows)
        seed = seed.unionByName(rows.select(*key)).distinct()
    first = reserved.groupBy(*key).agg(F.min(F.struct("package_no", "position", "package")).alias("by")).select(*key, "by.*")
    rows = order.join(first, key, "full").join(clean.select(*key, "clean_rank"), key, "left").join(barred, key, "left")
    claims = F.col("package").isNotNull() & F.col("reason").isNull()
    seated = rows.withColumn("claims", claims).withColumn("claim", F.row_number().over(by(F.desc("claims"), F.asc_nulls_last("package_no"), "position", "unit_id")))
    wins = F.col("claims") & (F.col("claim") <= size)
    fills = F.col("reason").isNull() & F.col("rank").isNotNull() & ~wins
    seated = seated.withColumn("wins", wins).withColumn("fills", fills & ~F.col("claims"))
    seated = seated.withColumn("seat", F.row_number().over(by(F.desc("wins"), F.desc("fills"), F.asc_nulls_last("rank"), "unit_id")))
    pooled = (F.col("wins") | F.col("fills")) & (F.col("seat") <= size)
    decision = (
        F.when(F.col("reason").isNotNull(), F.when(F.col("package").isNotNull(), "conflict").otherwise("quarantined"))
        .when(F.col("wins"), "reserved").when(F.col("claims"), "over_capacity").when(F.col("pooled"), "filled")
        .when(F.col("clean_rank") <= size, "displaced").otherwise("left")
    )
    placed = seated.withColumn("pooled", pooled)
    place = F.row_number().over(by(F.desc("pooled"), F.asc_nulls_last("rank"), F.asc_nulls_last("package_no"), "position", "unit_id"))
    return placed.withColumn("pool_rank", F.when(F.col("pooled"), place).otherwise(0).cast("long")).select(
        *key, decision.alias("decision"), F.coalesce("package", F.lit("")).alias("package"), F.coalesce("reason", F.lit("")).alias("reason"), "pool_rank"
    )


def levels_mentioned(rows: DataFrame, text: str, levels: list[tuple[str, int]], required: int) -> DataFrame:
    """Highest level a text mentions (longest names first when one name holds another) and whether it covers the required one."""
    # Longer names are blanked out once counted, so a short name inside a long one is not counted again.
    rest, best = F.lower(text), F.lit(0)
    for name, rank in sorted(levels, key=lambda v: -len(v[0])):
        best = F.greatest(best, F.when(F.contains(rest, F.lit(name)), rank).otherwise(0))
        rest = F.replace(rest, F.lit(name), F.lit("\u0001"))
    return rows.withColumn("level", best.cast("long")).withColumn("covers", F.col("level") >= required)


def parent_walk(leaves: DataFrame, parents: DataFrame) -> DataFrame:
    """Leaf → its parent → the parent's parent; the depth is fixed, so two equality joins."""
    up = parents.select(F.col("parent_id").alias("parent_node"), F.col("parent_ref").alias("document_node"), F.col("node_type").alias("parent_type"))
    top = parents.select(F.col("parent_id").alias("document_node"), F.col("node_type").alias("top_type"))
    return leaves.join(up, "parent_node").join(top, "document_node", "left")
