"""Evidence checks: rule rows, sufficiency, selection, grounding, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausework.functions import text as T
from clausework.operators.joins import contains_join


def rule_rows(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with a hit in every rule group of their intent. ``rules``: intent, grp, pattern."""
    need = rules.groupBy("intent").agg(F.count_distinct("grp").alias("need"))
    hits = contains_join(rows.withColumn("text", F.lower("text")), rules.withColumnRenamed("intent", "rule_intent"))
    per_row = (
        hits.where(F.col("intent") == F.col("rule_intent"))
        .groupBy("document_id", "unit_order", "intent")
        .agg(F.count_distinct("grp").alias("hit"))
    )
    return per_row.join(need, "intent").where(F.col("hit") == F.col("need"))


def best_shared_words(units: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query_id, document_id, unit_order, score, rank) like ``document_parts.best_units``, where a unit may stand in several rows.

    ``units``: document_id, unit_order, words; ``queries``: query_id, words.
    """
    split = lambda df: df.withColumn("word", F.explode("words")).drop("words").distinct()
    hits = split(queries).join(split(units), "word").groupBy("query_id", "document_id", "unit_order").agg(F.count("*").alias("score"))
    w = W.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "unit_order")
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def sufficiency(hits: DataFrame, targets: DataFrame, comparison: Column) -> DataFrame:
    """Per query: direct hits, documents, missing targets, and whether the evidence suffices.

    ``hits``: query_id, document_id, target; ``targets``: query_id, target. Comparisons need two documents.
    """
    found = hits.groupBy("query_id").agg(F.count("*").alias("direct"), F.count_distinct("document_id").alias("documents"))
    missing = targets.join(hits.select("query_id", "target").distinct(), ["query_id", "target"], "left_anti")
    gaps = missing.groupBy("query_id").agg(F.count("*").alias("missing"))
    out = targets.select("query_id").distinct().join(found, "query_id", "left").join(gaps, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select("query_id", zero("direct"), zero("documents"), zero("missing"))
    enough = (F.col("direct") > 0) & (F.col("missing") == 0) & (~comparison | (F.col("documents") >= 2))
    return out.withColumn("sufficient", enough)


def select_evidence(hits: DataFrame, comparison: Column, top: int = 4) -> DataFrame:
    """First hit per (document, clause), or per document for comparisons; the first ``top`` of those by rank."""
    slot = F.when(comparison, F.lit("")).otherwise(F.col("clause").cast("string"))
    first = hits.groupBy("query_id", "document_id", slot.alias("slot")).agg(F.min("rank").alias("rank"))
    w = W.partitionBy("query_id").orderBy("rank")
    return first.withColumn("seat", F.row_number().over(w).cast("long")).where(F.col("seat") <= top)


def unsupported_values(claims: DataFrame, evidence: DataFrame, values: Column) -> DataFrame:
    """Values a claim states that its evidence does not hold. Both sides: key, text."""
    stated = claims.select("key", F.explode(values).alias("value"))
    found = stated.join(evidence.select("key", F.col("text").alias("support")), "key", "left")
    held = F.coalesce(F.contains(T.grounding_norm("support"), T.grounding_norm("value")), F.lit(False))
    return found.groupBy("key", "value").agg(F.max(held).alias("held")).where("not held").select("key", "value")


# Weights of the plan score.
TYPE_HIT, TYPE_MISS, TERM_WEIGHTS = 3.0, 10.0, (("subject", 2.0), ("required", 2.5), ("alternative", 1.0))
RELATION_HIT, ALL_REQUIRED, GROUP_HIT, ALL_GROUPS = 3.0, 4.0, 3.0, 8.0
NEGATIVE_HIT, NEGATIVE_MOST, TITLE_HIT, TITLE_MISS, TABLE_HIT = 4.5, 18.0, 8.0, 6.0, 12.0


def plan_score(candidates: DataFrame, plans: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, keys, score): how well candidate rows fit the plan of their query.

    ``candidates``: query_id, keys, document_type, chunk_type, number, title, section, text. ``plans``: query_id, intent, document_types,
    subject, required, alternative, negative, titles (arrays), groups (array of arrays), hard_scope, any_type, semantic, output_mode.
    ``rules``: intent, grp, priority, field, pattern, delta; of a group's rules only the first that holds counts. Fields: number, title, section, text,
    context (all three), document_type, chunk_type. A plan meets its candidates by query_id and its rules by intent; rules arrive as one list per
    intent, so a candidate row is never multiplied.
    """
    listed = rules.groupBy("intent").agg(F.sort_array(F.collect_list(F.struct("grp", "priority", "field", "pattern", "delta"))).alias("rules"))
    rows = candidates.join(plans.join(listed, "intent", "left"), "query_id")
    context = F.concat_ws(" ", "title", "section", "text")
    rows = rows.withColumn("context", context)
    held = lambda names, where="context": F.size(F.filter(F.array_distinct(F.filter(names, lambda t: t != "")), lambda t: F.contains(F.col(where), t)))
    plus = lambda cond, yes, no=0.0: F.when(cond, yes).otherwise(no)
    types = F.when(F.size("document_types") == 0, 0.0).when(F.array_contains("document_types", F.col("document_type")), TYPE_HIT).otherwise(plus(F.col("any_type"), 0.0, -TYPE_MISS))
    score = types
    for name, weight in TERM_WEIGHTS:
        score = score + weight * held(F.col(name))
    relation = F.array_union("subject", "required")
    every = (F.size("required") > 0) & F.forall("required", lambda t: F.contains("context", t))
    score = score + plus(F.col("semantic"), RELATION_HIT * held(relation) + plus(every, ALL_REQUIRED))
    met = F.size(F.filter("groups", lambda g: F.exists(g, lambda t: F.contains("context", t))))
    score = score + GROUP_HIT * met + plus((F.size("groups") > 0) & (met == F.size("groups")), ALL_GROUPS)
    score = score - F.least(F.lit(NEGATIVE_MOST), NEGATIVE_HIT * held(F.col("negative")))
    titled = F.exists("titles", lambda t: F.contains("title", t))
    score = score + F.when(F.size("titles") == 0, 0.0).when(titled, TITLE_HIT).when(F.col("hard_scope"), -TITLE_MISS).otherwise(0.0)
    score = score + plus((F.col("output_mode") == "table") & (F.col("chunk_type") == "table"), TABLE_HIT)
    fields = ("number", "title", "section", "text", "context", "document_type", "chunk_type")
    value = lambda r: F.coalesce(*[F.when(r["field"] == f, F.col(f)) for f in fields], F.lit(""))
    holds = F.filter(F.coalesce("rules", F.array().cast(dict(listed.dtypes)["rules"])), lambda r: F.contains(value(r), r["pattern"]))
    rows = rows.select("query_id", *keys, score.alias("plain"), holds.alias("holds"))
    # Rules are sorted by group and priority: the first that holds of each group counts.
    first = F.filter("holds", lambda r, i: (i == 0) | (F.get("holds", i - 1)["grp"] != r["grp"]))
    return rows.select("query_id", *keys, (F.col("plain") + F.aggregate(first, F.lit(0.0), lambda total, r: total + r["delta"])).alias("score"))


def unverified_references(answers: DataFrame, sources: DataFrame, pattern: str) -> DataFrame:
    """(key, ref): references an answer states that its own sources do not. Both sides: key, text; compared in lower case.

    References are distinct per key before they meet, and the key is part of the join, so a common word is no hot key.
    """
    refs = lambda df: df.select("key", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0)))).alias("ref")).distinct()
    return refs(answers).join(refs(sources), ["key", "ref"], "left_anti")


def bigram_support(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Share of a claim's character bigrams (not all digits) that its evidence holds; below 0.38 it is unsupported.

    Claims under twelve characters or five bigrams are not judged.
    """
    grams = F.filter(T.char_grams(T.grounding_norm("text"), 2), lambda g: ~g.rlike("^[0-9]+$"))
    rows = claims.where(F.char_length(T.grounding_norm("text")) >= 12).select("key", "claim_no", grams.alias("grams"))
    # Claims that repeat in every evidence text are compared once per evidence row, never pairwise with each other.
    joined = rows.join(evidence.select("key", F.coalesce(T.grounding_norm("text"), F.lit("")).alias("body")), "key", "left")
    share = F.size(F.filter("grams", lambda g: F.coalesce(F.contains("body", g), F.lit(False)))) / F.size("grams")
    return joined.where(F.size("grams") >= 5).select("key", "claim_no", F.round(share, 6).alias("support"), (share < 0.38).alias("unsupported"))


def compact_sources(facts: DataFrame, limit: int = 24) -> DataFrame:
    """Used sources renumbered by first use (equal places by source), at most ``limit`` per answer; facts without a source left are dropped.

    ``facts``: answer_id, fact_no, source (one row per use, ``use_no`` within the fact).
    """
    first = facts.groupBy("answer_id", "source").agg(F.min(F.struct("fact_no", "use_no")).alias("place"))
    w = W.partitionBy("answer_id").orderBy("place", "source")
    numbered = first.withColumn("new_no", F.row_number().over(w).cast("long")).where(F.col("new_no") <= limit).drop("place")
    return facts.join(numbered, ["answer_id", "source"])


def comparison_matrix(facts: DataFrame, row_keys: list[str], column: str, values: list[str]) -> DataFrame:
    """Facts x documents with counts; ``values`` are the compared documents."""
    return facts.groupBy(*row_keys).pivot(column, values).agg(F.count(F.lit(1))).fillna(0, values)


def required_refs(required: DataFrame, hits: DataFrame) -> DataFrame:
    """Best hit per required reference, prefix-aware; missing references keep null.

    ``required``: query_id, ref; ``hits``: query_id, clause, hit_id, score.
    """
    keyed = hits.withColumn("ref", F.explode(T.clause_prefixes("clause")))
    best = keyed.groupBy("query_id", "ref").agg(F.max(F.struct("score", "hit_id")).alias("b"))
    return required.join(best, ["query_id", "ref"], "left").select("query_id", "ref", F.col("b.hit_id").alias("hit_id"), F.col("b.hit_id").isNull().alias("missing"))


def review_state(actions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Latest state per candidate and whether an approval is valid: pending, with examples and a passing preview of the same fingerprint."""
    last = actions.groupBy("candidate_id").agg(F.max(F.struct("seq", "action", "fingerprint")).alias("l"))
    joined = candidates.join(last, "candidate_id", "left")
    state = F.coalesce(F.col("l.action"), F.lit("pending"))
    valid = (state == "preview_ok") & (F.col("l.fingerprint") == F.col("fingerprint")) & F.col("has_examples")
    return joined.select("candidate_id", state.alias("state"), F.coalesce(valid, F.lit(False)).alias("approvable"))


def sequence_runs(sentences: DataFrame, groups: list[tuple[str, ...]], limit: int = 700) -> DataFrame:
    """First run of adjacent sentences matching an ordered list of anchor groups, joined and cut at ``limit``.

    Documents arrive as one row with a sentence array, so the search needs no shuffle.
    """
    n = len(groups)
    dense = F.transform("sentences", lambda s: F.lower(T.squeeze(s)))

    def holds(anchors):
        def test(d):
            cond = F.lit(True)
            for a in anchors:
                cond = cond & F.contains(d, F.lit(a))
            return cond

        return F.transform(dense, test)

    # Element i of the running conjunction says whether groups 0..k match sentences i..i+k.
    run = holds(groups[0])
    for k, anchors in enumerate(groups[1:], 1):
        run = F.zip_with(run, F.slice(holds(anchors), k + 1, F.size("sentences")), lambda a, b: a & F.coalesce(b, F.lit(False)))
    # Exploding the found position keeps the search in one evaluation per document.
    first = F.filter(F.array((F.array_position(run, F.lit(True)) - 1).cast("int")), lambda i: i >= 0)
    placed = sentences.withColumn("start", F.explode(first))
    text = F.array_join(F.slice("sentences", F.col("start") + 1, n), "")
    cut = F.concat(F.rtrim(F.substring(text, 1, limit)), F.when(F.char_length(text) > limit, "...").otherwise(""))
    return placed.withColumn("quote", cut)


def quote_windows(sentences: DataFrame, terms: list[str], limit: int, count: int) -> DataFrame:
    """Best-scoring sentence with its followers up to ``limit`` characters and ``count`` sentences; ellipses where text is left out."""
    scored = sentences.withColumn("scores", F.transform("sentences", lambda s: F.size(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(s, t)))))
    best = F.when(F.array_max("scores") > 0, F.array_position("scores", F.array_max("scores")).cast("int"))
    picked = scored.withColumn("best", F.explode(F.array_compact(F.array(best))))
    head = F.get("sentences", F.col("best") - 1)
    lead = (F.char_length(head) < limit * 0.45) & (F.col("best") > 1)
    picked = picked.withColumn("start", F.when(lead, F.col("best") - 1).otherwise(F.col("best")))
    base = F.array_join(F.slice("sentences", F.col("start"), F.col("best") - F.col("start") + 1), "")
    picked = picked.withColumn("base", base).withColumn("have", F.col("best") - F.col("start") + 1)
    # Followers are taken while both the sentence count and the running length allow it.
    start = F.struct(F.col("base").alias("text"), F.col("have").alias("n"), F.lit(False).alias("stop"))

    def step(acc, s):
        fits = ~acc["stop"] & (acc["n"] < count) & (F.char_length(acc["text"]) + F.char_length(s) <= limit)
        return F.struct(F.when(fits, F.concat(acc["text"], s)).otherwise(acc["text"]).alias("text"), (acc["n"] + F.when(fits, 1).otherwise(0)).alias("n"), (~fits).alias("stop"))

    rest = F.slice("sentences", F.col("best") + 1, count)
    folded = picked.withColumn("f", F.aggregate(rest, start, step))
    long = F.char_length("f.text") > limit
    end = F.col("start") + F.col("f.n") - 1
    body = F.when(long, F.concat(F.rtrim(F.substring("f.text", 1, limit)), F.lit("..."))).otherwise(F.col("f.text"))
    tail = F.when(~long & (end < F.size("sentences")), "...").otherwise("")
    return folded.withColumn("quote", F.concat(F.when(F.col("start") > 1, "...").otherwise(""), body, tail))


def definition_slots(texts: DataFrame, slots: list[str], text: str = "text") -> DataFrame:
    """Numbered definition clause of the longest slot term found, cut before the next clause."""
    found = [
        F.nullif(F.regexp_extract(text, f"([0-9]+(?:[.][0-9]+)+[ \\n]*{s}[^\\n]*(?:\\n(?![0-9]+[.][0-9]).*)*)", 1), F.lit(""))
        for s in sorted(slots, key=len, reverse=True)
    ]
    return texts.withColumn("definition", F.trim(F.coalesce(*found)))


def table_row_select(rows: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """Rows whose first cell equals the target, rendered with their headers and cut at ``limit`` characters."""
    hit = rows.withColumn("first", F.get("cells", 0)).join(targets.withColumnRenamed("target", "first"), "first")
    text = F.array_join(F.zip_with("header", "cells", lambda h, c: F.concat_ws("：", h, c)), "；")
    return hit.withColumn("rendered", F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("..."))))


SPACING = "([ⅠⅡⅢ]|[123](?=[ ]*类))[ ]*类?型?[^0-9ⅠⅡⅢ]*([0-9]+(?:[~～-][0-9]+)?)[^0-9]+([0-9]+(?:[~～-][0-9]+)?)[^0-9]+([0-9]+(?:[~～-][0-9]+)?)[^0-9]+([0-9]+(?:[~～-][0-9]+)?)"


def spacing_matrix(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per deposit type and column from lines that state four ranges for a type."""
    found = texts.select("document_id", F.explode(F.regexp_extract_all(text, F.lit(SPACING), F.lit(0))).alias("m"))
    part = lambda i: F.regexp_extract("m", SPACING, i)
    cells = F.array(*[part(i) for i in (2, 3, 4, 5)])
    return found.select("document_id", part(1).alias("type"), F.posexplode(cells).alias("column_no", "spacing"))


def projection_facts(quotes: DataFrame, text: str = "text") -> DataFrame:
    """Projection statements: finite or infinite, ratio next to the action word, and the kind of movement."""
    segments = quotes.select("document_id", F.explode(T.split_sentences(text)).alias("segment")).where(F.col("segment").rlike("外推|推断"))
    kind = F.when(F.contains("segment", F.lit("无限外推")), "infinite").when(F.contains("segment", F.lit("有限外推")), "finite").otherwise("unspecified")
    ratio = F.regexp_extract("segment", "([0-9]+/[0-9]+)[^0-9]{0,6}(?:尖推|平推|外推)", 1)
    action = F.regexp_extract("segment", "(尖推|平推)", 1)
    basis = F.array_compact(F.array(*[F.when(F.contains("segment", F.lit(b)), F.lit(b)) for b in ("实际工程间距", "经验工程间距", "基本工程间距")]))
    return segments.select("document_id", kind.alias("kind"), ratio.alias("ratio"), action.alias("action"), F.array_join(basis, "|").alias("basis"), "segment")


def rule_facts(rows: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Facts a topic's extraction patterns find: (topic, value) per row and match."""
    parts = F.flatten(F.array(*[
        F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), (lambda t: lambda v: F.struct(F.lit(t).alias("topic"), v.alias("value")))(topic))
        for topic, p in rules
    ]))
    return rows.select("document_id", "unit_order", F.inline(parts))
