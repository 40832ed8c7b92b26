"""Eligibility predicates, status decisions and rule gates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Status words of the sources.
CURRENT_WORDS = ("current", "active", "现行", "现行有效", "有效", "current_replacement")
REPEALED_WORDS = ("repealed", "deprecated", "replaced", "superseded", "废止", "废止/失效", "失效")
DOCUMENT_TYPE_PREFIXES = (("GB", "national_standard"), ("DZ", "industry_standard"), ("MT", "industry_standard"), ("EJ", "industry_standard"), ("SY", "industry_standard"), ("YS", "industry_standard"))
TECHNICAL_TYPES = ("national_standard", "industry_standard", "standard", "technical_document", "amendment", "guidance")


def status_map(raw: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return (
        F.when(word.isin(*CURRENT_WORDS), "current")
        .when(word.isin(*REPEALED_WORDS), "repealed")
        .when(word == "governance_conflict", word)
        .otherwise("unverified")
    )


def can_answer(status: Column, review: Column) -> Column:
    return (status == "current") & (review == "approved_for_service")


def governed() -> Column:
    """The predicate no answer route can skip."""
    return F.col("visibility").isin("internal", "public") & can_answer(F.col("effective_status"), F.col("review_status"))


def document_type(number: Column, title: Column) -> Column:
    code = F.upper(F.coalesce(number, F.lit("")))
    out = None
    for prefix, name in DOCUMENT_TYPE_PREFIXES:
        hit = code.startswith(prefix)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return (
        out.when(title.contains("修改单"), "amendment")
        .when(title.contains("指南") | title.contains("问"), "guidance")
        .otherwise("technical_document")
    )


def corpus_of(doc_type: Column) -> Column:
    return F.when(doc_type.isin(*TECHNICAL_TYPES), "technical_standards").otherwise("administrative_services")


def policy_level_type(level: Column) -> Column:
    return (
        F.when(level.contains("法律"), "law")
        .when(level.contains("行政法规") | level.contains("国务院"), "regulation")
        .when(level.contains("规章"), "department_rule")
        .otherwise("policy_document")
    )


# Names of the flags.
EXCLUDE_WHEN_FALSE = ("answer_evidence_eligible", "include_in_answering", "can_answer")
EXCLUDE_WHEN_TRUE = ("exclude_from_answering", "excluded_from_answering")


def explicitly_excluded(structure_json: Column) -> Column:
    """A JSON flag excludes the unit; unreadable JSON does not."""
    schema = ", ".join(f"{k} boolean" for k in EXCLUDE_WHEN_FALSE + EXCLUDE_WHEN_TRUE)
    parsed = F.from_json(structure_json, schema)
    out = F.lit(False)
    for k in EXCLUDE_WHEN_FALSE:
        out = out | F.coalesce(parsed[k] == F.lit(False), F.lit(False))
    for k in EXCLUDE_WHEN_TRUE:
        out = out | F.coalesce(parsed[k] == F.lit(True), F.lit(False))
    return out


def quality_floor(confidence: Column, floor: float = 0.6) -> Column:
    return confidence.isNull() | F.coalesce(confidence.try_cast("double") >= floor, F.lit(False))


def allowlist_decision(authority: Column, verified: Column, status: Column, published: Column, cutoff: Column, number: Column, listed: Column) -> Column:
    """Struct(allowed, reason): validity by authority class, status, publication date and allowlist."""

    def verdict(allowed: bool, reason: str) -> Column:
        return F.struct(F.lit(allowed).alias("allowed"), F.lit(reason).alias("reason"))

    def sourced(scope: str, ok: str, gone: str, missing: str, unclear: str) -> Column:
        return (
            F.when(~verified, verdict(False, missing))
            .when(status == "current", verdict(True, ok))
            .when(status == "repealed", verdict(False, gone))
            .otherwise(verdict(False, unclear))
        )

    # The reason codes that reports and reviews refer to.
    upper = sourced(
        "upper",
        "verified_current_upper_law_outside_departmental_allowlist_scope",
        "explicitly_repealed_upper_law",
        "upper_law_requires_competent_official_source",
        "upper_law_requires_explicit_current_or_repeal_evidence",
    )
    outside = sourced(
        "outside",
        "verified_current_document_outside_departmental_allowlist_scope",
        "explicitly_repealed_document_outside_departmental_allowlist_scope",
        "out_of_scope_document_requires_competent_official_source",
        "out_of_scope_document_requires_explicit_current_or_repeal_evidence",
    )
    departmental = (
        F.when(published.isNull(), verdict(False, "departmental_document_unresolved_publication_date"))
        .when(published >= cutoff, verdict(True, "departmental_document_published_on_or_after_allowlist_cutoff"))
        .when(number == "", verdict(False, "pre_cutoff_departmental_document_missing_document_number"))
        .when(listed, verdict(True, "pre_cutoff_departmental_document_number_allowlisted"))
        .otherwise(verdict(False, "pre_cutoff_departmental_document_number_not_allowlisted"))
    )
    return (
        F.when(authority == "upper", upper)
        .when(authority == "outside", outside)
        .when(authority == "departmental", departmental)
        .otherwise(verdict(False, "authority_classification_required_before_allowlist_evaluation"))
    )


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def domain_gate(text: Column, abuse: list[str], strong: list[str], weak: list[str]) -> Column:
    """Struct(allowed, reason, terms): empty, abuse, strong terms, weak terms only, nothing; in that order."""
    low = F.lower(text)
    found = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    a, s, k = found(abuse), found(strong), found(weak)
    out = lambda ok, why, terms: F.struct(F.lit(ok).alias("allowed"), F.lit(why).alias("reason"), F.sort_array(terms).alias("terms"))
    nothing = F.array().cast("array<string>")
    # The reason codes of the gate.
    return (
        F.when(F.trim(text) == "", out(False, "empty_question", nothing))
        .when(F.size(a) > 0, out(False, "abuse_or_prompt_injection", a))
        .when(F.size(s) > 0, out(True, "domain_terms_matched", s))
        .when(F.size(k) > 0, out(False, "generic_terms_without_domain_context", k))
        .otherwise(out(False, "no_domain_terms", nothing))
    )


# Kinds of personal data (bounded by non-digits in place of look-around).
SENSITIVE = (
    ("mobile_phone", "(?:^|[^0-9])1[3-9][0-9]{9}(?:[^0-9]|$)"),
    ("national_id", "(?:^|[^0-9])[0-9]{17}[0-9Xx](?:[^0-9]|$)"),
    ("license_identifier", "(?:许可证|采矿权|探矿权)(?:号|编号)[：: ]*[A-Za-z0-9\\-—－]{6,}"),
    ("detailed_address", "(?:地址|住址|所在地)[：:][ ]*[^，。；;\\n]{6,}"),
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"),
)


def sensitive_kinds(text: Column) -> Column:
    return reasons(*[(name, text.rlike(pattern)) for name, pattern in SENSITIVE])


def rule_labels(df: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """First matching rule by priority: rules (label, priority, pattern) match by containment."""
    from clausework.operators.joins import contains_join

    hits = contains_join(df.select(key, F.lower(text).alias("text")), rules)
    return hits.groupBy(key).agg(F.min_by("label", "priority").alias("label"), F.min("priority").alias("priority"))


def rule_score(df: DataFrame, key: list[str], text: str, rules: DataFrame) -> DataFrame:
    """Sum of the deltas of all rules whose pattern occurs in the text."""
    from clausework.operators.joins import contains_join

    hits = contains_join(df.select(*key, F.lower(text).alias("text")), rules)
    return hits.groupBy(*key).agg(F.sum("delta").alias("score"), F.count("*").alias("rules_hit"))


def reconcile(best: DataFrame, official: Column, before: Column, floor: float = 0.72) -> DataFrame:
    """New status from the matched registry record; too different titles are a conflict, not a match."""
    new = F.when(F.col("registry_id").isNull(), "unverified").when(F.col("similarity") < floor, "governance_conflict").otherwise(official)
    title = F.when(F.col("similarity") >= floor, F.col("official_title")).otherwise(F.col("title"))
    return best.select("document_id", new.alias("new_status"), before.alias("old_status"), title.alias("corrected_title"))


def apply_overrides(documents: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual status wins unless it is unsafe (answerable without being current and approved); unknown ids are reported."""
    joined = documents.select("document_id", "effective_status", "review_status").join(overrides, "document_id", "full")
    unknown = F.col("effective_status").isNull()
    unsafe = F.col("can_answer") & ~can_answer(F.col("status"), F.col("review_status"))
    rejected = F.coalesce(unknown | unsafe, F.lit(False))
    status = F.when(unknown, "unknown_document").when(F.col("status").isNull() | rejected, F.col("effective_status")).otherwise(F.col("status"))
    return joined.select("document_id", status.alias("effective_status"), rejected.alias("rejected"))


CLAUSE_CODE = "(?:[A-Z][.])?[0-9]+(?:[.][0-9]+)+"  # fixed value: clause numbers in deletion orders


def deleted_clauses(chunks: DataFrame) -> DataFrame:
    """Clauses an amendment text deletes as a whole, with the number of evidence chunks and the shortest one's length."""
    dense = F.regexp_replace("text", "[ \\t\\r\\n]+", "")
    whole = F.regexp_extract_all(dense, F.lit(f"删除[“\"]?({CLAUSE_CODE}(?:[、，,]{CLAUSE_CODE})*)[”\"]?(?:[。；;]|$)"), F.lit(1))
    body = F.regexp_extract_all(dense, F.lit(f"删除(?:正文中?|目次及正文中?)({CLAUSE_CODE})"), F.lit(1))
    marked = F.regexp_extract_all(dense, F.lit(f"删除({CLAUSE_CODE})[^。；;]{{0,16}}整条"), F.lit(1))
    listed = F.flatten(F.transform(whole, lambda v: F.split(v, "[、，,]")))
    rows = chunks.select("document_id", F.char_length("text").cast("long").alias("n"), F.explode(F.array_distinct(F.concat(listed, body, marked))).alias("clause"))
    return rows.groupBy("document_id", "clause").agg(F.count("*").alias("evidence_chunks"), F.min("n").alias("shortest"))


def lexicon_conflicts(entries: DataFrame) -> DataFrame:
    """Entries whose probe also belongs to an entry with another meaning; counted per probe, never paired."""
    shared = entries.groupBy("probe").agg(F.count_distinct("canonical").alias("meanings"), F.count("*").alias("entries")).where("meanings > 1")
    return entries.join(shared, "probe").select("lexicon_id", "probe", "meanings", "entries")
