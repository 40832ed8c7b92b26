"""Predicates, gates and rule tables over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework import tables
from clausework.functions import ids, text as T
from clausework.operators import governance as G
from clausework.plans.oracle import DOCS, LINES, compact
from clausework.plans.registry import query

GOVERNED_SQL = "visibility IN ('internal', 'public') AND review_status = 'approved_for_service' AND effective_status = 'current'"
USER_TURNS = "SELECT conv_id * 1000 + turn AS query_id, text AS question FROM conversations WHERE role = 'user'"


def user_turns(spark, sf):
    return tables.load(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))


@query("governed_filter", f"WITH {DOCS} SELECT document_id, corpus, document_type, n_chars FROM docs WHERE {GOVERNED_SQL}")
def governed_filter(spark, sf):
    return tables.documents(spark, sf).where(G.governed()).select("document_id", "corpus", "document_type", "n_chars")


@query("can_answer_flag", f"WITH {DOCS} SELECT document_id, effective_status = 'current' AND review_status = 'approved_for_service' AS can_answer FROM docs")
def can_answer_flag(spark, sf):
    return tables.documents(spark, sf).select("document_id", G.can_answer(F.col("effective_status"), F.col("review_status")).alias("can_answer"))


FLAG_JSON_SQL = """CASE event_type WHEN 'error' THEN '{bad' WHEN 'click' THEN '{"can_answer": ' || (value > 20) || '}' WHEN 'view' THEN '{"exclude_from_answering": ' || (value > 50) || ', "x": 1}' ELSE props END"""


@query(
    "explicit_exclusion",
    """SELECT event_id, NOT ((event_type = 'click' AND NOT value > 20) OR (event_type = 'view' AND value > 50)) AS kept FROM events""",
)
def explicit_exclusion(spark, sf):
    say = lambda c: F.when(c, "true").otherwise("false")
    text = (
        F.when(F.col("event_type") == "error", "{bad")
        .when(F.col("event_type") == "click", F.concat(F.lit('{"can_answer": '), say(F.col("value") > 20), F.lit("}")))
        .when(F.col("event_type") == "view", F.concat(F.lit('{"exclude_from_answering": '), say(F.col("value") > 50), F.lit(', "x": 1}')))
        .otherwise(F.col("props"))
    )
    return tables.load(spark, sf, "events").select("event_id", (~G.explicitly_excluded(text)).alias("kept"))


@query(
    "quality_floor",
    """SELECT event_id FROM events WHERE event_type = 'view' OR (event_type <> 'error' AND round(value / 100, 3) >= 0.6::DOUBLE)""",
)
def quality_floor(spark, sf):
    confidence = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") != "view", F.round(F.col("value") / 100, 3).cast("string"))
    return tables.load(spark, sf, "events").where(G.quality_floor(confidence)).select("event_id")


@query("catalog_filter", f"WITH {DOCS} SELECT document_id, title FROM docs WHERE contains(lower(title), 'en') AND corpus = 'en' AND effective_status <> 'repealed'")
def catalog_filter(spark, sf):
    wanted = {"title_contains": "en", "corpus": "en"}
    docs = tables.documents(spark, sf).where(F.col("effective_status") != "repealed")
    return docs.where(F.contains(F.lower("title"), F.lit(wanted["title_contains"])) & (F.col("corpus") == wanted["corpus"])).select("document_id", "title")


@query(
    "scope_filter",
    f"""WITH {DOCS}, scope AS (SELECT item_id AS query_id, 'src' || (length(text) % 25) AS document_type FROM benchmark),
      known AS (SELECT * FROM scope WHERE document_type IN (SELECT document_type FROM docs))
      SELECT query_id, document_id FROM known JOIN docs USING (document_type)
      UNION ALL SELECT item_id, document_id FROM benchmark CROSS JOIN docs WHERE item_id NOT IN (SELECT query_id FROM known)""",
)
def scope_filter(spark, sf):
    from clausework.operators import ranking

    scope = tables.queries(spark, sf).select("query_id", F.concat(F.lit("src"), F.char_length("question") % 25).alias("document_type"))
    return ranking.scoped_documents(scope, tables.documents(spark, sf).select("document_id", "document_type"), "document_type")


GROUPS = (("tion", "ung"), ("the", "les", "der"), ("and", "eau", "sch"))
NEGATIVE = ("license", "token", "###", "%%%", "@")


@query(
    "evidence_groups_match",
    f"""WITH {LINES} SELECT document_id, unit_order, {' AND '.join('(' + ' OR '.join(f"contains(lower(text), '{t}')" for t in g) + ')' for g in GROUPS)} AS matched,
      CAST({' + '.join('(' + ' OR '.join(f"contains(lower(text), '{t}')" for t in g) + ')::INT' for g in GROUPS)} AS BIGINT) AS groups_matched FROM lines""",
)
def evidence_groups_match(spark, sf):
    groups = F.array(*[F.array(*[F.lit(t) for t in g]) for g in GROUPS])
    low = F.lower("text")
    count = F.size(F.filter(groups, lambda g: F.exists(g, lambda t: F.contains(low, t)))).cast("long")
    return tables.line_units(spark, sf).select("document_id", "unit_order", T.all_groups_match(low, groups).alias("matched"), count.alias("groups_matched"))


@query(
    "negative_penalty",
    f"""WITH {LINES} SELECT document_id, unit_order, least(18.0::DOUBLE, 4.5::DOUBLE * ({' + '.join(f"contains(lower(text), '{t}')::INT" for t in NEGATIVE)})) AS penalty FROM lines""",
)
def negative_penalty(spark, sf):
    hits = F.size(F.filter(F.array(*[F.lit(t) for t in NEGATIVE]), lambda t: F.contains(F.lower("text"), t)))
    return tables.line_units(spark, sf).select("document_id", "unit_order", F.least(F.lit(18.0), 4.5 * hits).alias("penalty"))


@query(
    "citation_eligibility",
    f"""WITH {LINES} SELECT document_id, unit_order, CASE WHEN length(text) >= 1200 THEN 'review_required' WHEN length({compact('text')}) >= 8 THEN 'pass' ELSE 'context_only' END AS review_status,
       length(text) < 1200 AND length({compact('text')}) >= 8 AS citation_eligible FROM lines""",
)
def citation_eligibility(spark, sf):
    from clausework.operators import leaves

    return leaves.citation_flags(tables.line_units(spark, sf), "text").select("document_id", "unit_order", "review_status", "citation_eligible")


@query(
    "branch_quarantine",
    """WITH rules AS (SELECT * FROM (VALUES ('1-URGENT', 'R'), ('2-HIGH', 'A')) r(asked, branch))
       SELECT l_orderkey, l_linenumber, r.branch IS NULL OR r.branch = l_returnflag AS allowed,
         CASE WHEN r.branch IS NULL OR r.branch = l_returnflag THEN '' ELSE 'sibling_branch:' || l_returnflag END AS reason
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN rules r ON r.asked = o_orderpriority""",
)
def branch_quarantine(spark, sf):
    from clausework.operators import structure

    asked = tables.load(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("asked"))
    candidates = tables.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), "l_linenumber", F.col("l_returnflag").alias("branch"))
    rules = spark.createDataFrame([("1-URGENT", "R"), ("2-HIGH", "A")], "asked string, wanted string")
    return structure.branch_quarantine(asked, candidates, rules).select(F.col("query_id").alias("l_orderkey"), "l_linenumber", "allowed", "reason")


ABUSE, STRONG, WEAK = ["ignore", "token ="], ["tion", "ungh"], ["the", "les", "der"]


@query(
    "domain_gate",
    f"""WITH q AS ({USER_TURNS} UNION ALL SELECT -1 - item_id, text FROM benchmark),
      m AS (SELECT query_id, question, list_filter(['ignore', 'token ='], lambda w: contains(lower(question), w)) AS a,
        list_filter(['tion', 'ungh'], lambda w: contains(lower(question), w)) AS s, list_filter(['the', 'les', 'der'], lambda w: contains(lower(question), w)) AS k FROM q)
      SELECT query_id, len(a) = 0 AND len(s) > 0 AND trim(question) <> '' AS allowed,
        CASE WHEN trim(question) = '' THEN 'empty_question' WHEN len(a) > 0 THEN 'abuse_or_prompt_injection' WHEN len(s) > 0 THEN 'domain_terms_matched'
          WHEN len(k) > 0 THEN 'generic_terms_without_domain_context' ELSE 'no_domain_terms' END AS reason,
        array_to_string(CASE WHEN len(a) > 0 THEN list_sort(a) WHEN len(s) > 0 THEN list_sort(s) ELSE list_sort(k) END, '|') AS terms FROM m""",
)
def domain_gate(spark, sf):
    q = user_turns(spark, sf).unionByName(tables.queries(spark, sf).withColumn("query_id", -1 - F.col("query_id")))
    out = q.select("query_id", G.domain_gate(F.col("question"), ABUSE, STRONG, WEAK).alias("d"))
    return out.select("query_id", "d.allowed", "d.reason", F.array_join("d.terms", "|").alias("terms"))


@query("status_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'current' WHEN 'O' THEN 'repealed' ELSE 'unverified' END AS status FROM orders")
def status_map(spark, sf):
    words = spark.createDataFrame([("F", "现行有效"), ("O", " 废止 ")], "o_orderstatus string, word string")
    return tables.load(spark, sf, "orders").join(words, "o_orderstatus", "left").select("o_orderkey", G.status_map(F.col("word")).alias("status"))


@query(
    "document_type_rules",
    """SELECT p_partkey, CASE p_brand[7:] WHEN '1' THEN 'national_standard' WHEN '2' THEN 'industry_standard' WHEN '3' THEN 'amendment' WHEN '4' THEN 'guidance' ELSE 'technical_document' END AS document_type,
       'technical_standards' AS corpus, CASE WHEN p_size > 40 THEN 'law' WHEN p_size > 30 THEN 'regulation' WHEN p_size > 20 THEN 'department_rule' ELSE 'policy_document' END AS policy_type FROM part""",
)
def document_type_rules(spark, sf):
    brand = F.substring("p_brand", 7, 9)
    number = F.when(brand == "1", F.concat(F.lit("gb/t "), F.col("p_partkey"))).when(brand == "2", F.concat(F.lit("DZ/T "), F.col("p_partkey")))
    title = F.when(brand == "3", F.concat("p_name", F.lit("修改单"))).when(brand == "4", F.concat("p_name", F.lit("指南"))).otherwise(F.col("p_name"))
    level = F.when(F.col("p_size") > 40, "国家法律").when(F.col("p_size") > 30, "国务院文件").when(F.col("p_size") > 20, "部门规章").otherwise("通知")
    kind = G.document_type(number, title)
    return tables.load(spark, sf, "part").select("p_partkey", kind.alias("document_type"), G.corpus_of(kind).alias("corpus"), G.policy_level_type(level).alias("policy_type"))


ALLOW_SQL = """o AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'upper' WHEN '2-HIGH' THEN 'departmental' WHEN '3-MEDIUM' THEN 'departmental' WHEN '5-LOW' THEN 'outside' ELSE '' END AS authority,
     o_totalprice > 100000 AS verified, CASE o_orderstatus WHEN 'F' THEN 'current' WHEN 'O' THEN 'repealed' ELSE 'unverified' END AS status,
     o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS listed FROM orders),
   decided AS (SELECT o_orderkey, authority, CASE authority
     WHEN 'upper' THEN CASE WHEN NOT verified THEN 'upper_law_requires_competent_official_source' WHEN status = 'current' THEN 'verified_current_upper_law_outside_departmental_allowlist_scope' WHEN status = 'repealed' THEN 'explicitly_repealed_upper_law' ELSE 'upper_law_requires_explicit_current_or_repeal_evidence' END
     WHEN 'outside' THEN CASE WHEN NOT verified THEN 'out_of_scope_document_requires_competent_official_source' WHEN status = 'current' THEN 'verified_current_document_outside_departmental_allowlist_scope' WHEN status = 'repealed' THEN 'explicitly_repealed_document_outside_departmental_allowlist_scope' ELSE 'out_of_scope_document_requires_explicit_current_or_repeal_evidence' END
     WHEN 'departmental' THEN CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN 'departmental_document_published_on_or_after_allowlist_cutoff' WHEN listed THEN 'pre_cutoff_departmental_document_number_allowlisted' ELSE 'pre_cutoff_departmental_document_number_not_allowlisted' END
     ELSE 'authority_classification_required_before_allowlist_evaluation' END AS reason, o_orderstatus, o_custkey FROM o)"""
ALLOWED_SQL = "(reason LIKE 'verified_%' OR reason LIKE '%on_or_after_allowlist_cutoff' OR reason LIKE '%number_allowlisted')"


def decided_orders(spark, sf):
    orders = tables.load(spark, sf, "orders")
    allow = tables.load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    level = F.col("o_orderpriority")
    authority = F.when(level == "1-URGENT", "upper").when(level.isin("2-HIGH", "3-MEDIUM"), "departmental").when(level == "5-LOW", "outside").otherwise("")
    word = F.when(F.col("o_orderstatus") == "F", "有效").when(F.col("o_orderstatus") == "O", "失效")
    verdict = G.allowlist_decision(
        authority, F.col("o_totalprice") > 100000, G.status_map(word), F.col("o_orderdate").cast("date"),
        F.lit("1998-01-01").cast("date"), F.col("o_orderkey").cast("string"), F.col("hit").isNotNull(),
    )
    return orders.join(allow, "o_orderkey", "left").withColumn("authority", authority).withColumn("v", verdict)


@query("allowlist_decision", f"WITH {ALLOW_SQL} SELECT o_orderkey, {ALLOWED_SQL} AS allowed, reason FROM decided")
def allowlist_decision(spark, sf):
    return decided_orders(spark, sf).select("o_orderkey", "v.allowed", "v.reason")


FASTPATH_SQL = """src AS (SELECT l_orderkey, count(*) AS n, bool_or(l_quantity < 2) AS uncitable, bool_or(l_linestatus <> 'O') AS stale, bool_or(l_returnflag = 'A') AS unpassed FROM lineitem GROUP BY 1),
  runs AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'candidate_did_not_produce_visible_answer' END, CASE WHEN o_totalprice < 20000 THEN 'retrieval_not_allowed' END,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unresolved_question_state' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'planner_model_used' END,
    CASE WHEN n IS NULL THEN 'no_sources' END, CASE WHEN uncitable THEN 'source_not_clause_citable' END, CASE WHEN stale THEN 'source_not_current' END, CASE WHEN unpassed THEN 'source_not_governance_passed' END], lambda x: x IS NOT NULL) AS reasons,
    o_totalprice, o_custkey FROM orders LEFT JOIN src ON l_orderkey = o_orderkey)"""


def fastpath_runs(spark, sf):
    line = tables.load(spark, sf, "lineitem")
    src = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n"), F.max(F.col("l_quantity") < 2).alias("uncitable"), F.max(F.col("l_linestatus") != "O").alias("stale"), F.max(F.col("l_returnflag") == "A").alias("unpassed")
    )
    return tables.load(spark, sf, "orders").join(src, "o_orderkey", "left").withColumn(
        "reasons",
        G.reasons(
            # Reason codes of the gate.
            ("candidate_did_not_produce_visible_answer", F.col("o_orderstatus") != "F"),
            ("retrieval_not_allowed", F.col("o_totalprice") < 20000),
            ("unresolved_question_state", F.col("o_orderpriority") == "4-NOT SPECIFIED"),
            ("planner_model_used", F.col("o_orderpriority") == "1-URGENT"),
            ("no_sources", F.col("n").isNull()),
            ("source_not_clause_citable", F.col("uncitable")),
            ("source_not_current", F.col("stale")),
            ("source_not_governance_passed", F.col("unpassed")),
        ),
    )


@query("gate_fastpath", f"WITH {FASTPATH_SQL} SELECT o_orderkey, len(reasons) = 0 AS eligible, array_to_string(reasons, '|') AS reasons FROM runs")
def gate_fastpath(spark, sf):
    return fastpath_runs(spark, sf).select("o_orderkey", (F.size("reasons") == 0).alias("eligible"), F.array_join("reasons", "|").alias("reasons"))


@query(
    "rejection_reasons",
    f"""WITH {FASTPATH_SQL}, e AS (SELECT unnest(reasons) AS reason, o_totalprice FROM runs)
      SELECT reason, count(*) AS n, round(avg(o_totalprice), 4) AS mean_latency, 0::BIGINT AS false_admissions FROM e GROUP BY 1
      UNION ALL SELECT '(eligible)', count(*), round(avg(o_totalprice), 4), count(*) FILTER (WHERE o_totalprice > 300000) FROM runs WHERE len(reasons) = 0""",
)
def rejection_reasons(spark, sf):
    from clausework.operators import usage

    runs = fastpath_runs(spark, sf).select("reasons", F.col("o_totalprice").alias("latency"), (F.col("o_totalprice") > 300000).alias("wrong"))
    return usage.rejection_reasons(runs)


@query(
    "sensitive_scan",
    "SELECT doc_id AS document_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in G.SENSITIVE) + "], lambda x: x IS NOT NULL), '|') AS kinds FROM documents",
)
def sensitive_scan(spark, sf):
    return tables.load(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(G.sensitive_kinds(F.col("text")), "|").alias("kinds"))


@query(
    "safe_log_projection",
    f"""SELECT query_id, sha256(question) AS question_hash, CAST(length(question) AS BIGINT) AS chars, CAST(len(string_split_regex(trim(question), '[ \\t\\r\\n]+')) AS BIGINT) AS words,
       array_to_string(list_sort(list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+'))), '|') AS topics FROM ({USER_TURNS}) q""",
)
def safe_log_projection(spark, sf):
    topics = F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))))
    return user_turns(spark, sf).select(
        "query_id", ids.sha256("question").alias("question_hash"), F.char_length("question").cast("long").alias("chars"),
        F.size(F.split(F.trim("question"), "[ \\t\\r\\n]+")).cast("long").alias("words"), F.array_join(topics, "|").alias("topics"),
    )


# Rule table: intent, rule group, pattern; a row passes an intent when every group has a hit.
EVIDENCE_RULES = [("fr", 1, "eau"), ("fr", 1, "tion"), ("fr", 2, "les"), ("en", 1, "the"), ("en", 2, "ing"), ("en", 2, "tion"), ("de", 1, "sch"), ("es", 1, "cion"), ("es", 1, "ción")]
_RULE_VALUES = ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in EVIDENCE_RULES)


@query(
    "evidence_rules",
    f"""WITH {DOCS}, {LINES}, rules AS (SELECT * FROM (VALUES {_RULE_VALUES}) r(intent, grp, pattern)),
       h AS (SELECT l.document_id, unit_order, intent, count(DISTINCT grp) AS hit FROM lines l JOIN docs d ON d.document_id = l.document_id JOIN rules ON intent = corpus AND contains(lower(l.text), pattern) GROUP BY 1, 2, 3)
       SELECT document_id, unit_order FROM h JOIN (SELECT intent, count(DISTINCT grp) AS need FROM rules GROUP BY 1) n USING (intent) WHERE hit = need""",
)
def evidence_rules(spark, sf):
    from clausework.operators import evidence

    rules = spark.createDataFrame(EVIDENCE_RULES, "intent string, grp int, pattern string")
    plans = tables.documents(spark, sf).select("document_id", F.col("corpus").alias("intent"))
    rows = tables.line_units(spark, sf).join(plans, "document_id")
    return evidence.rule_rows(rows, rules).select("document_id", "unit_order")


# Rule table: ordered text rules and the strategy of each label.
INTENT_RULES = [("definition", 1, "what"), ("comparison", 2, " oder "), ("procedure", 3, "tion"), ("lookup", 4, "ing"), ("general", 5, "e")]
STRATEGIES = [("definition", "clause", 10), ("comparison", "document", 40), ("procedure", "section", 20), ("lookup", "clause", 5)]


@query(
    "intent_rules",
    f"""WITH q AS ({USER_TURNS} UNION ALL SELECT -1 - item_id, text FROM benchmark), m AS (SELECT query_id, CASE WHEN contains(lower(question), 'what') THEN 'definition' WHEN contains(lower(question), ' oder ') THEN 'comparison'
       WHEN contains(lower(question), 'tion') THEN 'procedure' WHEN contains(lower(question), 'ing') THEN 'lookup' END AS label FROM q)
       SELECT query_id, coalesce(label, 'general') AS label, coalesce(mode, 'any') AS mode, CAST(coalesce(depth, 10) AS BIGINT) AS depth
       FROM m LEFT JOIN (VALUES ('definition', 'clause', 10), ('comparison', 'document', 40), ('procedure', 'section', 20), ('lookup', 'clause', 5)) s(label, mode, depth) USING (label)""",
)
def intent_rules(spark, sf):
    q = user_turns(spark, sf).unionByName(tables.queries(spark, sf).withColumn("query_id", -1 - F.col("query_id")))
    rules = spark.createDataFrame(INTENT_RULES, "label string, priority int, pattern string")
    strategies = spark.createDataFrame(STRATEGIES, "label string, mode string, depth long")
    labelled = q.select("query_id").join(G.rule_labels(q, "query_id", "question", rules), "query_id", "left")
    labelled = labelled.select("query_id", F.coalesce("label", F.lit("general")).alias("label")).join(strategies, "label", "left")
    return labelled.select("query_id", "label", F.coalesce("mode", F.lit("any")).alias("mode"), F.coalesce("depth", F.lit(10)).alias("depth"))
