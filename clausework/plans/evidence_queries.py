"""Governance reconciliation, evidence checks, rule-driven retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from clausework import tables
from clausework.functions import ids, text as T
from clausework.operators import corpus as C, document_parts as D, evaluation as E, evidence as V, governance as G, joins as J, lexical as L, ranking
from clausework.operators.joins import contains_join
from clausework.plans.filter_queries import ALLOW_SQL, ALLOWED_SQL, USER_TURNS, decided_orders, user_turns
from clausework.plans.fusion_queries import ROUTES, routes, vectors_as_queries
from clausework.plans.join_queries import GOLD_SQL, LEXICON_SQL, REGISTRY_SQL, gold_groups, lexicon, lexicon_hits, registry_best
from clausework.plans.operations_queries import FINDINGS_SQL, findings
from clausework.plans.oracle import DOCS, LINES, RANK, TERMS, TWO_STAGE, UNITS, norm, scored
from clausework.plans.registry import query
from clausework.plans.text_queries import GROUND_SQL, IDENTIFIERS, SENTENCES_SQL
from clausework.scratch import spread


@query(
    "status_reconcile",
    f"""WITH {REGISTRY_SQL} SELECT document_id, CASE WHEN registry_id IS NULL THEN 'unverified' WHEN similarity < 0.72::DOUBLE THEN 'governance_conflict' WHEN s_acctbal > 5000 THEN 'repealed' ELSE 'current' END AS new_status,
       CASE WHEN c_acctbal > 0 THEN 'current' ELSE 'unverified' END AS old_status, CASE WHEN similarity >= 0.72::DOUBLE THEN official_title ELSE title END AS corrected_title FROM best""",
)
def status_reconcile(spark, sf):
    best = registry_best(spark, sf)
    return G.reconcile(best, F.when(F.col("s_acctbal") > 5000, "repealed").otherwise("current"), F.when(F.col("c_acctbal") > 0, "current").otherwise("unverified"))


OVERRIDE_SQL = f"""o AS (SELECT doc_id AS document_id, CASE WHEN source IN ('src1', 'src2') THEN 'current' WHEN source = 'src3' THEN 'repealed' END AS status, source = 'src1' OR source = 'src3' AS can_answer FROM documents WHERE source IN ('src1', 'src2', 'src3') UNION ALL SELECT -1, 'current', true),
   j AS (SELECT o.document_id, o.status, o.can_answer, d.review_status, d.document_id IS NULL AS unknown FROM o LEFT JOIN docs d ON d.document_id = o.document_id)"""


@query(
    "override_apply",
    f"""WITH {DOCS}, {OVERRIDE_SQL}, bad AS (SELECT *, unknown OR (can_answer AND NOT (status = 'current' AND review_status = 'approved_for_service')) AS rejected FROM j)
       SELECT d.document_id, CASE WHEN b.rejected IS NULL OR b.rejected THEN d.effective_status ELSE b.status END AS effective_status, coalesce(b.rejected, false) AS rejected FROM docs d LEFT JOIN bad b ON b.document_id = d.document_id
       UNION ALL SELECT document_id, 'unknown_document', true FROM bad WHERE unknown""",
)
def override_apply(spark, sf):
    docs = tables.documents(spark, sf)
    src = F.col("document_type")
    manual = docs.where(src.isin("src1", "src2", "src3")).select("document_id", F.when(src == "src3", "repealed").otherwise("current").alias("status"), src.isin("src1", "src3").alias("can_answer"))
    extra = spark.createDataFrame([(-1, "current", True)], "document_id long, status string, can_answer boolean")
    return G.apply_overrides(docs, manual.unionByName(extra))


@query(
    "refresh_findings",
    f"""WITH {DOCS}, {LINES}, {FINDINGS_SQL}, k AS (SELECT f.document_id, unit_order, finding_type, CASE WHEN finding_type = 'missing_standard_number' AND effective_status = 'repealed' THEN 'info' ELSE severity END AS severity FROM findings f LEFT JOIN docs d ON d.document_id = f.document_id
         WHERE NOT (finding_type = 'effective_status_unverified' AND corpus = 'en'))
       SELECT * FROM k UNION ALL SELECT document_id, 0, 'governance_conflict', 'warning' FROM docs WHERE effective_status = 'repealed' AND corpus = 'de'""",
)
def refresh_findings(spark, sf):
    docs = tables.documents(spark, sf).select("document_id", "effective_status", "corpus")
    old = findings(spark, sf)
    stale = old.where("finding_type = 'effective_status_unverified'").join(docs.where("corpus = 'en'"), "document_id", "left_semi").select("finding_id")
    kept = old.join(stale, "finding_id", "left_anti").join(docs, "document_id", "left")
    severity = F.when((F.col("finding_type") == "missing_standard_number") & (F.col("effective_status") == "repealed"), "info").otherwise(F.col("severity"))
    added = docs.where("effective_status = 'repealed' AND corpus = 'de'").select("document_id", F.lit(0).cast("long").alias("unit_order"), F.lit("governance_conflict").alias("finding_type"), F.lit("warning").alias("severity"))
    return kept.select("document_id", "unit_order", "finding_type", severity.alias("severity")).unionByName(added)


@query(
    "deleted_clauses",
    """WITH a AS (SELECT l_orderkey, l_suppkey || '.' || l_linenumber AS clause, l_partkey FROM lineitem WHERE l_returnflag = 'R')
       SELECT l_orderkey AS document_id, clause, count(*) AS evidence_chunks, min(length('删除 ' || clause || '。' || repeat('x', CAST(l_partkey % 9 AS INTEGER)))) AS shortest FROM a GROUP BY 1, 2""",
)
def deleted_clauses(spark, sf):
    line = tables.load(spark, sf, "lineitem").where("l_returnflag = 'R'")
    clause = F.concat_ws(".", "l_suppkey", "l_linenumber")
    text = F.concat(F.lit("删除 "), clause, F.lit("。"), F.repeat(F.lit("x"), (F.col("l_partkey") % 9).cast("int")))
    return G.deleted_clauses(line.select(F.col("l_orderkey").alias("document_id"), text.alias("text")))


@query("metadata_status", "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 60 THEN 'current' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 30 THEN 'repealed' ELSE 'unverified' END AS status FROM events")
def metadata_status(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return tables.load(spark, sf, "events").select("event_id", G.status_map(F.when(k > 60, "现行").when(k > 30, "废止")).alias("status"))


@query("allowlist_audit", f"WITH {ALLOW_SQL} SELECT authority, reason, count(*) AS n, count(DISTINCT o_custkey) AS owners, count(*) FILTER (WHERE {ALLOWED_SQL}) AS allowed FROM decided GROUP BY 1, 2")
def allowlist_audit(spark, sf):
    return decided_orders(spark, sf).groupBy("authority", F.col("v.reason").alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("owners"), F.count_if("v.allowed").alias("allowed"))


@query("lexicon_conflicts", "WITH e AS (SELECT p_partkey AS id, p_name AS probe, p_type AS canonical FROM part), g AS (SELECT probe, count(DISTINCT canonical) AS meanings, count(*) AS entries FROM e GROUP BY 1 HAVING count(DISTINCT canonical) > 1) SELECT id AS lexicon_id, probe, meanings, entries FROM e JOIN g USING (probe)")
def lexicon_conflicts(spark, sf):
    entries = tables.load(spark, sf, "part").select(F.col("p_partkey").alias("lexicon_id"), F.col("p_name").alias("probe"), F.col("p_type").alias("canonical"))
    return G.lexicon_conflicts(entries)


@query(
    "lexicon_preview",
    f"""WITH {LEXICON_SQL}, x AS (SELECT query_id, length(question) % 2 = 0 AS positive FROM asked), h AS (SELECT x.query_id, positive, count(hit.lexicon_id) AS hits FROM x LEFT JOIN hit USING (query_id) GROUP BY 1, 2)
       SELECT positive, count(*) AS examples, count(*) FILTER (WHERE (hits > 0) = positive) AS passed, bool_and((hits > 0) = positive) AS all_passed FROM h GROUP BY 1""",
)
def lexicon_preview(spark, sf):
    examples = user_turns(spark, sf).select("query_id", (F.char_length(T.normalize("question")) % 2 == 0).alias("positive"))
    hits = lexicon_hits(spark, sf).select("query_id").distinct().withColumn("hit", F.lit(True))
    ok = F.coalesce("hit", F.lit(False)) == F.col("positive")
    return examples.join(hits, "query_id", "left").groupBy("positive").agg(F.count("*").alias("examples"), F.count_if(ok).alias("passed"), F.min(ok).alias("all_passed"))


HITS_SQL = f"{ROUTES}, hits AS (SELECT query_id, document_id, unit_id, unit_id % 7 AS clause, score, rank FROM dense WHERE rank <= 20)"


def dense_hits(spark, sf):
    return routes(spark, sf)[1].where("rank <= 20").withColumn("clause", F.col("unit_id") % 7)


@query(
    "evidence_sufficiency",
    f"""WITH {HITS_SQL}, t AS (SELECT query_id, unnest([0, 1, 2]) AS target FROM (SELECT DISTINCT query_id FROM hits) s), d AS (SELECT * FROM hits WHERE clause IN (0, 1, 2)),
       a AS (SELECT query_id, count(*) AS direct, count(DISTINCT document_id) AS documents FROM d GROUP BY 1), m AS (SELECT t.query_id, count(*) FILTER (WHERE d.query_id IS NULL) AS missing FROM t LEFT JOIN (SELECT DISTINCT query_id, clause FROM d) d ON d.query_id = t.query_id AND d.clause = t.target GROUP BY 1)
       SELECT m.query_id, coalesce(direct, 0) AS direct, coalesce(documents, 0) AS documents, missing, coalesce(direct, 0) > 0 AND missing = 0 AND (m.query_id % 40 = 0 OR coalesce(documents, 0) >= 2) AS sufficient FROM m LEFT JOIN a USING (query_id)""",
)
def evidence_sufficiency(spark, sf):
    hits = dense_hits(spark, sf).where("clause in (0, 1, 2)").withColumnRenamed("clause", "target")
    queries_ = vectors_as_queries(spark, sf)[0].select("query_id")
    targets = queries_.select("query_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("target"))
    return V.sufficiency(hits, targets, F.col("query_id") % 40 == 20)


@query(
    "evidence_select",
    f"""WITH {HITS_SQL}, f AS (SELECT query_id, document_id, CASE WHEN query_id % 40 = 20 THEN '' ELSE CAST(clause AS VARCHAR) END AS slot, min(rank) AS rank FROM hits GROUP BY 1, 2, 3)
       SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seat FROM f QUALIFY seat <= 4""",
)
def evidence_select(spark, sf):
    return V.select_evidence(dense_hits(spark, sf), F.col("query_id") % 40 == 20)


@query("discover_documents", f"WITH {HITS_SQL} SELECT query_id, document_id, count(DISTINCT clause) AS groups, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(DISTINCT clause) DESC, max(score) DESC, document_id) AS position FROM hits GROUP BY 1, 2 QUALIFY position <= 5")
def discover_documents(spark, sf):
    docs = dense_hits(spark, sf).groupBy("query_id", "document_id").agg(F.count_distinct("clause").alias("groups"), F.max("score").alias("score"))
    w = W.partitionBy("query_id").orderBy(F.desc("groups"), F.desc("score"), "document_id")
    return docs.withColumn("position", F.row_number().over(w).cast("long")).where("position <= 5")


TURNS_SQL = """a AS (SELECT conv_id * 1000 + turn AS key, conv_id, turn, text FROM conversations WHERE role = 'assistant'), e AS (SELECT conv_id * 1000 + turn + 1 AS key, text FROM conversations WHERE role = 'user')"""


def answers(spark, sf):
    conv = tables.load(spark, sf, "conversations")
    mine = conv.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    asked = conv.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("key"), "text")
    return mine, asked


@query(
    "claim_grounding",
    f"""WITH {TURNS_SQL}, s AS (SELECT key, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS claim_no, unnest(ls) AS claim FROM (SELECT key, string_split(text, chr(10)) AS ls FROM a) x),
       n AS (SELECT key, claim_no, {GROUND_SQL.format('claim')} AS c FROM s), g AS (SELECT key, claim_no, list_filter(list_distinct([substr(c, i, 2) for i in range(1, length(c))]), lambda x: NOT regexp_matches(x, '^[0-9]+$')) AS grams FROM n WHERE length(c) >= 12),
       j AS (SELECT g.*, coalesce({GROUND_SQL.format('e.text')}, '') AS support FROM g LEFT JOIN e USING (key)), r AS (SELECT key, claim_no, len(list_filter(grams, lambda x: contains(support, x))) / CAST(len(grams) AS DOUBLE) AS share FROM j WHERE len(grams) >= 5)
       SELECT key, claim_no, round(share, 6) AS support, share < 0.38::DOUBLE AS unsupported FROM r""",
)
def claim_grounding(spark, sf):
    mine, asked = answers(spark, sf)
    claims = mine.select("key", F.posexplode(T.lines("text")).alias("pos", "text")).select("key", (F.col("pos") + 1).cast("long").alias("claim_no"), "text")
    return V.bigram_support(claims, asked)


#: Document numbers, else whole words of any script.
REFERENCES = "[a-z]+-[0-9]+|[0-9]+(?:[.][0-9]+)+|[\\p{L}\\p{N}]+"


@query(
    "unverified_references",
    f"""WITH {TURNS_SQL}, r AS (SELECT DISTINCT key, unnest(regexp_extract_all(lower(text), '{REFERENCES}')) AS ref FROM a), s AS (SELECT DISTINCT key, unnest(regexp_extract_all(lower(text), '{REFERENCES}')) AS ref FROM e)
       SELECT key AS answer_id, ref FROM r ANTI JOIN s USING (key, ref)""",
)
def unverified_references(spark, sf):
    """Document numbers and words of an answer that its own sources (the turn before) do not hold, of any length and script."""
    mine, asked = answers(spark, sf)
    return V.unverified_references(mine, asked, REFERENCES).withColumnRenamed("key", "answer_id")


@query(
    "ungrounded_facts",
    f"""WITH {TURNS_SQL}, f AS (SELECT DISTINCT key, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS value FROM a), s AS (SELECT key, {GROUND_SQL.format('text')} AS support FROM e)
       SELECT f.key, value FROM f LEFT JOIN s USING (key) WHERE NOT coalesce(contains(support, {GROUND_SQL.format('value')}), false)""",
)
def ungrounded_facts(spark, sf):
    mine, asked = answers(spark, sf)
    return V.unsupported_values(mine, asked, F.array_distinct(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}]+"), F.lit(0))))


@query(
    "fact_compaction",
    """WITH f AS (SELECT l_suppkey AS answer_id, l_orderkey AS fact_no, l_linenumber AS use_no, l_partkey % 50 AS source FROM lineitem), p AS (SELECT answer_id, source, min((fact_no, use_no)) AS place FROM f GROUP BY 1, 2),
       n AS (SELECT answer_id, source, row_number() OVER (PARTITION BY answer_id ORDER BY place, source) AS new_no FROM p QUALIFY new_no <= 24) SELECT answer_id, fact_no, use_no, source, new_no FROM f JOIN n USING (answer_id, source)""",
)
def fact_compaction(spark, sf):
    facts = tables.load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("answer_id"), F.col("l_orderkey").alias("fact_no"), F.col("l_linenumber").alias("use_no"), (F.col("l_partkey") % 50).alias("source"))
    return V.compact_sources(facts)


@query("comparison_matrix", "SELECT p_type, p_brand, count(*) FILTER (WHERE l_returnflag = 'A') AS \"A\", count(*) FILTER (WHERE l_returnflag = 'N') AS \"N\", count(*) FILTER (WHERE l_returnflag = 'R') AS \"R\" FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def comparison_matrix(spark, sf):
    facts = tables.load(spark, sf, "lineitem").join(tables.load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey")
    return V.comparison_matrix(facts, ["p_type", "p_brand"], "l_returnflag", ["A", "N", "R"])


@query(
    "gold_case_audit",
    f"""WITH {GOLD_SQL}, u AS (SELECT m.*, l.text FROM mapped m LEFT JOIN lines l ON l.document_id = m.document_id AND l.unit_order = m.unit_order),
       c AS (SELECT item_id, bool_or(document_id IS NULL) AS unresolved, coalesce(bool_or(length(text) >= 1200), false) AS oversized, coalesce(bool_or(length(text) < 20), false) AS short FROM u GROUP BY 1)
       SELECT item_id, concat_ws('|', CASE WHEN unresolved THEN 'unresolved_source' END, CASE WHEN oversized THEN 'oversized_source' END, CASE WHEN short THEN 'short_source' END) AS issues,
        CASE WHEN unresolved THEN 'boundary_blocked' WHEN oversized THEN 'needs_preprocessing' WHEN short THEN 'needs_context' ELSE 'ready' END AS status FROM c""",
)
def gold_case_audit(spark, sf):
    lines = tables.line_units(spark, sf).select("document_id", "unit_order", F.char_length("text").alias("n"))
    joined = gold_groups(spark, sf).join(lines, ["document_id", "unit_order"], "left")
    return E.audit_gold(joined)


@query(
    "per_document_evidence",
    f"""WITH {UNITS}, t AS (SELECT DISTINCT item_id AS target, unnest(regexp_extract_all({norm('text')}, '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark),
       w AS (SELECT DISTINCT document_id, unit_order, unnest(regexp_extract_all(search_text, '[\\p{{L}}\\p{{N}}]+')) AS word FROM units), s AS (SELECT target, document_id, unit_order, count(*) AS score FROM t JOIN w USING (word) GROUP BY 1, 2, 3)
       SELECT *, row_number() OVER (PARTITION BY target, document_id ORDER BY score DESC, unit_order) AS rank FROM s QUALIFY rank <= 3""",
)
def per_document_evidence(spark, sf):
    """The best three units of every document for every target, decided inside the document's row; only ids that stand in several rows are joined by word."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))
    asked = tables.queries(spark, sf).groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(words(T.normalize("question"))))).alias("words"))
    docs = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text").where("text is not null")
    repeated = D.repeated_ids(docs, "document_id")
    once = docs if repeated is None else docs.join(repeated, F.col("document_id").eqNullSafe(F.col("_id")), "left_anti")
    units = F.transform(T.lines("text"), lambda line: words(T.normalize(line)))
    out = D.best_units(spread(once).select("document_id", units.alias("units")), asked, 3)
    if repeated is not None:
        rows = docs.join(repeated, F.col("document_id").eqNullSafe(F.col("_id")), "left_semi")
        out = out.unionByName(V.best_shared_words(rows.select("document_id", F.posexplode(units).alias("pos", "words")).selectExpr("document_id", "pos + 1L as unit_order", "words"), asked, 3))
    return out.withColumnRenamed("query_id", "target")


@query(
    "required_refs_check",
    """WITH r AS (SELECT o_orderkey AS query_id, '1.' || (o_custkey % 3) AS ref FROM orders), h AS (SELECT l_orderkey AS query_id, '1.' || (l_partkey % 3) || '.' || l_linenumber AS clause, l_partkey AS hit_id, l_quantity AS score FROM lineitem),
       b AS (SELECT r.query_id, ref, max((score, hit_id)) AS b FROM r JOIN h ON h.query_id = r.query_id AND (clause = ref OR starts_with(clause, ref || '.')) GROUP BY 1, 2)
       SELECT r.query_id, r.ref, coalesce(b[2], -1) AS hit_id, b IS NULL AS missing FROM r LEFT JOIN b ON b.query_id = r.query_id AND b.ref = r.ref""",
)
def required_refs_check(spark, sf):
    need = tables.load(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("1."), (F.col("o_custkey") % 3).cast("string")).alias("ref"))
    clause = F.concat(F.lit("1."), (F.col("l_partkey") % 3).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    hits = tables.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), clause.alias("clause"), F.col("l_partkey").alias("hit_id"), F.col("l_quantity").alias("score"))
    return V.required_refs(need, hits).withColumn("hit_id", F.coalesce("hit_id", F.lit(-1)))


@query(
    "review_state",
    """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS action, arg_max(CAST(value AS BIGINT) % 2, event_id) AS fp FROM events GROUP BY 1)
       SELECT c_custkey AS candidate_id, coalesce(CASE action WHEN 'purchase' THEN 'preview_ok' ELSE action END, 'pending') AS state, coalesce(action = 'purchase' AND fp = c_custkey % 2 AND c_acctbal > 0, false) AS approvable FROM customer LEFT JOIN l ON user_id = c_custkey""",
)
def review_state(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", "preview_ok").otherwise(F.col("event_type"))
    actions = tables.load(spark, sf, "events").select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("seq"), kind.alias("action"), (F.rint("value").cast("long") % 2).alias("fingerprint"))
    cands = tables.load(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), (F.col("c_custkey") % 2).alias("fingerprint"), (F.col("c_acctbal") > 0).alias("has_examples"))
    return V.review_state(actions, cands)


@query("rule_facts", f"""WITH {LINES} SELECT document_id, unit_order, 'license' AS topic, unnest(regexp_extract_all(text, '([A-Z][a-z]+) License', 1)) AS value FROM lines UNION ALL SELECT document_id, unit_order, 'version', unnest(regexp_extract_all(text, '[Vv]ersion ([0-9]+)', 1)) FROM lines""")
def rule_facts(spark, sf):
    return V.rule_facts(tables.line_units(spark, sf), [("license", "([A-Z][a-z]+) License"), ("version", "[Vv]ersion ([0-9]+)")])


@query(
    "anchor_sequence_extract",
    f"""WITH {SENTENCES_SQL}, n AS (SELECT document_id, sentence_no, sentence, lower(regexp_replace(sentence, '[ \\t\\r\\n]+', '', 'g')) AS d, lead(sentence) OVER w AS s2, lower(regexp_replace(lead(sentence) OVER w, '[ \\t\\r\\n]+', '', 'g')) AS d2 FROM sentences WINDOW w AS (PARTITION BY document_id ORDER BY sentence_no)),
       m AS (SELECT document_id, min(sentence_no) AS sentence_no FROM n WHERE contains(d, 'tion') AND contains(d, 'the') AND contains(d2, 'ing') GROUP BY 1)
       SELECT document_id, sentence_no, rtrim(substr(sentence || s2, 1, 300)) || CASE WHEN length(sentence || s2) > 300 THEN '...' ELSE '' END AS quote FROM m JOIN n USING (document_id, sentence_no)""",
)
def anchor_sequence_extract(spark, sf):
    docs = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), T.split_sentences("text").alias("sentences"))
    return V.sequence_runs(docs, [("tion", "the"), ("ing",)], 300).select("document_id", (F.col("start") + 1).cast("long").alias("sentence_no"), "quote")


QUOTE_TERMS = ["tion", "ing", "eau", "sch", "ción"]


@query(
    "quote_window",
    f"""WITH {SENTENCES_SQL}, s AS (SELECT *, {' + '.join(f"contains(sentence, '{t}')::INT" for t in QUOTE_TERMS)} AS score, count(*) OVER (PARTITION BY document_id) AS n FROM sentences),
       b AS (SELECT document_id, n, arg_min(sentence_no, (-score, sentence_no)) AS best, max(score) AS score FROM s GROUP BY 1, 2)
       SELECT document_id, best AS best_sentence, CAST(score AS BIGINT) AS score, n AS sentences FROM b WHERE score > 0""",
)
def quote_window(spark, sf):
    docs = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), T.split_sentences("text").alias("sentences"))
    return V.quote_windows(docs, QUOTE_TERMS, 200, 3).select("document_id", F.col("best").cast("long").alias("best_sentence"), F.array_max("scores").cast("long").alias("score"), F.size("sentences").cast("long").alias("sentences"))


@query("contains_gold", "SELECT item_id, doc_id AS document_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def contains_gold(spark, sf):
    return gold_documents(spark, sf)


def gold_documents(spark, sf):
    gold = tables.load(spark, sf, "benchmark").select("item_id", F.col("text").alias("pattern"))
    docs = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return J.passage_join(docs, gold).select("item_id", "document_id")


@query(
    "hit_mrr_coverage",
    f"""WITH {ROUTES}, g AS (SELECT query_id, unit_id, document_id, (rank - 1) // 2 AS group_id FROM lex WHERE rank <= 10), r AS (SELECT * FROM dense WHERE rank <= 20),
       u AS (SELECT g.query_id, group_id, min(r.rank) AS rank FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.unit_id = g.unit_id GROUP BY 1, 2),
       s AS (SELECT query_id, coalesce(bool_or(rank <= 10), false) AS unit_hit, coalesce(1.0::DOUBLE / min(rank), 0.0::DOUBLE) AS rr, count(rank) / CAST(count(*) AS DOUBLE) AS coverage FROM u GROUP BY 1),
       d AS (SELECT g.query_id, bool_or(r.query_id IS NOT NULL) AS doc_hit FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.document_id = g.document_id AND r.rank <= 10 GROUP BY 1)
       SELECT count(*) AS cases, round(avg(unit_hit::INT), 6) AS unit_hit, round(avg(doc_hit::INT), 6) AS doc_hit, round(avg(rr), 6) AS mrr, round(avg(coverage), 6) AS coverage, count(*) FILTER (WHERE coverage = 1) AS complete FROM s JOIN d USING (query_id)""",
)
def hit_mrr_coverage(spark, sf):
    lex, dense = routes(spark, sf)
    gold = lex.where("rank <= 10").select("query_id", "unit_id", "document_id", F.floor((F.col("rank") - 1) / 2).alias("group_id"))
    per = E.hit_mrr_coverage(dense, gold)
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return per.agg(F.count("*").alias("cases"), mean("unit_hit").alias("unit_hit"), mean("doc_hit").alias("doc_hit"), mean("rr").alias("mrr"), mean("coverage").alias("coverage"), F.count_if(F.col("coverage") == 1).alias("complete"))


@query("latency_percentiles", "WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(CASE WHEN rn = CAST(floor(0.95::DOUBLE * (n - 1)) AS BIGINT) + 1 THEN value END) AS p95_nearest FROM s GROUP BY 1")
def latency_percentiles(spark, sf):
    return E.latency_percentiles(tables.load(spark, sf, "events"), "event_type", "value")


@query(
    "expected_found",
    "WITH e AS (SELECT DISTINCT l_orderkey AS case_id, l_returnflag AS variant, l_partkey % 50 AS label FROM lineitem), f AS (SELECT l_orderkey AS case_id, l_suppkey % 50 AS label FROM lineitem), j AS (SELECT case_id, variant, bool_and((case_id, label) IN (SELECT (case_id, label) FROM f)) AS ok FROM e GROUP BY 1, 2) SELECT variant, count(*) AS cases, round(avg(ok::INT), 6) AS rate FROM j GROUP BY 1",
)
def expected_found(spark, sf):
    line = tables.load(spark, sf, "lineitem")
    want = line.select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("variant"), (F.col("l_partkey") % 50).alias("label")).distinct()
    found = line.select(F.col("l_orderkey").alias("case_id"), (F.col("l_suppkey") % 50).alias("label")).distinct()
    return E.expected_found(want, found)


@query("classification_accuracy", "SELECT event_type AS stage, count(*) AS runs, round(avg((value > 20)::INT), 6) AS accuracy, count(*) FILTER (WHERE value > 200) AS errors, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def classification_accuracy(spark, sf):
    v = F.col("value")
    events = tables.load(spark, sf, "events").select(F.col("event_type").alias("stage"), "value")
    counts = events.groupBy("stage").agg(F.count("*").alias("runs"), F.round(F.avg((v > 20).cast("int")), 6).alias("accuracy"), F.count_if(v > 200).alias("errors"))
    return counts.join(E.percentiles(events, "stage", "value", {"p95": 0.95}).select("stage", "p95"), "stage")


@query("vector_mapping_check", "WITH m AS (SELECT d.doc_id, e.vec_id, e.embedding FROM documents d FULL JOIN embeddings e ON e.vec_id = d.doc_id) SELECT count(doc_id) AS leaves, count(vec_id) AS vectors, count(*) FILTER (WHERE doc_id IS NULL OR vec_id IS NULL) AS mismatches, count(*) FILTER (WHERE len(embedding) <> 64) AS bad_dimension FROM m")
def vector_mapping_check(spark, sf):
    leaves = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("leaf_id"))
    vectors = tables.load(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), F.size("embedding").alias("dim"))
    return E.vector_mapping(leaves, vectors, 64)


@query("search_dedup", "WITH r AS (SELECT event_id, sha256(event_type || '|' || user_id) AS request_key FROM events) SELECT event_id, request_key, min(event_id) OVER (PARTITION BY request_key) AS executed_by FROM r")
def search_dedup(spark, sf):
    return ranking.collapse_requests(tables.load(spark, sf, "events"), "event_id", ["event_type", "user_id"])


@query("route_skip", f"WITH {ROUTES} SELECT DISTINCT query_id FROM lex WHERE query_id NOT IN (SELECT query_id FROM lex WHERE score > 0.95::DOUBLE AND unit_id <> query_id)")
def route_skip(spark, sf):
    lex = routes(spark, sf)[0]
    enough = lex.where((F.col("score") > 0.95) & (F.col("unit_id") != F.col("query_id"))).select("query_id").distinct()
    return lex.select("query_id").distinct().join(enough, "query_id", "left_anti")


@query(
    "scope_fallback",
    f"""WITH {ROUTES}, a AS (SELECT query_id, unit_id, rank, 'scoped' AS mode FROM dense WHERE document_id = query_id % 15) SELECT * FROM a UNION ALL SELECT query_id, unit_id, rank, 'unscoped' FROM dense WHERE query_id NOT IN (SELECT query_id FROM a)""",
)
def scope_fallback(spark, sf):
    dense = routes(spark, sf)[1].select("query_id", "unit_id", "rank", "document_id")
    scoped = dense.where(F.col("document_id") == F.col("query_id") % 15).select("query_id", "unit_id", "rank", F.lit("scoped").alias("mode"))
    rest = dense.join(scoped.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "unit_id", "rank", F.lit("unscoped").alias("mode"))
    return scoped.unionByName(rest)


#: Words that must stand in a document if the question has them, and words that ask for a table.
CRITICAL, TABLE_WORDS = ("license", "tion"), "table|list|of the"


@query(
    "field_heuristic_score",
    f"""WITH {UNITS}, {TERMS}, d AS (SELECT doc_id AS document_id, lower(source) || '-' || doc_id AS number, {norm("string_split(text, chr(10))[1]")} AS title, {norm("lang || ' ' || source")} AS section, {norm('text')} AS body, contains(text, '|') AS tabular FROM documents),
       q AS (SELECT item_id AS query_id, {norm('text')} AS question FROM benchmark),
       h AS (SELECT query_id, document_id, sum(5.0::DOUBLE * contains(number, term)::INT + 4.0::DOUBLE * contains(title, term)::INT + 2.5::DOUBLE * contains(section, term)::INT + 1.0::DOUBLE * contains(body, term)::INT) AS hits
         FROM d JOIN terms ON contains(number, term) OR contains(title, term) OR contains(section, term) OR contains(body, term) GROUP BY 1, 2)
       SELECT query_id, document_id, round(hits + CASE WHEN NOT tabular THEN 0.0::DOUBLE WHEN regexp_matches(question, '{TABLE_WORDS}') THEN 0.5::DOUBLE ELSE 0.5::DOUBLE - 1.2::DOUBLE END
         {" ".join(f"+ CASE WHEN NOT contains(question, '{c}') THEN 0.0::DOUBLE WHEN contains(body, '{c}') THEN 3.0::DOUBLE ELSE -3.0::DOUBLE END" for c in CRITICAL)}, 6) AS score FROM h JOIN d USING (document_id) JOIN q USING (query_id)""",
)
def field_heuristic_score(spark, sf):
    """All terms over number, title, section and whole text, with the table and critical-word rules."""
    docs = tables.load(spark, sf, "documents")
    rows = docs.select(
        F.col("doc_id").alias("document_id"), F.concat_ws("-", F.lower("source"), "doc_id").alias("number"), T.normalize(T.first_line("text")).alias("title"),
        T.normalize(F.concat_ws(" ", "lang", "source")).alias("section"), T.normalize("text").alias("body"), F.contains("text", F.lit("|")).alias("tabular"),
    )
    asked = tables.queries(spark, sf).withColumn("question", T.normalize("question"))
    return L.field_score(asked, L.query_terms(tables.queries(spark, sf)), rows, CRITICAL, TABLE_WORDS).withColumn("score", F.round("score", 6))


SCORE_RULES = [("tion", 2.0), ("ing ", 1.5), ("license", -4.5), ("eau", 1.0), ("###", -3.0)]


@query("rule_score", f"WITH {LINES} SELECT document_id, unit_order, sum(delta) AS score, count(*) AS rules_hit FROM lines JOIN (SELECT p, d::DOUBLE AS delta FROM (VALUES {', '.join(str(r) for r in SCORE_RULES)}) r(p, d)) r ON contains(lower(text), p) GROUP BY 1, 2")
def rule_score(spark, sf):
    rules = spark.createDataFrame(SCORE_RULES, "pattern string, delta double")
    return G.rule_score(tables.line_units(spark, sf), ["document_id", "unit_order"], "text", rules)


SCOPE = "scope AS (SELECT item_id AS query_id, document_id, unit_order FROM benchmark JOIN (SELECT doc_id, source FROM documents) d ON source = 'src' || (length(text) % 20) JOIN units ON document_id = doc_id)"

#: intent, group, priority, field, pattern, delta.
PLAN_RULES = [
    ("materials", 1, 1, "document_type", "fr", 18.0), ("materials", 2, 1, "section", "src1", 10.0), ("materials", 2, 2, "section", "src", 7.0), ("materials", 3, 1, "text", "license", -10.0),
    ("procedure", 1, 1, "chunk_type", "table", 8.0), ("procedure", 2, 1, "title", "tion", 6.0), ("procedure", 2, 2, "context", "the", 2.5), ("procedure", 3, 1, "number", "-7", 5.0),
]
PLAN_ARRAYS = "list(token ORDER BY token_no) FILTER (WHERE token_no BETWEEN {0} AND {1})"


@query(
    "plan_score",
    f"""WITH {UNITS}, {TERMS}, {SCOPE}, plan AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'materials' WHEN 1 THEN 'procedure' ELSE 'other' END AS intent, CASE WHEN query_id % 4 = 0 THEN ['en'] ELSE [] END AS types,
         {PLAN_ARRAYS.format(1, 2)} AS subject, {PLAN_ARRAYS.format(2, 4)} AS required, {PLAN_ARRAYS.format(5, 6)} AS alternative, {PLAN_ARRAYS.format(7, 8)} AS more, query_id % 8 = 4 AS any_type, query_id % 5 = 1 AS semantic, query_id % 2 = 0 AS hard, query_id % 5 = 0 AS tabular FROM tokens GROUP BY 1),
       c AS (SELECT s.query_id, u.document_id, u.unit_order, lang AS document_type, CASE WHEN contains(search_text, '|') THEN 'table' ELSE 'text' END AS chunk_type, source || '-' || u.document_id AS number, document_text AS title, heading_text AS section, search_text AS text,
         document_text || ' ' || heading_text || ' ' || search_text AS context FROM scope s JOIN units u USING (document_id, unit_order) JOIN documents ON doc_id = u.document_id),
       r AS (SELECT * FROM (VALUES {', '.join(str(r) for r in PLAN_RULES)}) r(intent, grp, priority, field, pattern, delta)),
       hit AS (SELECT query_id, document_id, unit_order, grp, arg_min(delta, priority)::DOUBLE AS delta FROM c JOIN plan USING (query_id) JOIN r USING (intent)
         WHERE contains(CASE field WHEN 'document_type' THEN document_type WHEN 'section' THEN section WHEN 'text' THEN text WHEN 'chunk_type' THEN chunk_type WHEN 'title' THEN title WHEN 'number' THEN number ELSE context END, pattern) GROUP BY 1, 2, 3, 4),
       sums AS (SELECT query_id, document_id, unit_order, sum(delta) AS delta FROM hit GROUP BY 1, 2, 3),
       x AS (SELECT c.*, p.* EXCLUDE (query_id), len(list_filter(coalesce(subject, []), lambda t: contains(context, t))) AS ns, len(list_filter(coalesce(required, []), lambda t: contains(context, t))) AS nr, len(list_filter(coalesce(alternative, []), lambda t: contains(context, t))) AS na,
         len(list_filter(list_distinct(list_concat(coalesce(subject, []), coalesce(required, []))), lambda t: contains(context, t))) AS nx, contains(context, 'license')::INT + contains(context, '###')::INT AS bad, len(list_filter(coalesce(more, []), lambda t: contains(context, t))) AS nm FROM c JOIN plan p USING (query_id))
     SELECT query_id, document_id, unit_order, CASE WHEN len(types) = 0 THEN 0.0::DOUBLE WHEN list_contains(types, document_type) THEN 3.0::DOUBLE WHEN any_type THEN 0.0::DOUBLE ELSE -10.0::DOUBLE END + 2.0::DOUBLE * ns + 2.5::DOUBLE * nr + 1.0::DOUBLE * na
       + CASE WHEN semantic THEN 3.0::DOUBLE * nx + CASE WHEN len(coalesce(required, [])) > 0 AND nr = len(required) THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END
       + 3.0::DOUBLE * ((na > 0)::INT + (nm > 0)::INT) + CASE WHEN na > 0 AND nm > 0 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END - least(18.0::DOUBLE, 4.5::DOUBLE * bad)
       + CASE WHEN subject IS NULL THEN 0.0::DOUBLE WHEN len(list_filter(subject, lambda t: contains(title, t))) > 0 THEN 8.0::DOUBLE WHEN hard THEN -6.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN tabular AND chunk_type = 'table' THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END + coalesce(delta, 0.0::DOUBLE) AS score
     FROM x LEFT JOIN sums USING (query_id, document_id, unit_order)""",
)
def plan_score(spark, sf):
    """Units of each query's scope against its plan: types, terms, relation, evidence groups, titles, output mode and intent rules."""
    toks = L.query_tokens(L.query_terms(tables.queries(spark, sf)))
    take = lambda a, b: F.transform(F.sort_array(F.collect_list(F.when(F.col("token_no").between(a, b), F.struct("token_no", "token")))), lambda t: t["token"])
    q = F.col("query_id")
    arrays = toks.groupBy("query_id").agg(take(1, 2).alias("subject"), take(2, 4).alias("required"), take(5, 6).alias("alternative"), take(7, 8).alias("more"))
    plans = arrays.select(
        "query_id", "subject", "required", "alternative", F.array("alternative", "more").alias("groups"), F.array(F.lit("license"), F.lit("###")).alias("negative"), F.col("subject").alias("titles"),
        F.when(q % 3 == 0, "materials").when(q % 3 == 1, "procedure").otherwise("other").alias("intent"), F.when(q % 4 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>")).alias("document_types"),
        (q % 8 == 4).alias("any_type"), (q % 5 == 1).alias("semantic"), (q % 2 == 0).alias("hard_scope"), F.when(q % 5 == 0, "table").otherwise("text").alias("output_mode"),
    )
    docs = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "lang", "source")
    scope = tables.queries(spark, sf).select("query_id", F.concat(F.lit("src"), F.char_length("question") % 20).alias("source")).join(docs, "source")
    rows = scope.join(tables.retrieval_units(spark, sf), "document_id").select(
        "query_id", "document_id", "unit_order", F.col("lang").alias("document_type"), F.when(F.contains("search_text", F.lit("|")), "table").otherwise("text").alias("chunk_type"),
        F.concat_ws("-", "source", "document_id").alias("number"), F.col("document_text").alias("title"), F.col("heading_text").alias("section"), F.col("search_text").alias("text"),
    )
    rules = spark.createDataFrame(PLAN_RULES, "intent string, grp int, priority int, field string, pattern string, delta double")
    return V.plan_score(rows, plans, rules, ["document_id", "unit_order"])


@query(
    "rule_routes",
    f"""WITH {DOCS}, {LINES}, r AS (SELECT * FROM (VALUES ('license', 'en', 5), ('version', 'en', 3), ('eau', 'fr', 4), ('ung', 'de', 6)) r(pattern, corpus, lim)),
       h AS (SELECT r.pattern AS rule, l.document_id, unit_order, lim, row_number() OVER (PARTITION BY r.pattern, l.document_id ORDER BY length(l.text), unit_order) AS position FROM lines l JOIN docs d ON d.document_id = l.document_id JOIN r ON r.corpus = d.corpus AND contains(lower(l.text), r.pattern))
       SELECT rule, document_id, unit_order, position FROM h WHERE position <= lim""",
)
def rule_routes(spark, sf):
    rules = spark.createDataFrame([("license", "en", 5), ("version", "en", 3), ("eau", "fr", 4), ("ung", "de", 6)], "pattern string, wanted string, lim int")
    corpus = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("corpus"))
    lines = tables.line_units(spark, sf).withColumn("text", F.lower("text")).join(corpus, "document_id")
    hits = contains_join(lines, rules).where(F.col("corpus") == F.col("wanted"))
    w = W.partitionBy("pattern", "document_id").orderBy(F.char_length("text"), "unit_order")
    return hits.withColumn("position", F.row_number().over(w).cast("long")).where(F.col("position") <= F.col("lim")).select(F.col("pattern").alias("rule"), "document_id", "unit_order", "position")


SCOPE_SQL = f"{UNITS}, {TERMS}, {SCOPE}, {scored('scoped', 'scope')}, lexical AS (SELECT query_id, document_id, unit_order, {RANK} AS rank FROM scoped QUALIFY rank <= 50)"


def frontier_sql(pairs: str) -> str:
    """Dense route over units (hashed tokens), fusion and head admission; ``pairs`` says which units a query may find."""
    return f"""src AS (SELECT document_id, unit_order, upper(replace(search_text, 'ß', 'SS')) AS text FROM units UNION ALL SELECT -1 - item_id, 0, upper(replace(text, 'ß', 'SS')) FROM benchmark),
       counts AS (SELECT document_id, unit_order, token, count(*) AS n FROM (SELECT document_id, unit_order, unnest(regexp_extract_all(text, '[A-Z0-9]+(?:/[A-Z0-9]+)?(?:[-.][A-Z0-9]+)*')) AS token FROM src) s GROUP BY 1, 2, 3),
       b AS (SELECT document_id, unit_order, CAST(('0x' || substr(sha1(token), 1, 8)) AS BIGINT) % 512 AS idx, sum(1 + ln(n::DOUBLE)) AS x FROM counts GROUP BY 1, 2, 3),
       vec AS (SELECT document_id, unit_order, idx, x / sqrt(sum(x * x) OVER (PARTITION BY document_id, unit_order)) AS w FROM b),
       dots AS (SELECT -1 - q.document_id AS query_id, d.document_id, d.unit_order, round(sum(q.w * d.w), 9) AS score FROM vec q JOIN vec d USING (idx) WHERE q.document_id < 0 AND d.document_id >= 0 GROUP BY 1, 2, 3),
       near AS (SELECT query_id, document_id, unit_order, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, unit_order) AS rank FROM dots {pairs} WHERE score > 0 QUALIFY rank <= 60),
       both_routes AS (SELECT *, 1 AS l FROM lexical UNION ALL SELECT *, 0 FROM near),
       f AS (SELECT query_id, document_id, document_id || ':' || unit_order AS unit_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, count(*) AS rc, min(rank) AS br, min(CASE WHEN l = 1 THEN rank END) AS lexical_rank, min(CASE WHEN l = 0 THEN rank END) AS dense_rank FROM both_routes GROUP BY 1, 2, 3),
       base AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rc DESC, br, document_id, unit_id) AS rank, coalesce(lexical_rank <= 1, false) OR coalesce(dense_rank <= 4, false) AS prot FROM f),
       fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prot DESC, rank) <= 20 AS final FROM base)
       SELECT query_id, unit_id, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(dense_rank, 0) AS dense_rank, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank) AS final_rank,
         CASE WHEN prot AND rank > 20 THEN 'promoted' WHEN NOT final AND rank <= 20 THEN 'displaced' ELSE 'kept' END AS trace FROM fin"""


def unit_frontier(spark, sf, lexical, units, scope=None):
    from clausework.operators import dense as D, fusion as X

    asked = D.hash_vectors(tables.queries(spark, sf), ["query_id"], "question")
    if unique_documents(spark, sf):
        near = D.hash_knn_parts(asked, D.hash_parts(units, "search_text"), 60, 0.0)
    else:  # rows of one unit are counted together
        near = D.hash_knn(asked, D.hash_vectors(units, ["document_id", "unit_order"], "search_text"), ["document_id", "unit_order"], 60, 0.0, scope)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return X.hybrid_frontier(lexical, near).select("query_id", "unit_id", zero("lexical_rank"), zero("dense_rank"), "final_rank", "trace")


def unique_documents(spark, sf):
    return D.repeated_ids(tables.load(spark, sf, "documents"), "doc_id") is None


@query("scoped_frontier", f"WITH {SCOPE_SQL}, {frontier_sql('SEMI JOIN scope USING (query_id, document_id, unit_order)')}")
def scoped_frontier(spark, sf):
    """Both routes see only units of the query's scope: the documents of one source."""
    sources = tables.queries(spark, sf).select("query_id", F.concat(F.lit("src"), F.char_length("question") % 20).alias("source"))
    if unique_documents(spark, sf):  # the scope comes with the document's row, no pair of a query and a document is made
        scope, of_source = None, sources.groupBy("source").agg(F.collect_set("query_id").alias("scope"))
        units = tables.retrieval_units(spark, sf, of_source)
    else:
        docs = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "source")
        scope, units = sources.join(docs, "source").select("query_id", "document_id"), tables.retrieval_units(spark, sf)
    run = L.Lexical(tables.queries(spark, sf), units)
    return unit_frontier(spark, sf, L.top(run.scoped_scores(scope, 50), 50), units, scope)


ASKED_SQL = """asked AS (SELECT query_id, list(token ORDER BY token_no) AS terms, [list(token ORDER BY token_no) FILTER (WHERE token_no <= 3), list(token ORDER BY token_no) FILTER (WHERE token_no BETWEEN 4 AND 6)] AS groups,
         CASE query_id % 4 WHEN 0 THEN 80 WHEN 1 THEN 60 WHEN 2 THEN 30 ELSE 40 END AS recall FROM tokens GROUP BY 1
       UNION ALL SELECT query_id + 10000, [substr(max(term), 2, 5)], [], 40 FROM terms GROUP BY 1)"""


def full_text_score(name: str, source: str, most: str) -> str:
    return f"""{name}_p AS (SELECT DISTINCT query_id, need, grp, document_id, unit_order, w.term, greatest(ln((n_units - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean)) AS part
         FROM {source} w JOIN ix USING (term) JOIN dfs USING (term) JOIN dls USING (document_id, unit_order), whole),
       {name}_s AS (SELECT query_id, document_id, unit_order, round(sum(part), 9) AS score FROM {name}_p GROUP BY query_id, need, document_id, unit_order HAVING count(DISTINCT grp) = need),
       {name} AS (SELECT query_id, document_id, unit_order, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, unit_order) AS place FROM {name}_s) r JOIN asked USING (query_id) WHERE place <= {most})"""


@query(
    "fts_strict",
    f"""WITH {UNITS}, {TERMS}, {ASKED_SQL},
       tok AS (SELECT document_id, unit_order, unnest(regexp_extract_all(document_text || ' ' || heading_text || ' ' || search_text, '[a-z0-9]+')) AS term FROM units), ix AS (SELECT term, document_id, unit_order, count(*) AS tf FROM tok WHERE length(term) >= 2 GROUP BY 1, 2, 3),
       dls AS (SELECT document_id, unit_order, sum(tf)::DOUBLE AS dl FROM ix GROUP BY 1, 2), whole AS (SELECT count(*) AS n_units, avg(dl) AS mean FROM dls), dfs AS (SELECT term, count(*) AS df FROM ix GROUP BY 1),
       anyw AS (SELECT DISTINCT query_id, term, 0 AS grp, 1 AS need FROM (SELECT query_id, unnest(list_filter(terms, lambda t: NOT regexp_matches(t, '^[0-9ivxIVXⅠⅡⅢ]+$'))[1:16]) AS term FROM asked) a),
       grpw AS (SELECT DISTINCT query_id, term, grp, need FROM (SELECT query_id, unnest(groups[g]) AS term, g AS grp, len(groups) AS need FROM asked, range(1, 3) r(g) WHERE len(groups) >= g) g),
       wanted AS (SELECT * FROM grpw UNION ALL SELECT * FROM anyw WHERE query_id IN (SELECT query_id FROM asked WHERE len(groups) = 0)),
       {full_text_score('one', 'wanted', 'least(recall, greatest(20, recall // 2))')}, {full_text_score('two', 'anyw', 'recall')},
       found AS (SELECT query_id, document_id, unit_order, min((tier, place)) AS spot FROM (SELECT *, 1 AS tier FROM one UNION ALL SELECT *, 2 FROM two) t GROUP BY 1, 2, 3),
       short AS (SELECT query_id, terms, recall FROM asked WHERE (SELECT count(*) FROM found f WHERE f.query_id = asked.query_id) < recall),
       inside AS (SELECT DISTINCT query_id, recall, document_id, unit_order, length(search_text) AS size FROM (SELECT query_id, recall, unnest(terms[1:10]) AS p FROM short) s JOIN units ON contains(search_text || chr(10) || document_text || chr(10) || heading_text, p)),
       three AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY size, document_id, unit_order) AS place FROM inside) i ANTI JOIN found USING (query_id, document_id, unit_order) WHERE place <= recall),
       alls AS (SELECT query_id, document_id, unit_order, spot[1] AS tier, spot[2] AS place FROM found UNION ALL SELECT query_id, document_id, unit_order, 3, place FROM three)
       SELECT query_id, document_id, unit_order, tier::BIGINT AS tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, place) AS rank FROM alls) r JOIN asked USING (query_id) WHERE rank <= recall""",
)
def fts_strict(spark, sf):
    """Rule groups first, then any term, then substrings; limits by kind of question. A second query per item asks for a fragment of a word."""
    terms = L.query_terms(tables.queries(spark, sf))
    ordered = lambda cond: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("token_no", "token")))), lambda t: t["token"])
    by_query = L.query_tokens(terms).groupBy("query_id").agg(ordered(F.lit(True)).alias("terms"), F.array(ordered(F.col("token_no") <= 3), ordered(F.col("token_no").between(4, 6))).alias("groups"))
    way = F.col("query_id") % 4
    recall = L.recall_limit(F.when(way == 0, "comparison").otherwise("answer"), F.when(way == 1, "service_materials").otherwise("other"), way == 2, F.lit(5))
    fragments = terms.groupBy("query_id").agg(F.array(F.substring(F.max("term"), 2, 5)).alias("terms")).select(F.col("query_id") + 10000, "terms", F.array().cast("array<array<string>>").alias("groups"), F.lit(40).alias("recall"))
    asked = by_query.select("query_id", "terms", "groups", recall.alias("recall")).union(fragments)
    units = tables.retrieval_units(spark, sf)
    fields = units.select(*L.UNIT, F.col("search_text").alias("text"), F.col("document_text").alias("title"), F.col("heading_text").alias("number"))
    return L.full_text(asked, L.postings(units.repartition(*L.UNIT)), fields)  # dealt out by unit once: counting needs no further shuffle


@query("candidate_frontier", f"WITH {TWO_STAGE.replace('score, matched_terms, ' + RANK, RANK)}, {frontier_sql('')}")
def candidate_frontier(spark, sf):
    """Two-stage lexical route and dense route over all units, fused with protected heads."""
    units = tables.retrieval_units(spark, sf)
    return unit_frontier(spark, sf, L.Lexical(tables.queries(spark, sf), units).two_stage(), units)
