"""Joins over corpus, catalog, graph and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausework import tables
from clausework.functions import ids, similarity, text as T
from clausework.operators import governance as G, joins as J
from clausework.plans.filter_queries import GOVERNED_SQL, USER_TURNS, user_turns
from clausework.plans.oracle import DOCS, LINES, norm
from clausework.plans.registry import query


@query("chunk_document_join", f"WITH {DOCS}, {LINES} SELECT l.document_id, unit_order, corpus, title FROM lines l JOIN docs d ON l.document_id = d.document_id WHERE {GOVERNED_SQL}")
def chunk_document_join(spark, sf):
    docs = tables.documents(spark, sf).where(G.governed()).select("document_id", "corpus", "title")
    return tables.line_units(spark, sf).select("document_id", "unit_order").join(docs, "document_id")


@query(
    "left_join_feedback_user",
    """SELECT c_custkey, c_name, count(o_orderkey) AS feedback, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS helpful, coalesce(CAST(max(o_orderdate) AS VARCHAR), '') AS last_seen
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def left_join_feedback_user(spark, sf):
    users = tables.load(spark, sf, "customer").select("c_custkey", "c_name")
    given = tables.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("feedback"), F.count_if(F.col("o_orderstatus") == "F").alias("helpful"), F.max("o_orderdate").cast("string").alias("last_seen")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return users.join(given, "c_custkey", "left").select("c_custkey", "c_name", zero("feedback"), zero("helpful"), F.coalesce("last_seen", F.lit("")).alias("last_seen"))


@query("unembedded_chunks", "SELECT doc_id AS document_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id AND e.label < 7)")
def unembedded_chunks(spark, sf):
    done = tables.load(spark, sf, "embeddings").where("label < 7").select(F.col("vec_id").alias("doc_id"))
    return tables.load(spark, sf, "documents").select("doc_id").join(done, "doc_id", "left_anti").select(F.col("doc_id").alias("document_id"))


EDGES_SQL = """edges AS (SELECT 'customer:' || c_custkey AS source_id, 'nation:' || c_nationkey AS target_id, 'LIVES_IN' AS relation FROM customer
   UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'BASED_IN' FROM supplier
   UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' FROM nation),
  nodes AS (SELECT 'nation:' || n_nationkey AS entity_id, n_name AS name FROM nation UNION ALL SELECT 'region:' || r_regionkey, r_name FROM region UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier)"""


def edges(spark, sf):
    nid = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    edge = lambda df, s, t, rel: df.select(s.alias("source_id"), t.alias("target_id"), F.lit(rel).alias("relation"))
    c, s, n = (tables.load(spark, sf, x) for x in ("customer", "supplier", "nation"))
    return (
        edge(c, nid("customer", "c_custkey"), nid("nation", "c_nationkey"), "LIVES_IN")
        .unionByName(edge(s, nid("supplier", "s_suppkey"), nid("nation", "s_nationkey"), "BASED_IN"))
        .unionByName(edge(n, nid("nation", "n_nationkey"), nid("region", "n_regionkey"), "PART_OF"))
    )


def nodes(spark, sf):
    nid = lambda kind, c, name: [F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias("entity_id"), F.col(name).alias("name")]
    n, r, s = (tables.load(spark, sf, x) for x in ("nation", "region", "supplier"))
    return n.select(*nid("nation", "n_nationkey", "n_name")).unionByName(r.select(*nid("region", "r_regionkey", "r_name"))).unionByName(s.select(*nid("supplier", "s_suppkey", "s_name")))


@query("graph_or_join", f"WITH {EDGES_SQL} SELECT entity_id, name, relation, source_id, target_id FROM nodes JOIN edges ON source_id = entity_id OR target_id = entity_id")
def graph_or_join(spark, sf):
    return J.or_join(nodes(spark, sf), edges(spark, sf)).select("entity_id", "name", "relation", "source_id", "target_id")


LEXICON_SQL = f"""lex AS (SELECT DISTINCT word AS pattern, 'lex-' || word AS lexicon_id, substr(word, 1, 3) AS canonical, CASE WHEN length(word) >= 14 THEN 'exact' ELSE 'contains' END AS match_type,
      length(word) % 3 AS priority, CASE WHEN length(word) % 2 = 0 THEN 'en' ELSE '' END AS required, CASE WHEN length(word) % 5 = 0 THEN 'ing' ELSE '~' END AS forbidden
    FROM (SELECT unnest(regexp_extract_all({norm('text')}, '[\\p{{L}}\\p{{N}}]+')) AS word FROM benchmark) s),
   asked AS (SELECT query_id, {norm('question')} AS question FROM ({USER_TURNS}) t),
   hit AS (SELECT query_id, lexicon_id, priority, pattern, canonical FROM asked JOIN lex ON contains(question, pattern)
      WHERE (required = '' OR contains(question, required)) AND NOT contains(question, forbidden) AND (match_type <> 'exact' OR question = pattern))"""


def lexicon(spark, sf):
    words = F.explode(F.regexp_extract_all(T.normalize("text"), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))).alias("pattern")
    size = F.char_length("pattern")
    return tables.load(spark, sf, "benchmark").select(words).distinct().select(
        "pattern",
        F.concat(F.lit("lex-"), "pattern").alias("lexicon_id"),
        F.substring("pattern", 1, 3).alias("canonical"),
        F.when(size >= 14, "exact").otherwise("contains").alias("match_type"),
        (size % 3).cast("long").alias("priority"),
        F.when(size % 2 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>")).alias("required"),
        F.when(size % 5 == 0, F.array(F.lit("ing"))).otherwise(F.array(F.lit("~"))).alias("forbidden"),
    )


def lexicon_hits(spark, sf):
    asked = user_turns(spark, sf).withColumn("question", T.normalize("question"))
    return J.lexicon_match(asked, lexicon(spark, sf))


@query("lexicon_match", f"WITH {LEXICON_SQL} SELECT query_id, lexicon_id, priority, pattern FROM hit")
def lexicon_match(spark, sf):
    return lexicon_hits(spark, sf)


@query(
    "lexicon_expand",
    f"""WITH {LEXICON_SQL}, r AS (SELECT query_id, canonical, pattern, row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, lexicon_id) AS pos FROM hit),
      e AS (SELECT query_id, canonical AS term, pos * 2 AS pos FROM r UNION ALL SELECT query_id, pattern, pos * 2 + 1 FROM r), f AS (SELECT query_id, term, min(pos) AS pos FROM e GROUP BY 1, 2)
      SELECT query_id, string_agg(term, '|' ORDER BY pos) AS expansions FROM f GROUP BY 1""",
)
def lexicon_expand(spark, sf):
    hits = lexicon_hits(spark, sf).join(lexicon(spark, sf).select("lexicon_id", "canonical"), "lexicon_id")
    return J.expand_terms(hits, [F.col("canonical"), F.col("pattern")])


REGISTRY_SQL = """d AS (SELECT c_custkey AS document_id, c_custkey % 100 AS number, lower(c_name) AS title, c_acctbal FROM customer),
   r AS (SELECT s_suppkey AS registry_id, s_suppkey % 80 AS number, lower(s_name) AS official_title, s_acctbal < 0 AS is_amendment, s_acctbal FROM supplier),
   m AS (SELECT d.*, registry_id, official_title, s_acctbal, coalesce(round(1 - levenshtein(title, official_title) / CAST(greatest(length(title), length(official_title)) AS DOUBLE), 6), -1) AS similarity, is_amendment FROM d LEFT JOIN r USING (number)),
   best AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY is_amendment NULLS LAST, similarity DESC, registry_id NULLS LAST) AS pick FROM m QUALIFY pick = 1)"""


def registry_best(spark, sf):
    docs = tables.load(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), (F.col("c_custkey") % 100).alias("number"), F.lower("c_name").alias("title"), "c_acctbal")
    reg = tables.load(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("registry_id"), (F.col("s_suppkey") % 80).alias("number"), F.lower("s_name").alias("official_title"), (F.col("s_acctbal") < 0).alias("is_amendment"), "s_acctbal"
    )
    return J.best_registry_match(docs, reg)


@query("registry_match", f"WITH {REGISTRY_SQL} SELECT document_id, coalesce(registry_id, -1) AS registry_id, similarity FROM best")
def registry_match(spark, sf):
    return registry_best(spark, sf).select("document_id", F.coalesce("registry_id", F.lit(-1)).alias("registry_id"), "similarity")


@query(
    "amendment_parent",
    """WITH t AS (SELECT p_partkey, p_size > 40 AS amends, CASE WHEN p_size > 40 THEN p_name || ' 第' || p_size || '号修改单' ELSE p_name END AS title, p_brand FROM part),
       k AS (SELECT *, regexp_replace(regexp_replace(title, ' 第[0-9]+号修改单$', ''), ' ', '', 'g') || p_brand AS key FROM t)
       SELECT a.p_partkey AS amendment_id, coalesce(min(b.p_partkey), -1) AS parent_id FROM k a LEFT JOIN k b ON a.key = b.key AND NOT b.amends WHERE a.amends GROUP BY 1""",
)
def amendment_parent(spark, sf):
    amends = F.col("p_size") > 40
    title = F.when(amends, F.concat("p_name", F.lit(" 第"), F.col("p_size").cast("string"), F.lit("号修改单"))).otherwise(F.col("p_name"))
    docs = tables.load(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), amends.alias("amends"), title.alias("title"), F.col("p_brand").alias("number"))
    return J.amendment_parents(docs)


@query(
    "deleted_clause_anti",
    """WITH e AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48)
       SELECT l_suppkey, l_linenumber, count(*) AS candidates, CASE WHEN (l_suppkey, l_linenumber) IN (SELECT (l_suppkey, l_linenumber) FROM e) THEN 'deleted' ELSE 'kept' END AS effect FROM lineitem GROUP BY 1, 2""",
)
def deleted_clause_anti(spark, sf):
    line = tables.load(spark, sf, "lineitem")
    effects = line.where("l_returnflag = 'R' AND l_quantity >= 48").select("l_suppkey", "l_linenumber").distinct()
    kept, gone = J.apply_deletions(line.select("l_suppkey", "l_linenumber"), effects, ["l_suppkey", "l_linenumber"])
    count = lambda df, name: df.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("candidates")).withColumn("effect", F.lit(name))
    return count(kept, "kept").unionByName(count(gone, "deleted"))


DECISIONS = [("F", "1-URGENT", "approve"), ("F", "2-HIGH", "approve"), ("F", "5-LOW", "review"), ("O", "1-URGENT", "review"), ("O", "3-MEDIUM", "reject"), ("O", "5-LOW", "reject")]


@query(
    "decision_table_join",
    f"""WITH t AS (SELECT * FROM (VALUES {', '.join(str(d) for d in DECISIONS)}) v(s, p, outcome)),
       f AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS s, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS p FROM orders),
       j AS (SELECT f.o_orderkey, t.outcome FROM f LEFT JOIN t ON (f.s IS NULL OR f.s = t.s) AND (f.p IS NULL OR f.p = t.p))
       SELECT o_orderkey, count(outcome) AS rows, coalesce(string_agg(DISTINCT outcome, '|' ORDER BY outcome), '') AS outcomes, count(outcome) = 0 AS unmapped FROM j GROUP BY 1""",
)
def decision_table_join(spark, sf):
    known = lambda c, unknown: F.when(F.col(c) != unknown, F.col(c))
    facets = tables.load(spark, sf, "orders").select(F.col("o_orderkey").alias("facet_id"), known("o_orderstatus", "P").alias("s"), known("o_orderpriority", "4-NOT SPECIFIED").alias("p"))
    table = spark.createDataFrame(DECISIONS, "s string, p string, outcome string")
    return J.decision_join(facets, table, ["s", "p"]).groupBy(F.col("facet_id").alias("o_orderkey")).agg(
        F.count("outcome").alias("rows"), F.array_join(F.sort_array(F.collect_set("outcome")), "|").alias("outcomes"), F.min("unmapped").alias("unmapped")
    )


GOLD_SQL = f"""{LINES}, gold AS (SELECT item_id, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS group_id, unnest(ls) AS part FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark) s),
   mapped AS (SELECT item_id, group_id, document_id, unit_order FROM gold LEFT JOIN lines ON trim(text) = trim(part))"""


def gold_groups(spark, sf):
    gold = tables.load(spark, sf, "benchmark").select("item_id", F.posexplode(T.lines("text")).alias("pos", "part")).select("item_id", (F.col("pos") + 1).cast("long").alias("group_id"), F.trim("part").alias("part"))
    leaves = tables.line_units(spark, sf).select("document_id", "unit_order", F.trim("text").alias("part"))
    return J.gold_join(gold, leaves, "part")


@query("gold_join", f"WITH {GOLD_SQL} SELECT item_id, group_id, count(document_id) AS leaves, count(DISTINCT document_id) AS documents, count(document_id) = 0 AS unresolved FROM mapped GROUP BY 1, 2")
def gold_join(spark, sf):
    return gold_groups(spark, sf).groupBy("item_id", "group_id").agg(
        F.count("document_id").alias("leaves"), F.count_distinct("document_id").alias("documents"), (F.count("document_id") == 0).alias("unresolved")
    )


@query(
    "set_compare",
    """WITH a AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 40 AS item FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_suppkey AS k, l_partkey % 40 AS item FROM lineitem WHERE l_returnflag = 'A'),
       f AS (SELECT coalesce(a.k, b.k) AS k, lpad(coalesce(a.item, b.item)::VARCHAR, 2, '0') AS item, a.item IS NOT NULL AS l, b.item IS NOT NULL AS r FROM a FULL JOIN b ON a.k = b.k AND a.item = b.item)
       SELECT k AS l_suppkey, item, CASE WHEN l AND r THEN 'both' WHEN l THEN 'left_only' ELSE 'right_only' END AS side FROM f""",
)
def set_compare(spark, sf):
    line = tables.load(spark, sf, "lineitem").select("l_suppkey", F.lpad((F.col("l_partkey") % 40).cast("string"), 2, "0").alias("item"), "l_returnflag")
    return J.set_compare(line.where("l_returnflag = 'R'"), line.where("l_returnflag = 'A'"), "l_suppkey", "item")


RANGES_SQL = "rg AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) - 1 AS e FROM lineitem)"


def ranges(spark, sf):
    return tables.load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long") - 1).alias("end")
    ).distinct()


@query(
    "interval_coverage",
    f"""WITH {RANGES_SQL}, w AS (SELECT *, max(e) OVER (PARTITION BY source ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rg)
       SELECT source, s AS start, e AS "end", CAST(CASE WHEN reach IS NULL THEN 0 ELSE greatest(0, least(e, reach) - s + 1) END AS BIGINT) AS overlap, CAST(greatest(0, coalesce(s - reach - 1, 0)) AS BIGINT) AS gap FROM w""",
)
def interval_coverage(spark, sf):
    return J.interval_gaps(ranges(spark, sf), "source", 256)


@query(
    "page_owner",
    """WITH p AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS page FROM lineitem), r AS (SELECT l_suppkey AS source, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) - 1 AS e,
         CASE l_returnflag WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS priority, l_orderkey * 10 + l_linenumber AS range_id FROM lineitem)
       SELECT p.source, page, arg_min(range_id, priority * 1000000000::BIGINT + range_id) AS owner FROM p JOIN r ON p.source = r.source AND page BETWEEN s AND e GROUP BY 1, 2""",
)
def page_owner(spark, sf):
    line = tables.load(spark, sf, "lineitem")
    points = line.select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("page")).distinct()
    priority = F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    rng = line.select(
        F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long") - 1).alias("end"),
        priority.alias("priority"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("range_id"),
    )
    return J.range_owner(points, rng, "source", "page", 64)


@query(
    "boundary_audit",
    f"""WITH {LINES}, pg AS (SELECT document_id, unit_order AS page, CASE WHEN trim(text) = '' THEN 'blank' WHEN length(text) < 100 THEN 'short' ELSE 'body' END AS class, sha256(text) AS fp FROM lines),
       r AS (SELECT document_id, (page + 4) // 5 AS part, min(page) AS s, max(page) AS e FROM pg GROUP BY 1, 2)
       SELECT r.document_id, CAST(part AS BIGINT) AS part, f.class AS first_class, l.class AS last_class, coalesce(p.class, 'outside') AS previous_class, coalesce(n.class, 'outside') AS next_class,
         coalesce(p.fp = f.fp, false) OR coalesce(n.fp = l.fp, false) AS duplicate_edge
       FROM r JOIN pg f ON f.document_id = r.document_id AND f.page = s JOIN pg l ON l.document_id = r.document_id AND l.page = e
       LEFT JOIN pg p ON p.document_id = r.document_id AND p.page = s - 1 LEFT JOIN pg n ON n.document_id = r.document_id AND n.page = e + 1""",
)
def boundary_audit(spark, sf):
    lines = tables.line_units(spark, sf)
    kind = F.when(F.trim("text") == "", "blank").when(F.char_length("text") < 100, "short").otherwise("body")
    pages = lines.select("document_id", F.col("unit_order").alias("page"), kind.alias("class"), ids.sha256("text").alias("fp"))
    parts = pages.groupBy("document_id", F.ceil(F.col("page") / 5).alias("part")).agg(F.min("page").alias("start"), F.max("page").alias("end"))
    return J.boundary_audit(parts, pages, ["document_id", "part"])


@query(
    "anchor_catalog_check",
    """WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c AS (SELECT p_partkey, p_size > 5 AS can_answer FROM part WHERE p_retailprice < 940),
       j AS (SELECT l_orderkey, l_partkey, can_answer FROM r LEFT JOIN c ON p_partkey = l_partkey)
       SELECT l_orderkey AS query_id, count(*) AS requested, count(*) FILTER (WHERE can_answer IS NULL) AS missing, count(*) FILTER (WHERE NOT can_answer) AS blocked, count(*) FILTER (WHERE can_answer) AS eligible, count(*) = count(*) FILTER (WHERE can_answer) AS proceed FROM j GROUP BY 1""",
)
def anchor_catalog_check(spark, sf):
    asked = tables.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("number")).distinct()
    catalog = tables.load(spark, sf, "part").where("p_retailprice < 940").select(F.col("p_partkey").alias("number"), (F.col("p_size") > 5).alias("can_answer"))
    return J.anchor_check(asked, catalog)


@query(
    "finding_trace",
    f"""WITH {DOCS}, {LINES}, f AS (SELECT document_id, unit_order, 'oversized' AS finding FROM lines WHERE length(text) > 1000 UNION ALL SELECT document_id, NULL, 'unverified' FROM docs WHERE effective_status = 'unverified')
       SELECT f.document_id, coalesce(f.unit_order, 0) AS unit_order, finding, CAST(coalesce(length(l.text), 0) AS BIGINT) AS unit_chars, corpus, document_type,
         coalesce((SELECT string_agg(p.url, '|' ORDER BY p.url) FROM pages p WHERE p.page_id = f.document_id), '') AS artifacts
       FROM f LEFT JOIN lines l ON l.document_id = f.document_id AND l.unit_order = f.unit_order LEFT JOIN docs d ON d.document_id = f.document_id""",
)
def finding_trace(spark, sf):
    docs, lines = tables.documents(spark, sf), tables.line_units(spark, sf)
    findings = lines.where(F.char_length("text") > 1000).select("document_id", "unit_order", F.lit("oversized").alias("finding")).unionByName(
        docs.where("effective_status = 'unverified'").select("document_id", F.lit(None).cast("long").alias("unit_order"), F.lit("unverified").alias("finding"))
    )
    units = lines.select("document_id", "unit_order", F.char_length("text").cast("long").alias("unit_chars"))
    artifacts = tables.load(spark, sf, "pages").select(F.col("page_id").alias("document_id"), "url")
    return J.finding_trace(findings, units, docs.select("document_id", "corpus", "document_type"), artifacts)


MENTION_SQL = """dict AS (SELECT * FROM (VALUES ('lang', 'the', 'en'), ('lang', 'ung', 'de'), ('lang', 'eau', 'fr'), ('shape', 'tion', 'noun'), ('shape', 'ing', 'verb')) d(slot, pattern, value))"""
MENTIONS = [("lang", "the", "en"), ("lang", "ung", "de"), ("lang", "eau", "fr"), ("shape", "tion", "noun"), ("shape", "ing", "verb")]


@query(
    "mention_slots",
    f"""WITH {LINES}, {MENTION_SQL}, m AS (SELECT document_id, unit_order, slot, value FROM lines JOIN dict ON contains(replace(lower(text), 'not ' || pattern, ''), pattern)),
      s AS (SELECT document_id, unit_order, slot, count(DISTINCT value) AS n, min(value) AS v FROM m GROUP BY 1, 2, 3)
      SELECT l.document_id, l.unit_order, k.slot, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'conflict' ELSE v END AS state
      FROM lines l CROSS JOIN (SELECT DISTINCT slot FROM dict) k LEFT JOIN s ON s.document_id = l.document_id AND s.unit_order = l.unit_order AND s.slot = k.slot""",
)
def mention_slots(spark, sf):
    return J.mention_slots(tables.line_units(spark, sf).withColumn("text", F.lower("text")), MENTIONS, "not ")
