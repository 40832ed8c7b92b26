"""Operational roll-ups, corpus checks, sinks and the batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from clausework import tables
from clausework.functions import ids, text as T
from clausework.operators import corpus as C, dedup, governance as G, usage as U
from clausework.plans.filter_queries import ALLOW_SQL, ALLOWED_SQL, GOVERNED_SQL, decided_orders
from clausework.plans.oracle import DOCS, LINES
from clausework.plans.registry import query


def events(spark, sf):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return tables.load(spark, sf, "events").withColumn("micros", micros).withColumn("epoch", F.floor(micros / 1000000))


@query(
    "usage_summary",
    """WITH e AS (SELECT event_type AS endpoint, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 200 THEN 'slow' ELSE 'ok' END AS status, value, ts FROM events),
      m AS (SELECT 'total' AS metric, '' AS value_, value, ts FROM e UNION ALL SELECT 'today', '', value, ts FROM e WHERE CAST(ts AS DATE) = DATE '2024-01-15' UNION ALL SELECT 'endpoint', endpoint, value, ts FROM e UNION ALL SELECT 'status', status, value, ts FROM e)
      SELECT metric, value_ AS value, count(*) AS calls, round(avg(value), 6) AS mean_latency, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM m GROUP BY 1, 2""",
)
def usage_summary(spark, sf):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 200, "slow").otherwise("ok")
    log = tables.load(spark, sf, "events").select(F.col("event_type").alias("endpoint"), status.alias("status"), F.col("value").alias("latency"), "ts")
    out = U.usage_summary(log, F.to_date("ts") == F.lit("2024-01-15").cast("date"))
    return out.withColumn("last_seen", F.substring("last_seen", 1, 19))


@query("account_summary", "SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type NOT IN ('error', 'view')) AS consumed_calls, CAST(sum(CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS BIGINT) AS units FROM events GROUP BY 1")
def account_summary(spark, sf):
    kind = F.col("event_type")
    units = F.when(kind == "purchase", 3).when(kind == "signup", 2).when(kind == "click", 1).otherwise(0)
    return tables.load(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(~kind.isin("error", "view")).alias("consumed_calls"), F.sum(units).alias("units"))


SETTLED_SQL = """ev AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END AS units, l_linenumber,
      CASE l_returnflag WHEN 'A' THEN 'settled' WHEN 'N' THEN 'reserved' ELSE 'refunded' END AS status FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
   settled AS (SELECT o_orderkey, o_custkey, day, units, arg_max(status, l_linenumber * 10 + CASE status WHEN 'settled' THEN 2 WHEN 'reserved' THEN 1 ELSE 0 END * 1) AS status FROM (SELECT * FROM ev) e GROUP BY 1, 2, 3, 4),
   ledger AS (SELECT o_custkey AS user_id, day, CAST(coalesce(sum(units) FILTER (WHERE status = 'settled'), 0) AS BIGINT) AS used, CAST(coalesce(sum(units) FILTER (WHERE status = 'reserved'), 0) AS BIGINT) AS reserved FROM settled GROUP BY 1, 2)"""


def ledger(spark, sf):
    orders = tables.load(spark, sf, "orders")
    units = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    status = F.when(F.col("l_returnflag") == "A", "settled").when(F.col("l_returnflag") == "N", "reserved").otherwise("refunded")
    rank = F.when(status == "settled", 2).when(status == "reserved", 1).otherwise(0)
    steps = tables.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request_id"), (F.col("l_linenumber") * 10 + rank).alias("seq"), status.alias("status"))
    head = orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"), units.cast("long").alias("units"))
    return U.quota_ledger(U.settle_requests(head.join(steps, "request_id")))


@query("quota_ledger", f"WITH {SETTLED_SQL} SELECT user_id, CAST(day AS VARCHAR) AS day, used, reserved FROM ledger")
def quota_ledger(spark, sf):
    return ledger(spark, sf).withColumn("day", F.col("day").cast("string"))


@query(
    "quota_snapshot",
    f"""WITH {SETTLED_SQL}, last AS (SELECT user_id, arg_max(used, day) AS used, arg_max(reserved, day) AS reserved FROM ledger GROUP BY 1)
      SELECT c_custkey AS user_id, CAST(greatest(0, 4 + CASE WHEN c_acctbal > 0 THEN 2 ELSE 0 END - coalesce(used, 0) - coalesce(reserved, 0)) AS BIGINT) AS remaining FROM customer LEFT JOIN last ON user_id = c_custkey""",
)
def quota_snapshot(spark, sf):
    users = tables.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(4).alias("quota"), F.when(F.col("c_acctbal") > 0, 2).otherwise(0).alias("bonus"))
    return U.quota_snapshot(users, ledger(spark, sf))


FINDINGS_SQL = """fi AS (SELECT document_id, 0::BIGINT AS unit_order, 'warning' AS severity, 'effective_status_unverified' AS finding_type, review_status AS evidence FROM docs WHERE effective_status = 'unverified'
   UNION ALL SELECT document_id, 0, 'warning', 'missing_standard_number', title FROM docs WHERE NOT regexp_matches(title, '[0-9]')
   UNION ALL SELECT document_id, unit_order, 'warning', 'empty_source_page', '' FROM lines WHERE trim(text) = ''
   UNION ALL SELECT document_id, unit_order, 'warning', 'oversized_structural_unit', CAST(length(text) AS VARCHAR) FROM lines WHERE length(text) > 6000
   UNION ALL SELECT vec_id, 0, 'warning', 'low_ocr_confidence', CAST(label AS VARCHAR) FROM embeddings WHERE label < 5),
  findings AS (SELECT *, 'finding-' || substr(sha1(document_id || chr(10) || unit_order || chr(10) || severity || chr(10) || finding_type || chr(10) || evidence), 1, 16) AS finding_id FROM fi)"""


def findings(spark, sf):
    docs, lines = tables.documents(spark, sf), tables.line_units(spark, sf)
    pages = tables.load(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"), "label", (F.col("label") / 6).alias("score"))
    size = F.char_length("text")
    parts = [
        C.finding("effective_status_unverified", "warning", docs.where("effective_status = 'unverified'"), F.col("review_status")),
        C.finding("missing_standard_number", "warning", docs.where(~F.col("title").rlike("[0-9]")), F.col("title")),
        C.finding("empty_source_page", "warning", lines.where(F.trim("text") == ""), F.lit(""), F.col("unit_order")),
        C.finding("oversized_structural_unit", "warning", lines.where(size > 6000), size, F.col("unit_order")),
        C.finding("low_ocr_confidence", "warning", pages.where("score < 0.83"), F.col("label")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("finding_rules", f"WITH {DOCS}, {LINES}, {FINDINGS_SQL} SELECT document_id, unit_order, severity, finding_type, evidence, finding_id FROM findings")
def finding_rules(spark, sf):
    return findings(spark, sf)


@query(
    "governance_counts",
    f"""WITH {DOCS}, {LINES}, {FINDINGS_SQL}, d AS (SELECT corpus, effective_status, review_status, CAST({GOVERNED_SQL} AS VARCHAR) AS can_answer FROM docs)
      SELECT 'corpus' AS dimension, corpus AS value, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'effective_status', effective_status, count(*) FROM d GROUP BY 2
      UNION ALL SELECT 'review_status', review_status, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'can_answer', can_answer, count(*) FROM d GROUP BY 2
      UNION ALL SELECT 'severity', severity, count(*) FROM findings GROUP BY 2 UNION ALL SELECT 'finding_type', finding_type, count(*) FROM findings GROUP BY 2""",
)
def governance_counts(spark, sf):
    docs = tables.documents(spark, sf).withColumn("can_answer", G.governed())
    return C.counts_by(docs, ["corpus", "effective_status", "review_status", "can_answer"]).unionByName(C.counts_by(findings(spark, sf), ["severity", "finding_type"]))


@query(
    "corpus_statistics",
    f"""WITH {LINES}, l AS (SELECT d.lang AS corpus, document_id, length(lines.text) AS n FROM lines JOIN documents d ON d.doc_id = document_id)
      SELECT corpus, count(*) AS units, min(n) AS min_len, round(avg(n), 6) AS avg_len, max(n) AS max_len, count(DISTINCT document_id) AS documents,
       count(*) FILTER (WHERE n < 20) AS band_0, count(*) FILTER (WHERE n >= 20 AND n < 50) AS band_1, count(*) FILTER (WHERE n >= 50 AND n < 150) AS band_2, count(*) FILTER (WHERE n >= 150 AND n < 300) AS band_3,
       count(*) FILTER (WHERE n >= 300 AND n < 600) AS band_4, count(*) FILTER (WHERE n >= 600 AND n < 1200) AS band_5, count(*) FILTER (WHERE n >= 1200) AS band_6 FROM l GROUP BY 1""",
)
def corpus_statistics(spark, sf):
    docs = tables.load(spark, sf, "documents")
    units = docs.select(F.col("lang").alias("corpus"), F.col("doc_id").alias("document_id"), F.explode(T.lines("text")).alias("text"))
    return C.length_statistics(units, "corpus")


@query(
    "validate_corpus",
    f"""WITH {DOCS}, {LINES} SELECT 'empty_text' AS "check", count(*) AS violations FROM lines WHERE trim(text) = '' UNION ALL SELECT 'duplicate_content', count(*) FROM (SELECT text FROM docs GROUP BY 1 HAVING count(*) > 1) s
      UNION ALL SELECT 'length_mismatch', count(*) FROM docs WHERE length(text) <> n_chars UNION ALL SELECT 'orphan_labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT document_id FROM docs)
      UNION ALL SELECT 'bad_eligibility', count(*) FROM docs WHERE review_status = 'approved_for_service' AND effective_status <> 'current' UNION ALL SELECT 'duplicate_order', count(*) FROM (SELECT document_id, unit_order FROM lines GROUP BY 1, 2 HAVING count(*) > 1) s""",
)
def validate_corpus(spark, sf):
    docs, lines = tables.documents(spark, sf), tables.line_units(spark, sf)
    labels = tables.load(spark, sf, "labels").withColumnRenamed("doc_id", "document_id")
    return C.checks(
        ("empty_text", lines.where(F.trim("text") == "")),
        ("duplicate_content", docs.groupBy(ids.sha256("text").alias("h")).count().where("count > 1")),
        ("length_mismatch", docs.where(F.char_length("text") != F.col("n_chars"))),
        ("orphan_labels", labels.join(docs, "document_id", "left_anti")),
        ("bad_eligibility", docs.where("review_status = 'approved_for_service' AND effective_status <> 'current'")),
        ("duplicate_order", lines.groupBy("document_id", "unit_order").count().where("count > 1")),
    )


@query("duplicate_numbers", "SELECT sha256(text) AS number, doc_id AS member, n FROM documents JOIN (SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1) d USING (text)")
def duplicate_numbers(spark, sf):
    return C.duplicate_groups(tables.load(spark, sf, "documents").select(ids.sha256("text").alias("number"), F.col("doc_id").alias("member")), "number")


@query(
    "dependent_counts",
    f"""WITH {LINES} SELECT d.doc_id, (SELECT count(*) FROM lines WHERE document_id = d.doc_id) AS units, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS labels,
       (SELECT count(*) FROM embeddings WHERE vec_id = d.doc_id) AS vectors, (SELECT count(*) FROM pages WHERE page_id = d.doc_id) AS pages FROM documents d""",
)
def dependent_counts(spark, sf):
    keyed = lambda name, c: tables.load(spark, sf, name).select(F.col(c).alias("doc_id"))
    units = tables.line_units(spark, sf).select(F.col("document_id").alias("doc_id"))
    return C.dependent_counts(tables.load(spark, sf, "documents"), "doc_id", {"units": units, "labels": keyed("labels", "doc_id"), "vectors": keyed("embeddings", "vec_id"), "pages": keyed("pages", "page_id")})


@query("exclusive_vs_shared", f"WITH {ALLOW_SQL} SELECT l_suppkey AS file_id, bool_and(NOT {ALLOWED_SQL}) AS exclusive, count(*) AS owners FROM lineitem JOIN decided ON o_orderkey = l_orderkey GROUP BY 1")
def exclusive_vs_shared(spark, sf):
    files = tables.load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("file_id"))
    return files.join(decided_orders(spark, sf).select("o_orderkey", "v.allowed"), "o_orderkey").groupBy("file_id").agg(F.min(~F.col("allowed")).alias("exclusive"), F.count("*").alias("owners"))


@query(
    "remediation_queue",
    f"""WITH {DOCS}, {LINES}, {FINDINGS_SQL}, q AS (SELECT finding_type, coalesce(effective_status, 'unknown') AS status, CASE WHEN finding_type IN ('empty_source_page', 'low_ocr_confidence') AND effective_status = 'current' THEN 'P0'
        WHEN effective_status = 'current' THEN 'P1' WHEN finding_type = 'effective_status_unverified' THEN 'P2' ELSE 'P3' END AS priority FROM findings f LEFT JOIN docs d ON d.document_id = f.document_id)
      SELECT priority, finding_type, status, count(*) AS n FROM q GROUP BY 1, 2, 3""",
)
def remediation_queue(spark, sf):
    status = tables.documents(spark, sf).select("document_id", F.col("effective_status").alias("status"))
    joined = findings(spark, sf).join(status, "document_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    current = F.col("status") == "current"
    priority = (
        F.when(F.col("finding_type").isin("empty_source_page", "low_ocr_confidence") & current, "P0").when(current, "P1")
        .when(F.col("finding_type") == "effective_status_unverified", "P2").otherwise("P3")
    )
    return joined.groupBy(priority.alias("priority"), "finding_type", "status").agg(F.count("*").alias("n"))


@query("knowledge_snapshot", f"WITH {DOCS} SELECT corpus, 'snap-' || substr(sha256(count(*) || ':' || CAST(sum(n_chars) AS BIGINT) || ':' || max(document_id)), 1, 16) AS snapshot_id, count(*) AS documents FROM docs GROUP BY 1")
def knowledge_snapshot(spark, sf):
    parts = F.concat_ws(":", F.count("*"), F.sum("n_chars"), F.max("document_id"))
    return tables.documents(spark, sf).groupBy("corpus").agg(F.concat(F.lit("snap-"), F.substring(F.sha2(parts, 256), 1, 16)).alias("snapshot_id"), F.count("*").alias("documents"))


@query(
    "feedback_lanes",
    """SELECT CASE WHEN event_type = 'error' THEN 'engineering' WHEN value < 5 THEN 'content_review' WHEN event_type = 'view' THEN 'none' ELSE 'archive' END AS lane, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""",
)
def feedback_lanes(spark, sf):
    lane = F.when(F.col("event_type") == "error", "engineering").when(F.col("value") < 5, "content_review").when(F.col("event_type") == "view", "none").otherwise("archive")
    return tables.load(spark, sf, "events").groupBy(lane.alias("lane")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("lexicon_summary", "SELECT p_type AS status, count(*) AS entries, count(*) FILTER (WHERE p_size > 25) AS candidates, count(*) FILTER (WHERE p_size > 40 AND p_retailprice > 1000) AS high_risk_pending FROM part GROUP BY 1")
def lexicon_summary(spark, sf):
    big = F.col("p_size")
    return tables.load(spark, sf, "part").groupBy(F.col("p_type").alias("status")).agg(F.count("*").alias("entries"), F.count_if(big > 25).alias("candidates"), F.count_if((big > 40) & (F.col("p_retailprice") > 1000)).alias("high_risk_pending"))


@query(
    "llm_usage_rollup",
    """SELECT event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS attempt, count(*) AS calls, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS hit_tokens,
       round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::DOUBLE / nullif(sum(CAST(value AS BIGINT)), 0)::DOUBLE, 6) AS cache_hit_ratio, round(avg(value), 6) AS mean_latency, count(*) FILTER (WHERE value > 100) AS errors FROM events GROUP BY 1, 2""",
)
def llm_usage_rollup(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    ledger_rows = tables.load(spark, sf, "events").select(
        F.col("event_type").alias("stage"), (k % 3).alias("attempt"), F.rint("value").cast("long").alias("prompt_tokens"), k.alias("hit_tokens"), F.col("value").alias("latency_ms"), (F.col("value") <= 100).alias("success")
    )
    return U.llm_usage(ledger_rows)


@query(
    "analysis_quality_summary",
    "SELECT role AS stage, count(*) AS cases, count(*) FILTER (WHERE length(text) > 200) AS passed, count(*) FILTER (WHERE contains(lower(text), 'tion')) AS matched, round(count(*) FILTER (WHERE length(text) > 200) / CAST(count(*) AS DOUBLE), 6) AS pass_rate FROM conversations GROUP BY 1",
)
def analysis_quality_summary(spark, sf):
    ok = F.char_length("text") > 200
    return tables.load(spark, sf, "conversations").groupBy(F.col("role").alias("stage")).agg(
        F.count("*").alias("cases"), F.count_if(ok).alias("passed"), F.count_if(F.contains(F.lower("text"), F.lit("tion"))).alias("matched"), F.round(F.count_if(ok) / F.count("*"), 6).alias("pass_rate")
    )


@query("latest_per_key", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role = 'user') s WHERE rn <= 2")
def latest_per_key(spark, sf):
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    user = tables.load(spark, sf, "conversations").where("role = 'user'")
    return user.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("conv_id", "turn", "text")


@query(
    "send_throttle",
    """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), w AS (SELECT event_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS gap, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM e)
      SELECT event_id, CASE WHEN gap <= 86400 THEN gap ELSE -1 END AS since_previous, recent, (gap IS NULL OR gap > 86400 OR gap >= 3600) AND recent <= 3 AS allowed FROM w""",
)
def send_throttle(spark, sf):
    return U.send_throttle(events(spark, sf).select("event_id", "user_id", "epoch"), 3600, 3)


@query("catalog_page", f"WITH {DOCS} SELECT document_id, title, position, (SELECT count(*) FROM docs) AS total FROM (SELECT *, row_number() OVER (ORDER BY corpus, title, document_id) AS position FROM docs) s WHERE position BETWEEN 21 AND 40")
def catalog_page(spark, sf):
    return C.catalog_page(tables.documents(spark, sf).select("document_id", "title", "corpus"), ["corpus", "title", "document_id"], 2, 20).drop("corpus")


@query(
    "corpus_listing",
    f"""WITH {DOCS}, h AS (SELECT *, CASE effective_status WHEN 'current' THEN 0 WHEN 'unverified' THEN 1 ELSE 2 END AS s FROM docs WHERE contains(lower(title), 'tion') OR document_type = 'src3')
      SELECT document_id, title, effective_status, row_number() OVER (ORDER BY s, title, document_id) AS position, (SELECT count(*) FROM h) AS total, (SELECT count(*) FROM h) > 50 AS truncated FROM h QUALIFY position <= 50""",
)
def corpus_listing(spark, sf):
    rank = F.when(F.col("effective_status") == "current", 0).when(F.col("effective_status") == "unverified", 1).otherwise(2)
    hits = tables.documents(spark, sf).where(F.contains(F.lower("title"), F.lit("tion")) | (F.col("document_type") == "src3")).select("document_id", "title", "effective_status", rank.alias("s"))
    return C.catalog_page(hits, ["s", "title", "document_id"], 1, 50).withColumn("truncated", F.col("total") > 50).drop("s")


@query(
    "status_lookup",
    """WITH q AS (SELECT s_suppkey AS query_id, s_suppkey % 300 AS number, s_nationkey FROM supplier), c AS (SELECT c_custkey AS document_id, c_custkey AS number, c_nationkey, c_mktsegment FROM customer),
       n AS (SELECT query_id, document_id, c_mktsegment, 'number' AS how FROM q JOIN c USING (number) WHERE number <> 0), t AS (SELECT query_id, document_id, c_mktsegment, 'title' FROM q JOIN c ON c_nationkey = s_nationkey WHERE query_id NOT IN (SELECT query_id FROM n))
       SELECT query_id, document_id, how, CASE c_mktsegment WHEN 'BUILDING' THEN 'current' WHEN 'MACHINERY' THEN 'repealed' ELSE 'unverified' END AS status,
         row_number() OVER (PARTITION BY query_id ORDER BY document_id) AS rank FROM (SELECT * FROM n UNION ALL SELECT * FROM t) u QUALIFY rank <= 20""",
)
def status_lookup(spark, sf):
    from clausework.operators import ranking

    q = tables.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.nullif(F.col("s_suppkey") % 300, F.lit(0)).alias("number"), F.col("s_nationkey").alias("title"))
    status = F.when(F.col("c_mktsegment") == "BUILDING", "current").when(F.col("c_mktsegment") == "MACHINERY", "repealed").otherwise("unverified")
    catalog = tables.load(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"), F.col("c_custkey").alias("number"), F.col("c_nationkey").alias("title"), status.alias("status"))
    return ranking.status_lookup(q, catalog, 20)


@query("prioritize", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_linenumber, l_partkey, l_suppkey) AS position FROM lineitem")
def prioritize(spark, sf):
    from clausework.operators import ranking

    rows = tables.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("is_anchor"))
    return ranking.prioritize(rows, "l_orderkey", "is_anchor", ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "position")


@query("type_ordered_rows", "SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT), p_partkey) AS position FROM part")
def type_ordered_rows(spark, sf):
    from clausework.operators import ranking

    rows = tables.load(spark, sf, "part").select("p_type", "p_partkey", F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("number"))
    return ranking.positions(rows, ["p_type"], ["number", "p_partkey"]).select("p_partkey", "position")


@query("union_inputs", "SELECT doc_id AS source_id, 'document' AS kind, lang AS corpus, n_chars AS chars, '' AS url FROM documents UNION ALL SELECT page_id, 'page', '', length(html), url FROM pages")
def union_inputs(spark, sf):
    docs = tables.load(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), F.lit("document").alias("kind"), F.col("lang").alias("corpus"), F.col("n_chars").alias("chars"))
    web = tables.load(spark, sf, "pages").select(F.col("page_id").alias("source_id"), F.lit("page").alias("kind"), F.char_length("html").cast("long").alias("chars"), "url")
    return docs.unionByName(web, allowMissingColumns=True).fillna("", ["corpus", "url"])


@query("except_findings", f"WITH {DOCS}, {LINES}, {FINDINGS_SQL} SELECT document_id, 'synthetic_review' AS finding_type FROM docs WHERE document_id NOT IN (SELECT document_id FROM findings)")
def except_findings(spark, sf):
    docs = tables.documents(spark, sf).select("document_id")
    return docs.join(findings(spark, sf).select("document_id"), "document_id", "left_anti").withColumn("finding_type", F.lit("synthetic_review"))


@query(
    "sink_upsert",
    """WITH a AS (SELECT c_custkey AS k, 1::BIGINT AS version, c_name AS payload FROM customer UNION ALL SELECT o_custkey, 2 + o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F')
       SELECT k, max(version) AS version, arg_max(payload, version) AS payload FROM a GROUP BY 1""",
)
def sink_upsert(spark, sf):
    base = tables.load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).cast("long").alias("version"), F.col("c_name").alias("payload"))
    delta = tables.load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") + 2).alias("version"), F.col("o_orderpriority").alias("payload"))
    return C.upsert(base, delta, ["k"], "version")


@query(
    "sink_cascade_delete",
    f"""WITH {LINES}, gone AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'documents' AS name, count(*) AS rows FROM documents WHERE doc_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'units', count(*) FROM lines WHERE document_id NOT IN (SELECT * FROM gone)
      UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT * FROM gone)""",
)
def sink_cascade_delete(spark, sf):
    gone = tables.load(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    keyed = lambda name, c: tables.load(spark, sf, name).select(F.col(c).alias("document_id"))
    kept = C.cascade_delete({"documents": keyed("documents", "doc_id"), "units": tables.line_units(spark, sf), "labels": keyed("labels", "doc_id"), "vectors": keyed("embeddings", "vec_id")}, gone, "document_id")
    out = None
    for name, df in kept.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("sink_run_manifest", "SELECT lang AS corpus, source AS document_type, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS units FROM documents GROUP BY 1, 2")
def sink_run_manifest(spark, sf):
    return tables.load(spark, sf, "documents").groupBy(F.col("lang").alias("corpus"), F.col("source").alias("document_type")).agg(
        F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.sum(F.size(T.lines("text"))).cast("long").alias("units")
    )


@query(
    "rate_limit_windows",
    """SELECT user_id, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS calls, least(count(*), 2) AS allowed, greatest(count(*) - 2, 0) AS rejected, CAST(3600 - max(floor(epoch(ts))) % 3600 AS BIGINT) AS retry_after FROM events GROUP BY 1, 2""",
)
def rate_limit_windows(spark, sf):
    from clausework.streaming import jobs

    stamped = tables.load(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.rate_limit(stamped, "user_id", "1 hour", 2)


@query(
    "ttl_dedup",
    """WITH RECURSIVE e AS (SELECT DISTINCT event_type AS k, epoch_us(ts) AS t FROM events), r AS (SELECT k, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT e.k, min(e.t) FROM r JOIN e ON e.k = r.k AND e.t >= r.t + 86400000000 GROUP BY 1) SELECT k, t AS seen_at FROM r""",
)
def ttl_dedup(spark, sf):
    return dedup.ttl_first_sightings(events(spark, sf).select("event_type", F.col("micros").alias("at")), "event_type", 86400000000).withColumnRenamed("at", "seen_at")


@query("hash_sampling", "SELECT event_id FROM events WHERE CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496::DOUBLE < 0.1::DOUBLE")
def hash_sampling(spark, sf):
    return tables.load(spark, sf, "events").where(ids.hash_fraction(F.col("event_id").cast("string")) < 0.1).select("event_id")


@query(
    "stale_release",
    """WITH r AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t, CASE WHEN value > 100 THEN 'deep' ELSE 'quick' END AS mode, CASE WHEN value > 100 THEN 3 ELSE 1 END AS units FROM events WHERE event_type = 'click'),
       s AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 + user_id AS request_id, min(epoch_us(ts) // 1000000) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1)
       SELECT event_id AS request_id, CASE WHEN mode <> 'deep' AND (s.t IS NULL OR s.t > r.t + 600) THEN 'error' ELSE 'open' END AS status, CAST(CASE WHEN mode <> 'deep' AND (s.t IS NULL OR s.t > r.t + 600) THEN units ELSE 0 END AS BIGINT) AS refunded FROM r LEFT JOIN s ON s.request_id = event_id""",
)
def stale_release(spark, sf):
    e = events(spark, sf)
    deep = F.col("value") > 100
    req = e.where("event_type = 'click'").select(F.col("event_id").alias("request_id"), F.col("epoch").alias("opened_at"), F.when(deep, "deep").otherwise("quick").alias("mode"), F.when(deep, 3).otherwise(1).alias("units"))
    done = e.where("event_type = 'purchase'").select((F.get_json_object("props", "$.k").cast("long") * 100 + F.col("user_id")).alias("request_id"), F.col("epoch").alias("settled_at"))
    return U.stale_release(req, done, 10)


@query("requeue_unfinished", "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS t FROM events GROUP BY 1) SELECT user_id AS task_id, status, row_number() OVER (ORDER BY t) AS position FROM l WHERE status NOT IN ('purchase', 'error')")
def requeue_unfinished(spark, sf):
    from clausework.operators import ranking

    last = U.latest_status(tables.load(spark, sf, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), "event_id"), "task_id", "event_id")
    return ranking.positions(last.where(~F.col("status").isin("purchase", "error")), [], ["at"]).select("task_id", "status", "position")


@query("usage_stream", "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, event_type AS endpoint, count(*) AS calls, round(avg(value), 6) AS mean_latency FROM events GROUP BY 1, 2")
def usage_stream(spark, sf):
    from clausework.streaming import jobs

    stamped = tables.load(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("endpoint"), F.col("value").alias("latency"))
    return jobs.usage_by_window(stamped, "1 hour").withColumn("mean_latency", F.round(F.col("latency_sum") / F.col("calls"), 6)).drop("latency_sum")


@query(
    "gap_task_queue",
    f"""WITH {LINES}, q AS (SELECT item_id, trim(unnest(string_split(text, chr(10)))) AS part FROM benchmark), have AS (SELECT DISTINCT trim(text) AS part FROM lines),
       c AS (SELECT item_id, count(*) AS lines_asked, count(*) FILTER (WHERE h.part IS NULL) AS missing FROM q LEFT JOIN have h USING (part) WHERE part <> '' GROUP BY 1)
     SELECT item_id AS query_id, 'gap-' || substr(sha1(CAST(item_id AS VARCHAR)), 1, 16) AS task_id, 'queued' AS status, lines_asked, missing FROM c WHERE missing > 0""",
)
def gap_task_queue(spark, sf):
    """A question is queued if any of its lines has no evidence; the task says how many of how many."""
    asked = tables.queries(spark, sf).select("query_id", F.explode(T.lines("question")).alias("part")).select("query_id", F.trim("part").alias("part")).where("part <> ''")
    found = tables.line_units(spark, sf).select(F.trim("text").alias("part")).where("part <> ''").distinct().withColumn("found", F.lit(True))
    counted = asked.join(found, "part", "left").groupBy("query_id").agg(F.count("*").alias("lines_asked"), F.count_if(F.col("found").isNull()).alias("missing"))
    return counted.where("missing > 0").select("query_id", ids.stable_id("gap", "query_id").alias("task_id"), F.lit("queued").alias("status"), "lines_asked", "missing")


@query(
    "incremental_embed",
    """WITH src AS (SELECT doc_id AS doc, text FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)), counts AS (SELECT doc, token, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z0-9]+(?:/[A-Z0-9]+)?(?:[-.][A-Z0-9]+)*')) AS token FROM src) s GROUP BY 1, 2),
      b AS (SELECT doc, CAST(('0x' || substr(sha1(token), 1, 8)) AS BIGINT) % 512 AS idx, sum(1 + ln(n::DOUBLE)) AS x FROM counts GROUP BY 1, 2)
      SELECT doc AS document_id, count(*) AS buckets, round(sum(x), 6) AS mass FROM b GROUP BY 1""",
)
def incremental_embed(spark, sf):
    from clausework.operators import dense

    done = tables.load(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"))
    todo = tables.load(spark, sf, "documents").withColumnRenamed("doc_id", "document_id").join(done, "document_id", "left_anti")
    return dense.hash_buckets(todo, ["document_id"], "text").groupBy("document_id").agg(F.count("*").alias("buckets"), F.round(F.sum("x"), 6).alias("mass"))
