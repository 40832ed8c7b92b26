"""Dense retrieval and fusion: vectors with an id divisible by 20 are the queries, searched against all vectors; the two
vector halves stand for two search routes."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from clausework import tables
from clausework.operators import dense as D, evaluation as E, fusion as X
from clausework.plans.oracle import LINES
from clausework.plans.registry import query

#: The stated query set: every vector whose id this divides.
QUERY_STEP = 20
HALF_A, HALF_B = slice(0, 32), slice(32, 64)


def _knn_sql(name: str, lo: int, hi: int, k: int) -> str:
    n = hi - lo
    return f"""{name}_v AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(v, lambda x: x / norm)::DOUBLE[{n}] AS v FROM
     (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[])[{lo + 1}:{hi}] AS v FROM embeddings) s) t),
   {name} AS (SELECT a.vec_id AS query_id, b.vec_id AS unit_id, b.label AS document_id, round(array_inner_product(a.v, b.v), 9) AS score,
     row_number() OVER (PARTITION BY a.vec_id ORDER BY round(array_inner_product(a.v, b.v), 9) DESC, b.vec_id) AS rank FROM {name}_v a, {name}_v b WHERE a.vec_id % {QUERY_STEP} = 0 QUALIFY rank <= {k})"""


ROUTES = f"{_knn_sql('lex', 0, 32, 50)}, {_knn_sql('dense', 32, 64, 60)}"
FUSED = f"""{ROUTES}, fused AS (SELECT query_id, unit_id, document_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, count(*) AS route_count, min(rank) AS best_route_rank,
    min(CASE WHEN route = 'lexical' THEN rank END) AS lexical_rank, min(CASE WHEN route = 'dense' THEN rank END) AS dense_rank
    FROM (SELECT *, 'lexical' AS route FROM lex UNION ALL SELECT *, 'dense' FROM dense) r GROUP BY 1, 2, 3),
  base AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, route_count DESC, best_route_rank, document_id, unit_id) AS rank FROM fused)"""
ADMIT = f"""{FUSED}, heads AS (SELECT query_id, unit_id FROM lex WHERE rank <= 1 UNION SELECT query_id, unit_id FROM dense WHERE rank <= 4),
  flagged AS (SELECT b.*, h.unit_id IS NOT NULL AS protected FROM base b LEFT JOIN heads h ON b.query_id = h.query_id AND b.unit_id = h.unit_id),
  picked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY protected DESC, rank) <= 20 AS final FROM flagged),
  placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank) AS final_rank FROM picked)"""


def vectors_as_queries(spark, sf):
    v = tables.vectors(spark, sf)
    return v.where(F.col("unit_id") % QUERY_STEP == 0).select(F.col("unit_id").alias("query_id"), "embedding"), v


def routes(spark, sf):
    q, v = vectors_as_queries(spark, sf)
    return D.exact_knn(q, v, 50, dims=HALF_A), D.exact_knn(q, v, 60, dims=HALF_B)


def fused(spark, sf):
    lex, dense = routes(spark, sf)
    return lex, dense, X.rrf({"lexical": lex, "dense": dense})


def admitted(spark, sf):
    lex, dense, base = fused(spark, sf)
    return lex, dense, X.head_admission(base, lex, dense)


@query("dense_exact_knn", f"WITH {_knn_sql('d', 0, 64, 60)} SELECT query_id, unit_id, document_id, score, rank FROM d")
def dense_exact_knn(spark, sf):
    q, v = vectors_as_queries(spark, sf)
    return D.exact_knn(q, v, 60)


@query("dense_threshold", f"WITH {_knn_sql('d', 0, 64, 60)} SELECT query_id, unit_id, score, rank FROM d WHERE score > 0.2::DOUBLE")
def dense_threshold(spark, sf):
    q, v = vectors_as_queries(spark, sf)
    return D.exact_knn(q, v, 60, threshold=0.2).select("query_id", "unit_id", "score", "rank")


@query("ann_lsh")
def ann_lsh(spark, sf):
    q, v = vectors_as_queries(spark, sf)
    return D.lsh_knn(q, v, 20)


HASH_SQL = """counts AS (SELECT doc, token, count(*) AS n FROM (SELECT doc, unnest(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[A-Z0-9]+(?:/[A-Z0-9]+)?(?:[-.][A-Z0-9]+)*')) AS token FROM src) s GROUP BY 1, 2),
  b AS (SELECT doc, CAST(('0x' || substr(sha1(token), 1, 8)) AS BIGINT) % 512 AS idx, sum(1 + ln(n::DOUBLE)) AS x FROM counts GROUP BY 1, 2),
  vec AS (SELECT doc, idx, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM b)"""


@query("hash_vectors", f"WITH src AS (SELECT doc_id AS doc, text FROM documents), {HASH_SQL} SELECT doc AS document_id, idx, round(w, 6) AS w FROM vec")
def hash_vectors(spark, sf):
    docs = tables.load(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")
    return D.hash_vectors(docs, ["document_id"], "text").withColumn("w", F.round("w", 6))


@query(
    "hash_knn",
    f"""WITH src AS (SELECT doc_id AS doc, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), {HASH_SQL},
    dots AS (SELECT -1 - q.doc AS query_id, d.doc AS document_id, round(sum(q.w * d.w), 9) AS score FROM vec q JOIN vec d USING (idx) WHERE q.doc < 0 AND d.doc >= 0 GROUP BY 1, 2)
    SELECT query_id, document_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank
    FROM dots WHERE score > 0.08::DOUBLE QUALIFY rank <= 20""",
)
def hash_knn(spark, sf):
    docs = tables.load(spark, sf, "documents").withColumnRenamed("doc_id", "document_id")
    q = D.hash_vectors(tables.queries(spark, sf), ["query_id"], "question")
    return D.hash_knn(q, D.hash_vectors(docs, ["document_id"], "text"), ["document_id"], 20).withColumn("score", F.round("score", 6))


@query("rrf_fuse", f"WITH {FUSED} SELECT query_id, unit_id, round(score, 9) AS score, route_count, best_route_rank, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(dense_rank, 0) AS dense_rank, rank FROM base")
def rrf_fuse(spark, sf):
    _, _, base = fused(spark, sf)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return base.select("query_id", "unit_id", F.round("score", 9).alias("score"), "route_count", "best_route_rank", zero("lexical_rank"), zero("dense_rank"), "rank")


@query(
    "weighted_rrf",
    f"""WITH {ROUTES}, r AS (SELECT query_id, unit_id, 1.15::DOUBLE / (60 + rank) AS x, score FROM lex UNION ALL SELECT query_id, unit_id, 1.0::DOUBLE / (60 + rank), score FROM dense),
    s AS (SELECT query_id, unit_id, sum(x) AS rrf, max(score) * 40 AS raw FROM r GROUP BY 1, 2)
    SELECT query_id, unit_id, round(least(0.99::DOUBLE, greatest(0.0::DOUBLE, least(1.0::DOUBLE, rrf / (4.25::DOUBLE / 61)) * 0.68::DOUBLE
       + 0.32::DOUBLE / (1 + exp(-greatest(-40.0::DOUBLE, least(40.0::DOUBLE, raw)) / 8)) + CASE WHEN raw > 30 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END)), 6) AS score FROM s""",
)
def weighted_rrf(spark, sf):
    lex, dense = routes(spark, sf)
    rows = lex.withColumn("route", F.lit("full_text")).unionByName(dense.withColumn("route", F.lit("vector")))
    raw = rows.groupBy("query_id", "unit_id").agg((F.max("score") * 40).alias("raw")).withColumn("direct", F.col("raw") > 30)
    return X.weighted_rrf(rows, raw).withColumn("score", F.round("score", 6))


@query(
    "head_admission",
    f"""WITH {ADMIT} SELECT query_id, unit_id, rank, final_rank, protected,
       CASE WHEN protected AND rank > 20 THEN 'promoted' WHEN NOT final AND rank <= 20 THEN 'displaced' ELSE 'kept' END AS trace FROM placed""",
)
def head_admission(spark, sf):
    return admitted(spark, sf)[2].select("query_id", "unit_id", "rank", "final_rank", "protected", "trace")


@query(
    "reserve_fill",
    f"""WITH {FUSED}, m AS (SELECT b.*, (d.rank BETWEEN 30 AND 36) IS TRUE AS reserved FROM base b LEFT JOIN dense d ON b.query_id = d.query_id AND b.unit_id = d.unit_id),
     c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY reserved DESC, rank) AS seat FROM m QUALIFY seat <= 20)
     SELECT query_id, unit_id, reserved, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pool_rank FROM c""",
)
def reserve_fill(spark, sf):
    _, dense, base = fused(spark, sf)
    return X.reserve_fill(base, dense.where(F.col("rank").between(30, 36))).select("query_id", "unit_id", "reserved", "pool_rank")


@query("ordered_documents", f"WITH {ROUTES} SELECT query_id, document_id, min(rank) AS first_rank, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS document_rank FROM dense GROUP BY 1, 2 QUALIFY document_rank <= 30")
def ordered_documents(spark, sf):
    return X.ordered_documents(routes(spark, sf)[1], 30)


@query("same_document_ratio", f"WITH {ROUTES}, c AS (SELECT query_id, document_id, count(*) AS n FROM dense WHERE rank <= 5 GROUP BY 1, 2) SELECT query_id, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS ratio, CAST(sum(n) AS BIGINT) AS hits FROM c GROUP BY 1")
def same_document_ratio(spark, sf):
    return X.same_document_ratio(routes(spark, sf)[1]).withColumn("ratio", F.round("ratio", 6))


@query(
    "diversify_documents",
    f"""WITH {ROUTES}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) > 1 AS again FROM dense)
     SELECT query_id, unit_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY again, rank) AS diverse_rank FROM n""",
)
def diversify_documents(spark, sf):
    return X.diversify(routes(spark, sf)[1]).select("query_id", "unit_id", "rank", "diverse_rank")


@query(
    "final_rank_score",
    f"""WITH {ADMIT} SELECT p.query_id, p.unit_id, final_rank, round(greatest(0.05::DOUBLE, 0.99::DOUBLE - (final_rank - 1) * 0.03::DOUBLE), 4) AS score,
      CASE WHEN l.unit_id IS NOT NULL AND d.unit_id IS NOT NULL THEN 'full_text+vector' WHEN l.unit_id IS NOT NULL THEN 'full_text' WHEN d.unit_id IS NOT NULL THEN 'vector' ELSE 'structure' END AS hit_type
     FROM placed p LEFT JOIN lex l ON p.query_id = l.query_id AND p.unit_id = l.unit_id LEFT JOIN dense d ON p.query_id = d.query_id AND p.unit_id = d.unit_id WHERE final""",
)
def final_rank_score(spark, sf):
    lex, dense, placed = admitted(spark, sf)
    return X.final_rank_score(placed.where("final"), {"full_text": lex, "vector": dense})


@query(
    "candidate_union",
    f"""WITH {ROUTES}, r AS (SELECT query_id, unit_id, rank AS place FROM lex UNION ALL SELECT query_id, unit_id, 1000 + rank FROM dense), m AS (SELECT query_id, unit_id, min(place) AS place FROM r GROUP BY 1, 2)
    SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position FROM m""",
)
def candidate_union(spark, sf):
    return X.candidate_union(*routes(spark, sf))


MERGE_SQL = f"""{ROUTES}, hits AS (SELECT query_id, document_id, unit_id % 7 AS clause, score, rank AS seq, 'full_text' AS route FROM lex UNION ALL SELECT query_id, document_id, unit_id % 7, score, 1000 + rank, 'vector' FROM dense),
   merged AS (SELECT query_id, document_id, clause, max(score) AS score, min(seq) AS seq, array_to_string(list_sort(list(DISTINCT route)), '+') AS routes FROM hits GROUP BY 1, 2, 3)"""


def hits_by_clause(spark, sf):
    lex, dense = routes(spark, sf)
    a = lex.select("query_id", "document_id", (F.col("unit_id") % 7).alias("clause"), "score", F.col("rank").alias("seq"), F.lit("full_text").alias("route"))
    b = dense.select("query_id", "document_id", (F.col("unit_id") % 7).alias("clause"), "score", (1000 + F.col("rank")).alias("seq"), F.lit("vector").alias("route"))
    return a.unionByName(b)


@query("merge_hits", f"WITH {MERGE_SQL} SELECT query_id, document_id, clause, score, routes, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq, document_id, clause) AS rank FROM merged QUALIFY rank <= 48")
def merge_hits(spark, sf):
    return X.merge_hits(hits_by_clause(spark, sf), ["document_id", "clause"], 48).drop("seq")


@query(
    "multi_query_merge",
    f"""WITH {ROUTES}, v AS (SELECT CAST(label AS BIGINT) AS parent, vec_id FROM embeddings), h AS (SELECT parent, query_id AS variant, unit_id, score, rank FROM dense JOIN v ON query_id = vec_id),
     m AS (SELECT parent, unit_id, max(score) AS score, bool_or(rank <= 3) AS target_head, count(DISTINCT variant) AS variants FROM h GROUP BY 1, 2)
     SELECT parent AS query_id, unit_id, score, target_head, variants, row_number() OVER (PARTITION BY parent ORDER BY target_head DESC, score DESC, unit_id) AS rank FROM m QUALIFY rank <= 14""",
)
def multi_query_merge(spark, sf):
    _, dense = routes(spark, sf)
    parents = tables.vectors(spark, sf).select(F.col("unit_id").alias("variant"), F.col("document_id").alias("parent"))
    return E.merge_variants(dense.withColumnRenamed("query_id", "variant").join(parents, "variant"), 3, 14)


@query(
    "retrieval_stats",
    f"""WITH {ROUTES}, u AS (SELECT query_id, unit_id, document_id, 1 AS l, 0 AS d FROM lex UNION ALL SELECT query_id, unit_id, document_id, 0, 1 FROM dense)
     SELECT query_id, CAST(sum(l) AS BIGINT) AS full_text_hits, CAST(sum(d) AS BIGINT) AS vector_hits, count(DISTINCT unit_id) AS candidate_count, count(DISTINCT document_id) AS documents,
      round(1 - count(DISTINCT unit_id) / CAST(count(*) AS DOUBLE), 6) AS duplicate_ratio FROM u GROUP BY 1""",
)
def retrieval_stats(spark, sf):
    lex, dense = routes(spark, sf)
    return E.retrieval_stats({"full_text": lex, "vector": dense})


@query("mmr_rerank")
def mmr_rerank(spark, sf):
    q, v = vectors_as_queries(spark, sf)
    return X.mmr(D.exact_knn(q, v, 80), v)


@query(
    "recall_at_k",
    f"""WITH {ROUTES}, {_knn_sql('exact', 0, 64, 20)}, per AS (SELECT e.query_id, count(d.unit_id) / 20.0::DOUBLE AS recall FROM exact e LEFT JOIN dense d ON e.query_id = d.query_id AND e.unit_id = d.unit_id AND d.rank <= 20 GROUP BY 1)
     SELECT round(avg(recall), 6) AS mean_recall, min(recall) AS min_recall, count(*) AS queries FROM per""",
)
def recall_at_k(spark, sf):
    q, v = vectors_as_queries(spark, sf)
    return E.recall_summary(E.recall_at_k(routes(spark, sf)[1], D.exact_knn(q, v, 20), 20))


@query(
    "select_setting",
    f"""WITH {_knn_sql('exact', 0, 64, 20)}, {_knn_sql('s16', 0, 16, 20)}, {_knn_sql('s32', 0, 32, 20)}, {_knn_sql('s48', 0, 48, 20)},
     runs AS (SELECT 16 AS cost, * FROM s16 UNION ALL SELECT 32, * FROM s32 UNION ALL SELECT 48, * FROM s48),
     r AS (SELECT cost, count(e.unit_id) / CAST(count(*) AS DOUBLE) AS recall FROM runs a LEFT JOIN exact e USING (query_id, unit_id) GROUP BY 1)
     SELECT CAST(min_by(cost, cost) AS BIGINT) AS cost, round(min_by(recall, cost), 6) AS mean_recall FROM r WHERE recall >= 0.3::DOUBLE""",
)
def select_setting(spark, sf):
    q, v = vectors_as_queries(spark, sf)
    exact = D.exact_knn(q, v, 20)
    rows = None
    for cost in (16, 32, 48):
        per = E.recall_at_k(D.exact_knn(q, v, 20, dims=slice(0, cost)), exact, 20).withColumn("cost", F.lit(cost).cast("long"))
        rows = per if rows is None else rows.unionByName(per)
    mean = rows.groupBy("cost").agg(F.avg("recall").alias("mean_recall"))
    return E.select_setting(mean, 0.3).withColumn("mean_recall", F.round("mean_recall", 6))
