"""Lexical retrieval: every benchmark text is a query, every document line a unit."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from clausework import tables
from clausework.operators import lexical as L
from clausework.plans.oracle import FIRST_STAGE, RANK, TERMS, TWO_STAGE, UNITS
from clausework.plans.registry import query

UNIT = list(L.UNIT)


def run(spark, sf):
    return L.Lexical(tables.queries(spark, sf), tables.retrieval_units(spark, sf))


@query("query_terms", f"WITH {UNITS}, {TERMS} SELECT query_id, term, weight FROM terms")
def query_terms(spark, sf):
    return L.query_terms(tables.queries(spark, sf)).select("query_id", "term", "weight")


@query(
    "multigram_index",
    f"""WITH {UNITS}, t AS (SELECT document_id, unit_order, unnest(regexp_extract_all(document_text || ' ' || heading_text || ' ' || search_text, '[a-z0-9]+')) AS term FROM units)
        SELECT term, document_id, unit_order, count(*) AS tf FROM t WHERE length(term) >= 2 GROUP BY 1, 2, 3""",
)
def multigram_index(spark, sf):
    return L.postings(tables.retrieval_units(spark, sf))


@query("fts_candidates", f"WITH {UNITS}, {TERMS} SELECT query_id, document_id, unit_order FROM cands")
def fts_candidates(spark, sf):
    return run(spark, sf).candidates()


@query(
    "bm25_score",
    f"""WITH {FIRST_STAGE} SELECT query_id, document_id, unit_order, round(score, 6) AS score, matched_terms, {RANK} AS rank FROM first QUALIFY rank <= 200""",
)
def bm25_score(spark, sf):
    return L.top(run(spark, sf).first_stage("top", 200), 200).withColumn("score", F.round("score", 6))


@query(
    "two_stage_lexical",
    f"WITH {TWO_STAGE} SELECT query_id, document_id, unit_order, round(score, 6) AS score, matched_terms, rank FROM lexical",
)
def two_stage_lexical(spark, sf):
    return run(spark, sf).two_stage().withColumn("score", F.round("score", 6))
