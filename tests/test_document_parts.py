"""Queries that pair documents with queries inside the document's row, on odd rows and against their SQL."""

from __future__ import annotations

import random

import pytest

from clausework.plans import REGISTRY
from tests.oracle_check import compare, duck

NAMES = ("per_document_evidence", "family_reservation")


@pytest.fixture(scope="module")
def odd(spark):
    """Long documents, repeated and null ids, null and empty texts; a repeated and a null query id, null and empty questions."""
    import tempfile

    folder, rng = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), random.Random(4)
    words = ["the", "The", "a", "tion", "x1", "été", "日本語", "rare", "of", "", "-", "a,b"]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(n))
    docs = [(1, text(3000)), (2, text(9)), (2, text(4)), (2, None), (None, text(5)), (None, text(7)), (3, ""), (4, None), (5, text(1)), (6, "\n\n")] + [(10 + i, text(rng.randrange(40))) for i in range(80)]
    asked = [(1, "The relation of rare things"), (1, "x1 été"), (2, ""), (3, None), (None, "a the x1"), (4, "日本語 of a\nthe")] + [(10 + i, " ".join(rng.choices(words, k=5))) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'a' as source", "cast(length(text) as long) as n_chars").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_match_sql(spark, odd, name):
    con = duck("/nowhere")
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    ok, message = compare(REGISTRY[name].run(spark, odd), con, REGISTRY[name].sql)
    assert ok, message


@pytest.mark.parametrize("name", NAMES)
def test_pairs_are_not_shuffled(spark, name):
    """what was found for a query and a document never crosses an exchange."""
    plan = REGISTRY[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan
    assert not any(f"hashpartitioning({c}" in plan for c in ("target", "query_id", "document_id", "word", "pattern"))
