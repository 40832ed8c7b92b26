"""Queries meet rows in bounded blocks: nothing that is shuffled or held by a task grows with pairs."""

from pyspark.sql import functions as F

from clausework.operators import dense as D, graph as K, lexical as L


def test_lsh_shuffles_rows_and_no_candidate_pairs(spark, monkeypatch):
    monkeypatch.setattr(D, "QUERY_BLOCK", 8)
    monkeypatch.setattr(D, "VECTOR_BLOCK", 16)
    v = spark.range(60).select(F.col("id").alias("unit_id"), (F.col("id") % 3).alias("document_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(F.col("id") * 7 + i * i).cast("float")).alias("embedding"))
    q = v.where("unit_id % 4 = 0").selectExpr("unit_id as query_id", "embedding")
    found = D.lsh_knn(q, v, 5)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["query_id"], r["rank"]): r["unit_id"] for r in found.collect()}
    exact = {(r["query_id"], r["rank"]): r["unit_id"] for r in D.exact_knn(q, v, 5).collect()}
    assert all(got[n, 1] == n for n in range(0, 60, 4))
    assert len(set(got.items()) & set(exact.items())) >= 0.9 * len(exact)
    # a key so wide that only equal vectors share it
    assert {(r["query_id"], r["unit_id"]) for r in D.lsh_knn(q, v, 5, tables=2, width=40, bucket=0.01).collect()} == {(n, n) for n in range(0, 60, 4)}


def test_hashed_tokens_are_counted_in_tasks_of_bounded_text(spark, monkeypatch):
    texts = spark.createDataFrame([(i % 40, f"alpha beta{i} beta{i} GAMMA-7 {'x' * 20}") for i in range(80)] + [(99, None)], "document_id long, text string")
    want = {(r["document_id"], r["idx"]): round(r["x"], 9) for r in D.hash_buckets(texts, ["document_id"], "text").collect()}
    monkeypatch.setattr(D, "TASK_CHARS", 50)
    held = D.hash_buckets(texts, ["document_id"], "text")
    assert held.rdd.getNumPartitions() >= 60
    assert {(r["document_id"], r["idx"]): round(r["x"], 9) for r in held.collect()} == want


def some_units(spark):
    words = ["alpha", "beta", "xalphax", "gamma7", "12", "beta-alpha", "q"]
    rows = [(i % 9, i // 9, " ".join(words[(i * 3 + j * j) % 7] for j in range(4)), "head" if i % 5 else "beta", f"doc {i}") for i in range(45)]
    return rows, spark.createDataFrame(rows, "document_id long, unit_order long, search_text string, heading_text string, document_text string")


def test_candidates_leave_their_task_only_as_results(spark, monkeypatch):
    monkeypatch.setattr(L, "QUERY_BLOCK", 1)
    rows, units = some_units(spark)
    asked = spark.createDataFrame([(1, "Beta 12"), (2, "alpha"), (3, "nowhere"), (4, "head doc")], "query_id long, question string")
    want = {(q, d, u) for q, toks in ((1, {"beta", "12"}), (2, {"alpha"}), (4, {"head", "doc"})) for d, u, *texts in rows if toks & set(" ".join(texts).replace("-", " ").split())}
    found = L.Lexical(asked, units).candidates()
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sorted(map(tuple, L.Lexical(asked, units.unionByName(units)).candidates().collect())) == sorted(want)


def test_field_scores_do_not_copy_texts_by_gram(spark):
    rows = spark.createDataFrame([(1, "a-1", "alpha beta", "s", "one alphabet of beta", False), (2, "beta-2", None, "s", "x y", False), (2, "b-2", "t", "s", "of beta", False)], "document_id long, number string, title string, section string, body string, tabular boolean")
    asked = spark.createDataFrame([(7, "q"), (8, "q")], "query_id long, question string")
    terms = spark.createDataFrame([(7, "alpha"), (7, "beta"), (8, "of beta"), (8, "none")], "query_id long, term string")
    found = L.field_score(asked, terms, rows.where("number <> 'b-2'"), ("license",), "table")
    assert {(r["query_id"], r["document_id"]): r["score"] for r in found.collect()} == {(7, 1): 10.0, (7, 2): 5.0, (8, 1): 1.0}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "_gram" not in plan


def test_full_text_reads_the_index_once_and_ranks_inside_parts(spark, monkeypatch):
    monkeypatch.setattr(L, "QUERY_BLOCK", 1)
    rows, units = some_units(spark)
    fields = units.selectExpr("document_id", "unit_order", "search_text as text", "document_text as title", "heading_text as number")
    asked = spark.createDataFrame([(1, [["beta"], ["alpha", "12"]], ["beta", "alpha"], 30), (2, [], ["amma"], 3), (3, [], ["c 3"], 40)], "query_id long, groups array<array<string>>, terms array<string>, recall int")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    index = L.postings(units)
    n = index.count()
    got = {}
    for r in L.full_text(asked, index.mapInArrow(seen, index.schema), fields.unionByName(fields)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["tier"], r["document_id"], r["unit_order"]))
    assert read.value == n
    tokens = {(d, u): set(" ".join(t).replace("-", " ").split()) for d, u, *t in rows}
    assert {r[2:] for r in got[1] if r[1] == 1} <= {k for k, t in tokens.items() if "beta" in t and t & {"alpha", "12"}}
    assert sum(r[1] == 1 for r in got[1]) == min(20, sum("beta" in t and bool(t & {"alpha", "12"}) for t in tokens.values()))
    inside = sorted((len(t[0]), d, u) for d, u, *t in rows if any("amma" in x for x in t))
    assert [r[2:] for r in sorted(got[2])] == [k[1:] for k in inside[:3]]
    assert {r[2:] for r in got[3]} == {(d, u) for d, u, *t in rows if "c 3" in t[2]}


def test_term_mentions_sum_inside_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "TERM_BLOCK", 1)
    units = spark.createDataFrame([(1, 1, "Alpha"), (1, 2, "alphabet x"), (1, 5, "y\tALPHA"), (2, 4, "a beta b"), (2, 3, "xbeta"), (3, 1, None)], "document_id long, unit_order long, text string")
    terms = spark.createDataFrame([("alpha",), ("beta b",), ("beta",), ("none",), (None,)], "term string")
    found = K.term_mentions(units, terms)
    assert {tuple(r) for r in found.collect()} == {(1, "alpha", 0.9, 3), (2, "beta", 0.8, 2), (2, "beta b", 0.55, 1)}
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()


def test_ranked_rows_leave_a_task_once(spark, monkeypatch):
    from clausework.operators import postings as P

    monkeypatch.setattr(P, "PART_UNITS", 7)
    _, units = some_units(spark)
    asked = spark.createDataFrame([(1, "Beta 12 alpha"), (2, "alpha gamma7"), (3, "nowhere doc"), (4, "head doc")], "query_id long, question string")
    run = L.Lexical(asked, units.repartition(3).cache())
    order = lambda r: (-r["score"], -r["matched_terms"], r["document_id"], r["unit_order"])
    full = {}
    for r in run.first_stage().collect():
        full.setdefault(r["query_id"], []).append(r)
    few = run.first_stage("top", 4)
    assert few.count() <= 3 * 4 * 4
    got = {(r["query_id"], r["rank"]): (r["document_id"], r["unit_order"], r["score"]) for r in L.top(few, 4).collect()}
    assert got == {(q, i + 1): (r["document_id"], r["unit_order"], r["score"]) for q, rows in full.items() for i, r in enumerate(sorted(rows, key=order)[:4])}
    documents = run.first_stage("documents", 2)
    assert documents.count() <= 3 * 4 * 2
    best = {q: list(dict.fromkeys(r["document_id"] for r in sorted(rows, key=order)))[:2] for q, rows in full.items()}
    assert {(r["query_id"], r["document_rank"]): r["document_id"] for r in run.best_documents(2).collect()} == {(q, i + 1): d for q, ds in best.items() for i, d in enumerate(ds)}


def test_hashed_units_are_ranked_where_they_lie(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_UNITS", 7)
    monkeypatch.setattr(D, "CHUNK", 3)
    monkeypatch.setattr(D, "QUERY_BLOCK", 2)
    rows, units = some_units(spark)
    units = units.unionByName(spark.createDataFrame([(50, 1, "", "h", "d"), (50, 2, None, "h", "d"), (50, 3, "甲乙丙丁 x-1/2 甲乙", "h", "d")], units.schema))
    q = D.hash_vectors(spark.createDataFrame([(1, "Beta 12"), (2, "alpha甲乙丙"), (3, "gamma7 beta-alpha"), (4, "none")], "query_id long, question string"), ["query_id"], "question")
    plain = lambda df: {(r["query_id"], r["rank"]): (r["document_id"], r["unit_order"], round(r["score"], 8)) for r in df.collect()}
    keys = ["document_id", "unit_order"]
    found = D.hash_knn_parts(q, D.hash_parts(units, "search_text"), 6, 0.0)
    assert plain(found) == plain(D.hash_knn(q, D.hash_vectors(units, keys, "search_text"), keys, 6, 0.0))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = spark.createDataFrame([(query, d) for query in (1, 2, 3) for d in (1, 4, 50) if (query + d) % 2], "query_id long, document_id long")
    scoped = units.join(pairs.groupBy("document_id").agg(F.collect_set("query_id").alias("scope")), "document_id")
    assert plain(D.hash_knn_parts(q, D.hash_parts(scoped, "search_text"), 6, 0.0)) == plain(D.hash_knn(q, D.hash_vectors(units, keys, "search_text"), keys, 6, 0.0, pairs))


def test_shared_fields_are_made_once_for_a_document(spark):
    from clausework import tables

    plan = tables.retrieval_units(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "source" not in above and "source" in below


def test_texts_without_han_signs_are_not_cut_by_chunk(spark):
    texts = {"ab c d1-e22 x": ["ab", "d1", "e22"], "": [], "中文字ab 甲": ["中文", "文字", "中文字", "ab"], "a中b": [], None: None, "9 9": []}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", L.tokens("t").alias("x")).collect()} == texts
    assert "[a-z0-9]{2,}" in L.tokens("t")._jc.toString()
