"""Leaf branches, graph tiers, reservations, full-text tiers and scores on literal rows and against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np

from clausework.operators import dense as D, evidence as V, fusion as X, graph as K, leaves as Lv, lexical as L, segment as S, structure as St

UNIT_SCHEMA = "document_id long, unit_order long, unit_type string, title string, section_path string, clause_no string, validation_status string, wide_layout boolean, text string, caption string, matrix array<array<string>>"
PAD = "内容说明" * 150


def unit(order, kind, text, section="S", **more):
    row = {"document_id": 1, "unit_order": order, "unit_type": kind, "title": "t", "section_path": section, "clause_no": "5", "validation_status": "governed_source", "wide_layout": False, "text": text, "caption": "", "matrix": None} | more
    return tuple(row.values())


def test_every_leaf_branch(spark):
    numbered = "\n".join(f"（{i}）{PAD}" for i in (1, 2, 3))
    units = [
        unit(1, "clause", "短条文的内容足够"), unit(2, "clause", numbered), unit(3, "clause", PAD * 3), unit(4, "policy_clause", f"一、总则\n{PAD}\n1. {PAD}\n二、附则\n{PAD}"),
        unit(5, "front_matter", PAD * 3), unit(6, "front_matter", numbered, title="第1号修改单"), unit(7, "table", "x", matrix=[["名称", ""], ["甲", "1"], ["", ""], ["", "2"]], section="表格区"),
        unit(8, "table", "y", section="料 > 申请资料表", matrix=[["a"], ["b"]]), unit(9, "application_material_row", "申请书原件一份", section="料 > 材料 1 申请书"), unit(10, "table", "z", section="无", validation_status="parsed_from_ocr"),
        unit(11, "clause", "中华人民共和国发布前言" + PAD * 3), unit(12, "clause", "表 A.1 名称\n" + PAD * 3), unit(13, "clause", "整页重排的文字", wide_layout=True), unit(14, "clause", ""), unit(15, "clause", None),
    ]
    rows = Lv.branch_leaves(Lv.leaf_branches(spark.createDataFrame(units, UNIT_SCHEMA))).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["unit_order"], r["piece"])):
        by.setdefault(r["unit_order"], []).append(r)
    methods = {k: v[0]["derivation_method"] for k, v in by.items()}
    assert methods == {
        1: "source_unit_with_context", 2: "explicit_numbered_subclause_split", 3: "long_atomic_unit_retained", 4: "explicit_numbered_subclause_split", 5: "long_front_matter_context_only", 6: "explicit_numbered_subclause_split",
        7: "structured_table_row", 9: "application_material_row_linked", 10: "table_without_structured_rows_retained", 11: "long_ocr_front_matter_context_only", 12: "unstructured_table_like_unit_retained", 13: "wide_layout_legacy_fallback",
        14: "source_unit_with_context", 15: "source_unit_with_context",
    }
    assert [r["clause_no"] for r in by[2]] == ["5#1", "5#2", "5#3"] and all(r["citation_eligible"] for r in by[2])
    assert [r["local_heading"] for r in by[4]] == ["一、总则", "一、总则", "二、附则"]
    assert [(r["clause_no"], r["citation_text"]) for r in by[7]] == [("row-1", "表格区\n名称：甲\n列2：1"), ("row-3", "表格区\n列2：2")]
    tables = {r["unit_order"]: r["parent_id"] for r in Lv.leaf_branches(spark.createDataFrame(units, UNIT_SCHEMA)).collect()}
    assert by[9][0]["parent_id"] == tables[8] and 8 not in by  # the material row stands for the table's rows
    assert not by[10][0]["citation_eligible"] and by[5][0]["review_status"] == by[14][0]["review_status"] == "context_only"
    assert len({r["leaf_id"] for r in rows}) == len(rows)


def test_blocks_need_two_meaningful_and_fifty_at_most(spark):
    texts = ["1. 一\n2. 二", "\n".join(f"{i}. 第{i}项内容说明文字" for i in range(51)), "\n".join(f"{i}. 第{i}项内容说明文字" for i in range(50)), "1.1 层级标题的内容说明\n1.2 层级标题的内容说明\n正文"]
    rows = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    got = {}
    for r in S.explicit_blocks(rows, "text", ["document_id"]).orderBy("block_no").collect():
        got.setdefault(r["document_id"], []).append(r["block_text"])
    assert {k: len(v) for k, v in got.items()} == {2: 50, 3: 2}
    assert all("\n".join(v) == texts[k] for k, v in got.items())


def test_units_carry_their_section_in_linear_time(spark):
    lines = [f"{'# ' if i % 7 == 0 else '- ' if i % 3 == 0 else ''}line {i}" for i in range(1, 3000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "document_id long, text string")
    got = S.structural_units(docs, lambda s: s.startswith("# ") | s.startswith("- "), lambda s: s.startswith("# ")).orderBy("unit_order").collect()
    section, want = None, []
    for i, line in enumerate(lines):
        if line.startswith("# "):
            section = line
        if i == 0 or line[:2] in ("# ", "- "):
            want.append((i + 1, section))
    assert [(r["line_start"], r["section_path"]) for r in got] == want
    assert "\n".join(r["unit_text"] for r in got) == "\n".join(lines)


def test_graph_tiers(spark):
    asked = spark.createDataFrame([(1, "duty", ["Alpha—1"]), (2, "duty", ["lph"]), (3, "duty", ["eta"]), (4, "open", ["eta", "x"]), (5, "open", ["nothing"]), (6, "open", [])], "query_id long, intent string, terms array<string>")
    entities = spark.createDataFrame([("a", "law", "ALPHA-1"), ("b", "law", "Beta"), ("c", "person", "Zeta")], "entity_id string, entity_type string, name string")
    relations = spark.createDataFrame([("a", "z", "OWNS", 10, 0.5), ("z", "a", "OWNS", 11, 0.9), ("a", "z", "SEES", 12, 1.0), ("b", "z", "SEES", 13, 0.4), ("b", "z", "SEES", 13, 0.7), ("a", "z", "OWNS", 99, 1.0)], "source_id string, target_id string, relation string, chunk_id long, confidence double")
    chunks = spark.createDataFrame([(i,) for i in (10, 11, 12, 13)], "chunk_id long")
    intents = spark.createDataFrame([("duty", "OWNS")], "intent string, relation string")
    got = [tuple(r) for r in K.graph_candidates(asked, entities, relations, chunks, intents, ["law"], 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, 0.9, 1, 1), (1, 10, 0.5, 1, 2), (2, 11, 0.9, 2, 1), (2, 10, 0.5, 2, 2), (3, 13, 0.7, 3, 1), (4, 13, 0.7, 2, 1)]


def test_reservations_compete_in_order(spark):
    order = spark.createDataFrame([(1, u, r) for r, u in enumerate("abcdefg", 1)] + [(2, "a", 1)], "query_id long, unit_id string, rank long")
    barred = spark.createDataFrame([(1, "b", "branch"), (1, "y", "branch")], "query_id long, unit_id string, reason string")
    seen = []

    def fixed(*units):
        return lambda seed: seed.sparkSession.createDataFrame([(1, u, i) for i, u in enumerate(units)], "query_id long, unit_id string, position int")

    def watching(seed):
        seen.append({(r["query_id"], r["unit_id"]) for r in seed.collect()})
        return fixed("x", "z", "w")(seed)

    rows = St.structure_pipeline(order, barred, [("one", fixed("g", "y")), ("two", watching)], 3).collect()
    assert seen == [{(1, "a"), (1, "c"), (1, "d"), (1, "g"), (1, "y"), (2, "a")}]
    got = {(r["query_id"], r["unit_id"]): (r["decision"], r["package"], r["pool_rank"]) for r in rows}
    assert got == {
        (1, "a"): ("displaced", "", 0), (1, "b"): ("quarantined", "", 0), (1, "c"): ("displaced", "", 0), (1, "d"): ("displaced", "", 0), (1, "e"): ("left", "", 0), (1, "f"): ("left", "", 0), (1, "g"): ("reserved", "one", 1),
        (1, "y"): ("conflict", "one", 0), (1, "x"): ("reserved", "two", 2), (1, "z"): ("reserved", "two", 3), (1, "w"): ("over_capacity", "two", 0), (2, "a"): ("filled", "", 1),
    }


def test_full_text_tiers(spark):
    units = [(1, i, t, "", "") for i, t in enumerate(["red stone ore", "red ore", "stone", "red", "größe ab", "bigstones here and there", "ore"], 1)]
    frame = spark.createDataFrame(units, "document_id long, unit_order long, search_text string, heading_text string, document_text string")
    fields = frame.selectExpr("document_id", "unit_order", "search_text as text", "heading_text as title", "document_text as number")
    asked = spark.createDataFrame([(1, [["red"], ["ore", "gold"]], ["red", "stone", "7"], 40), (2, [], ["stone"], 2), (3, [["größe"]], ["ösz", "tone"], 40)], "query_id long, groups array<array<string>>, terms array<string>, recall int")
    got = {}
    for r in L.full_text(asked, L.postings(frame), fields).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["unit_order"], r["tier"]))
    assert {u for u, t in got[1] if t == 1} == {1, 2} and {u for u, t in got[1] if t == 2} == {3, 4} and [x for x in got[1] if x[1] == 3] == [(6, 3)]
    assert [u for u, _ in got[2]] == [3, 1]  # the shorter unit first; full at its limit
    assert got[3] == [(3, 3), (1, 3), (6, 3)]  # no token is a fragment of a word; shortest unit first


def test_recall_limits(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("comparison", "x", False, 5), ("a", "service_materials", True, 5), ("a", "x", True, 5), ("a", "x", False, 50)], "mode string, intent string, hard boolean, hits int")
    assert [r[0] for r in rows.select(L.recall_limit(F.col("mode"), F.col("intent"), F.col("hard"), F.col("hits"))).collect()] == [80, 60, 30, 120]


def test_field_score_reads_short_and_foreign_terms_in_every_field(spark):
    asked = spark.createDataFrame([(1, "ab 矿 license")], "query_id long, question string")
    terms = spark.createDataFrame([(1, "ab"), (1, "矿"), (1, "é")], "query_id long, term string")
    rows = spark.createDataFrame([(1, "ab-1", "矿石", "é", "ab 矿 é", False), (2, "x", "x", "x", "é license", True), (3, "x", "x", "x", "x", False)], "document_id long, number string, title string, section string, body string, tabular boolean")
    got = {r["document_id"]: round(r["score"], 6) for r in L.field_score(asked, terms, rows, ("license",), "table").collect()}
    assert got == {1: 5 + 4 + 2.5 + 3 - 3, 2: 1 + 3 + 0.5 - 1.2}


def test_plan_score_by_hand(spark):
    plan = (1, "mat", ["law"], ["red"], ["ore", "矿"], ["zz"], ["bad", "worse"], ["title"], [["red", "x"], ["y"]], True, False, True, "table")
    plans = spark.createDataFrame([plan, (2, "none", [], [], [], [], [], [], [], False, False, False, "text")], "query_id long, intent string, document_types array<string>, subject array<string>, required array<string>, alternative array<string>, negative array<string>, titles array<string>, groups array<array<string>>, hard_scope boolean, any_type boolean, semantic boolean, output_mode string")
    rules = spark.createDataFrame([("mat", 1, 1, "section", "s9", 10.0), ("mat", 1, 2, "section", "s", 7.0), ("mat", 2, 1, "number", "n", -2.0)], "intent string, grp int, priority int, field string, pattern string, delta double")
    rows = spark.createDataFrame([(1, 1, "law", "table", "n", "title", "s9", "red ore 矿 y bad"), (1, 2, "guide", "text", "", "other", "s1", "worse bad"), (2, 1, "law", "table", "n", "title", "s9", "red")], "query_id long, unit_id long, document_type string, chunk_type string, number string, title string, section string, text string")
    got = {(r["query_id"], r["unit_id"]): r["score"] for r in V.plan_score(rows, plans, rules, ["unit_id"]).collect()}
    first = 3 + 2 + 2 * 2.5 + 3 * 3 + 4 + 2 * 3 + 8 - 4.5 + 8 + 12 + 10 - 2
    assert got == {(1, 1): first, (1, 2): -10 - 9 - 6 + 7, (2, 1): 0.0}


def test_references_of_any_length_and_script(spark):
    pattern = "[a-z]+-[0-9]+|[\\p{L}\\p{N}]+"
    mine = spark.createDataFrame([(1, "DZ-12 ab 矿 Größe"), (2, "ab")], "key long, text string")
    theirs = spark.createDataFrame([(1, "AB größe"), (3, "ab dz-12 矿")], "key long, text string")
    assert sorted(map(tuple, V.unverified_references(mine, theirs, pattern).collect())) == [(1, "dz-12"), (1, "矿"), (2, "ab")]


def test_hashed_neighbours_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(D, "QUERY_BLOCK", 3)
    monkeypatch.setattr(D, "SPARSE_BLOCK", 7)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["矿石", "é"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(40)]
    units = spark.createDataFrame([(i % 4, i, t) for i, t in enumerate(texts)], "document_id long, unit_order long, text string")
    asked = spark.createDataFrame([(i, texts[i]) for i in range(8)], "query_id long, text string")
    vectors, queries = D.hash_vectors(units, ["document_id", "unit_order"], "text"), D.hash_vectors(asked, ["query_id"], "text")
    dense = {}
    for r in vectors.collect():
        dense.setdefault((r["document_id"], r["unit_order"]), np.zeros(D.VECTOR_DIM))[r["idx"]] = r["w"]
    own = {i: dense[(i % 4, i)] for i in range(8)}
    scope = spark.createDataFrame([(q, d) for q in range(7) for d in (q % 4, (q + 1) % 4)], "query_id long, document_id long")
    for allowed, narrowed in ((None, lambda q, d: True), (scope, lambda q, d: q < 7 and d in (q % 4, (q + 1) % 4))):
        got = {(r["query_id"], r["rank"]): (r["document_id"], r["unit_order"]) for r in D.hash_knn(queries, vectors, ["document_id", "unit_order"], 5, 0.1, allowed).collect()}
        want = {}
        for q, v in own.items():
            scored = sorted((-round(float(v @ u), 9), k) for k, u in dense.items() if round(float(v @ u), 9) > 0.1 and narrowed(q, k[0]))
            want |= {(q, i + 1): k for i, (_, k) in enumerate(scored[:5])}
        assert got == want


def test_hybrid_frontier_protects_heads_and_keeps_single_routes(spark):
    schema = "query_id long, document_id long, unit_order long, rank long"
    lexical = spark.createDataFrame([(1, 1, u, u) for u in range(1, 31)] + [(2, 9, 9, 1)], schema)
    dense = spark.createDataFrame([(1, 2, u, u) for u in range(1, 31)], schema)
    rows = X.hybrid_frontier(lexical, dense).collect()
    one = {r["unit_id"]: r for r in rows if r["query_id"] == 1}
    assert len(one) == 60 and all(one[u]["final_rank"] <= 20 for u in ("1:1", "2:1", "2:2", "2:3", "2:4"))
    assert math.isclose(one["1:1"]["score"], 1 / 61, abs_tol=1e-12) and one["1:1"]["dense_rank"] is None
    assert [(r["unit_id"], r["final_rank"]) for r in rows if r["query_id"] == 2] == [("9:9", 1)]


def test_sources_first_used_at_one_place_are_numbered_by_source(spark):
    rows = [(a, 1, 1, source) for a in range(40) for source in range(30, 0, -1)]
    facts = spark.createDataFrame(rows, "answer_id long, fact_no long, use_no long, source long").repartition(7)
    got = {(r["answer_id"], r["source"]): r["new_no"] for r in V.compact_sources(facts).collect()}
    assert got == {(a, source): source for a in range(40) for source in range(1, 25)}


def test_registry_compares_distinct_titles_once(spark):
    from pyspark.sql import functions as F

    from clausework.functions import similarity
    from clausework.operators import joins as J

    calls = spark.sparkContext.accumulator(0)
    rng = random.Random(5)
    names = ["alpha", "alphb", "beta", "gamma"]
    docs = [(i, i % 5 if i % 11 else None, rng.choice(names)) for i in range(200)]
    registry = [(1000 - i, i % 4, rng.choice(names), i % 4 == 2 or rng.random() < 0.5) for i in range(120)]

    @F.udf("string")
    def counted(title):
        calls.add(1)
        return title

    ratio = F.coalesce(F.round(similarity.edit_ratio(counted("title"), "official_title"), 6), F.lit(-1.0))
    d = spark.createDataFrame(docs, "document_id long, number long, title string")
    r = spark.createDataFrame(registry, "registry_id long, number long, official_title string, is_amendment boolean")
    got = {x["document_id"]: (x["registry_id"], x["official_title"], x["is_amendment"], x["similarity"]) for x in J.best_registry_match(d, r, ratio).collect()}
    near = lambda a, b: round(1 - sum(x != y for x, y in zip(a, b)) / 5, 6)
    assert len(got) == 200 and calls.value < 400
    for i, number, title in docs:
        mine = [x for x in registry if x[1] == number]
        first = min((x[3] for x in mine), default=None)
        same = [x for x in mine if x[3] == first and x[2] == title]
        if not mine:
            assert got[i] == (None, None, None, -1.0)
        elif same:
            assert got[i] == (min(x[0] for x in same), title, first, 1.0)
        else:
            assert got[i][2] == first and got[i][3] < 1.0


def test_graph_joins_only_evidence_that_can_be_answered(spark, monkeypatch):
    sizes = {}
    kept = K.materialize
    monkeypatch.setattr(K, "materialize", lambda df, name: sizes.setdefault(name, out.count()) and out if (out := kept(df, name)) else out)
    asked = spark.createDataFrame([(i, "open", ["Hub"]) for i in range(50)], "query_id long, intent string, terms array<string>")
    entities = spark.createDataFrame([("e", "nation", "hub")], "entity_id string, entity_type string, name string")
    relations = spark.createDataFrame([("e", f"x{i % 3}", "R", i, (i % 50) / 100) for i in range(400)], "source_id string, target_id string, relation string, chunk_id long, confidence double")
    intents = spark.createDataFrame([("authority", "R")], "intent string, relation string")
    rows = K.graph_candidates(asked, entities, relations, relations.select("chunk_id"), intents, ["nation"], 5).collect()
    want = sorted(range(400), key=lambda i: (-(i % 50), i))[:5]
    assert sizes["asked"] == 1 and sizes["ends"] <= 20
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["tier"]) for r in rows) == [(q, k + 1, c, 1) for q in range(50) for k, c in enumerate(want)]


def test_product_holds_few_scores_at_once(spark, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.integers(-2, 3, (60, 4)).astype(float) + 0.5
    v = spark.createDataFrame([(i, i % 3, m[i].tolist()) for i in range(60)], "unit_id long, document_id long, embedding array<float>")
    monkeypatch.setattr(D, "CELLS", 130)
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(n @ n.T, 9)
    got = {(r["query_id"], r["rank"]): (r["unit_id"], r["score"]) for r in D.exact_knn(v.selectExpr("unit_id as query_id", "embedding"), v, 4, 0.1).collect()}
    want = {(q, k + 1): (u, s[q, u]) for q in range(60) for k, u in enumerate(sorted((u for u in range(60) if s[q, u] > 0.1), key=lambda u: (-s[q, u], u))[:4])}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}


def test_merged_cells_over_ragged_rows_without_an_exchange(spark):
    rng = random.Random(8)
    matrix = [["h"]] + [[rng.choice(["", "", None, f"v{i}"]) for _ in range(rng.randint(0, 4))] for i in range(200)]
    t = spark.createDataFrame([(1, "c", matrix), (2, "c", [["h"]]), (3, "c", [])], "table_id long, caption string, matrix array<array<string>>")
    rows = Lv.table_rows(t)
    last, want = {}, {}
    for i, row in enumerate(matrix[1:]):
        for j, cell in enumerate(row):
            last[j] = cell or last.get(j)
        if row:
            want[(1, i)] = [last[j] or "" for j in range(len(row))]
    assert {(r["table_id"], r["row_no"]): r["cells"] for r in rows.collect()} == want
    assert "Exchange" not in rows._jdf.queryExecution().toString()


def test_only_tables_and_material_rows_are_joined(spark):
    plan = Lv.leaf_branches(spark.createDataFrame([unit(1, "clause", "x")], UNIT_SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def test_measurement_parts_are_computed_once():
    from clausework.functions import spans

    assert spans.canonical_text("t")._jc.toString().count("regexp_extract(") <= 2


def test_registry_titles_meet_in_blocks_without_pairs(spark, monkeypatch):
    from clausework.functions import edits
    from clausework.operators import joins as J

    rng = random.Random(9)
    name = lambda: None if rng.random() < 0.05 else rng.choice(["part ", "port ", ""]) + "".join(rng.choice("abé中") for _ in range(rng.randint(0, 7)))
    docs = [(i, i % 4 if i % 13 else None, name()) for i in range(150)]
    registry = [(None if i == 7 else 900 - i, i % 3, name(), i % 3 == 2 or i % 5 == 0) for i in range(90)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    ratio = lambda a, b: -1.0 if a is None or b is None else round(1 - distance(a, b) / max(len(a), len(b), 1), 6)
    monkeypatch.setattr(J, "TITLE_BLOCK", 5)
    monkeypatch.setattr(J, "OFFICIAL_BLOCK", 4)
    monkeypatch.setattr(edits, "CELLS", 10)
    d = spark.createDataFrame(docs, "document_id long, number long, title string")
    r = spark.createDataFrame(registry, "registry_id long, number long, official_title string, is_amendment boolean")
    found = J.best_registry_match(d, r)
    got = {x["document_id"]: (x["registry_id"], x["similarity"]) for x in found.collect()}
    for i, number, title in docs:
        mine = [x for x in registry if x[1] == number]
        first = min((x[3] for x in mine), default=None)
        ranked = sorted((-ratio(title, x[2]), x[0] is None, x[0] or 0) for x in mine if x[3] == first)
        assert got[i] == ((None if ranked[0][1] else ranked[0][2], -ranked[0][0]) if ranked else (None, -1.0)), (i, number, title)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "levenshtein(title" not in plan.split("MapInArrow")[-1]


def test_leaves_are_made_once(spark):
    plan = Lv.branch_leaves(Lv.leaf_branches(spark.createDataFrame([unit(1, "clause", "x")], UNIT_SCHEMA)))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter")]
    assert filters and not any("source_unit_with_context" in line for line in filters)
