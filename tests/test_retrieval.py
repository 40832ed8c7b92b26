import math
import random
import re

import numpy as np

from clausework.operators import dense as D, dedup, fusion as X, joins as J, lexical as L


#: The weighted terms of each question, by hand.
TERMS = {
    "岩金矿床的勘查类型": {
        "岩金矿床的勘查类型": 2.2,
        "岩金矿床": 1.55, "金矿床的": 1.55, "矿床的勘": 1.55, "床的勘查": 1.55, "的勘查类": 1.55, "勘查类型": 1.55,
        "岩金矿": 1.0, "金矿床": 1.0, "矿床的": 1.0, "床的勘": 1.0, "的勘查": 1.0, "勘查类": 1.0, "查类型": 1.0,
        "岩金": 0.42, "金矿": 0.42, "矿床": 0.42, "床的": 0.42, "的勘": 0.42, "勘查": 0.42, "查类": 0.42, "类型": 0.42,
    },
    "gold grade 3.5": {"gold": 2.5, "grade": 2.5, "3.5": 2.5},
    "工程间距确定": {
        "工程间距确定": 2.2, "工程间距": 1.55, "程间距确": 1.55, "间距确定": 1.55,
        "工程间": 1.0, "程间距": 1.0, "间距确": 1.0, "距确定": 1.0, "工程": 0.42, "程间": 0.42, "间距": 0.42, "距确": 0.42, "确定": 0.42,
    },
    "old": {"old": 2.5},
}


def test_query_terms_by_hand(spark):
    asked = spark.createDataFrame(list(enumerate(TERMS)), "query_id int, question string")
    got = {}
    for r in L.query_terms(asked).collect():
        got.setdefault(list(TERMS)[r["query_id"]], {})[r["term"]] = r["weight"]
    assert got == TERMS


def brute_scores(q, units):
    terms = TERMS[q]
    rows = []
    for u in units:
        tf = {t: u[2].count(t) + 1.35 * u[3].count(t) + 0.62 * u[4].count(t) for t in terms}
        rows.append((u, {t: v for t, v in tf.items() if v > 0}))
    avg = sum(max(1, len(u[2])) for u in units) / len(units)
    out = {}
    for u, tf in rows:
        if tf:
            norm = 0.25 + 0.75 * max(1, len(u[2])) / avg
            s = sum(math.log(1 + (len(units) - df + 0.5) / (df + 0.5)) * v * 2.2 / (v + 1.2 * norm) * terms[t] for t, v in tf.items() for df in [sum(t in r[1] for r in rows)])
            out[(u[0], u[1])] = round(s + 0.18 * len(tf) / len(terms), 6)
    return out


UNITS = [
    (1, 1, "岩金矿床勘查类型划分", "5.1", "岩金规范"), (1, 2, "the gold ore grade 3.5 and gold", "", "岩金规范"), (2, 1, "工程间距的确定方法", "6.2", "铁矿规范"),
    (2, 2, "goldfield survey", "", "铁矿规范"), (3, 1, "无关内容", "", "其他"),
]
SCHEMA = "document_id long, unit_order long, search_text string, heading_text string, document_text string"


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "QUERY_BLOCK", 1)  # several blocks give the same result as one
    asked = [(1, "岩金矿床的勘查类型"), (2, "gold grade 3.5"), (3, "工程间距确定")]
    run = L.Lexical(spark.createDataFrame(asked, "query_id long, question string"), spark.createDataFrame(UNITS, SCHEMA))
    assert run.asked.select("block").distinct().count() > 1
    got = {}
    for r in run.first_stage().collect():
        got.setdefault(r["query_id"], {})[(r["document_id"], r["unit_order"])] = round(r["score"], 6)
    for query_id, text in asked:
        toks = {t for term in TERMS[text] for t in re.findall("[a-z0-9]{2,}", term)} | {c[i : i + n] for c in re.findall("[一-鿿]+", text) for n in (2, 3) for i in range(len(c) - n + 1)}
        index = lambda u: {t for c in re.findall("[一-鿿]+|[a-z0-9]+", " ".join(u[4:5] + u[3:4] + u[2:3])) for t in ([c] if c.isascii() else [c[i : i + n] for n in (2, 3) for i in range(len(c) - n + 1)])}
        kept = {t for term in TERMS[text] for c in [term] for t in ([x for x in re.findall("[a-z0-9]{2,}", c)] if c.isascii() else [c[i : i + n] for n in (2, 3) for i in range(len(c) - n + 1)])}
        scanned = [u for u in UNITS if index(u) & (kept & (toks | kept))]
        assert got[query_id] == brute_scores(text, scanned)


def test_query_without_candidates_scans_everything(spark):
    asked = spark.createDataFrame([(1, "old")], "query_id long, question string")  # inside "gold", but no token
    got = {(r["document_id"], r["unit_order"]): round(r["score"], 6) for r in L.Lexical(asked, spark.createDataFrame(UNITS, SCHEMA)).first_stage().collect()}
    assert got == brute_scores("old", UNITS) and len(got) == 2


def test_explicit_terms_with_blanks_count_in_the_whole_field(spark):
    units = spark.createDataFrame([(1, 1, "iron ore grade and iron ore", "", ""), (1, 2, "ore", "", "")], SCHEMA)
    asked = spark.createDataFrame([(1, "ore")], "query_id long, question string")
    explicit = spark.createDataFrame([(1, "(Iron ore)")], "query_id long, term string")
    got = {r["unit_order"]: r["matched_terms"] for r in L.Lexical(asked, units, explicit).first_stage().collect()}
    assert got == {1: 2, 2: 1}


def test_contains_join_is_exact(spark, monkeypatch):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))) for i in range(60)]
    pats = [(i, "".join(rng.choice("abc") for _ in range(rng.randint(2, 5)))) for i in range(40)]
    want = {(i, p) for i, t in texts for p, s in pats if s in t}
    left, right = spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(pats, "p int, pattern string")
    pats += [(100, "a"), (101, "c")]  # one character, on both sides of every limit
    want |= {(i, p) for i, t in texts for p, s in pats[-2:] if s in t}
    left, right = spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(pats, "p int, pattern string")
    for rules, grams in ((200, 5000), (1, 5000), (1, 1)):  # inside the row, pruned grams, all grams
        monkeypatch.setattr(J, "RULE_LIMIT", rules)
        monkeypatch.setattr(J, "GRAM_LIST_LIMIT", grams)
        assert {(r["i"], r["p"]) for r in J.contains_join(left, right).collect()} == want


def test_passage_join_is_exact(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(400)]
    texts = [(i, rng.choice([" ", "\n", "  "]).join(words[i * 8 : i * 8 + 40])) for i in range(40)]
    pats = []
    for i in range(60):
        t = rng.choice(texts)[1]
        lo = rng.randint(0, len(t) - 6)
        pats.append((i, t[lo : lo + rng.randint(3, 40)].strip() or "ab"))
    pats = [(i, p) for i, p in pats if len(p) >= 2]
    got = {(r["i"], r["p"]) for r in J.passage_join(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(pats, "p int, pattern string")).collect()}
    assert got == {(i, p) for i, t in texts for p, s in pats if s in t}


def test_passage_join_keeps_repeated_rows(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g h")] * 2, "i int, text string")
    for pattern in ("b c d e f g", "b c d"):
        assert J.passage_join(texts, spark.createDataFrame([(1, pattern)] * 3, "p int, pattern string")).count() == 6


def vectors(spark, n=200):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(n // 4, 64))
    rows = [(i, i % 7, (base[i % len(base)] + 0.3 * rng.normal(size=64)).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "unit_id long, document_id long, embedding array<float>")


def test_exact_knn_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "QUERY_BLOCK", 64)
    monkeypatch.setattr(D, "VECTOR_BLOCK", 50)
    rows, v = vectors(spark)
    m = np.array([np.array(r[2], dtype=np.float32).astype(float) for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    got = {(r["query_id"], r["rank"]): r["unit_id"] for r in D.exact_knn(v.selectExpr("unit_id as query_id", "embedding"), v, 5).collect()}
    for q in range(len(rows)):
        assert [got[(q, k)] for k in range(1, 6)] == sorted(range(len(rows)), key=lambda u: (-s[q, u], u))[:5]


def test_lsh_recall(spark):
    from clausework.operators import evaluation as E

    _, v = vectors(spark)
    q = v.selectExpr("unit_id as query_id", "embedding")
    row = E.recall_summary(E.recall_at_k(D.lsh_knn(q, v, 3, bucket=1.0), D.exact_knn(q, v, 3), 3)).first()
    assert row["mean_recall"] > 0.8


def test_mmr_trigger_and_effect(spark):
    rows = [(1, i, 1 if i < 4 else i, 1.0 - i / 100, i + 1) for i in range(6)]
    ranking = spark.createDataFrame(rows, "query_id long, unit_id long, document_id long, score double, rank long")
    v = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(6)]) for i in range(6)], "unit_id long, embedding array<double>")
    out = X.mmr(ranking, v).orderBy("mmr_rank").collect()
    assert out[0]["unit_id"] == 0 and out[0]["used"] and {r["unit_id"] for r in out[1:3]} == {4, 5}
    calm = X.mmr(ranking.withColumn("document_id", ranking["unit_id"]), v).orderBy("mmr_rank").collect()
    assert [r["unit_id"] for r in calm] == list(range(6)) and not calm[0]["used"]


def test_mmr_keeps_hits_after_the_pool_and_single_missing_vectors(spark):
    rows = [(1, i, 1 if i < 90 else i, 1.0 - i / 200, i + 1) for i in range(100)]
    ranking = spark.createDataFrame(rows, "query_id long, unit_id long, document_id long, score double, rank long")
    v = spark.createDataFrame([(i, [1.0 if j == i % 6 else 0.0 for j in range(6)]) for i in range(1, 100)], "unit_id long, embedding array<double>")
    out = X.mmr(ranking, v).orderBy("mmr_rank").collect()
    assert [r["mmr_rank"] for r in out] == list(range(1, 101)) and sorted(r["unit_id"] for r in out) == list(range(100))
    assert [r["unit_id"] for r in out[80:]] == list(range(80, 100)) and all(r["used"] for r in out)


def test_reserve_fill_keeps_order_and_reservations(spark):
    order = spark.createDataFrame([(1, i, i) for i in range(1, 31)], "query_id long, unit_id long, rank long")
    kept = X.reserve_fill(order, spark.createDataFrame([(1, 25), (1, 30)], "query_id long, unit_id long")).orderBy("pool_rank").collect()
    assert [r["unit_id"] for r in kept] == [*range(1, 19), 25, 30]


def test_ttl_chain_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(5)
        rows = [(rng.choice("ab"), rng.randint(0, 500)) for _ in range(120)]
        got = {(r["k"], r["at"]) for r in dedup.ttl_first_sightings(spark.createDataFrame(rows, "key string, at long"), "key", 50).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for k in "ab":
        until = -1
        for t in sorted(t for key, t in rows if key == k):
            if t >= until:
                want.add((k, t))
                until = t + 50
    assert got == want


def test_ttl_of_one_busy_key_over_many_blocks(spark):
    """Five keys, one with most rows; some times lie a time-to-live apart to the microsecond."""
    rng = random.Random(6)
    rows = [("busy", rng.randint(0, 4000)) for _ in range(3000)] + [(rng.choice("abcd"), 10 * rng.randint(0, 50)) for _ in range(300)] + [(None, 5), (None, 5)]
    for ttl in (1, 10, 700, 10_000):
        got = sorted((r["k"] or "", r["at"]) for r in dedup.ttl_first_sightings(spark.createDataFrame(rows, "key string, at long"), "key", ttl).collect())
        want = []
        for k in {k for k, _ in rows}:
            until = -1
            for t in sorted({t for key, t in rows if key == k}):
                if t >= until:
                    want.append((k or "", t))
                    until = t + ttl
        assert got == sorted(want)


def test_exit_times_equal_the_chain():
    rng = random.Random(7)
    for _ in range(200):
        at = np.array(sorted(rng.sample(range(60), rng.randint(1, 20))))
        breaks, exits = dedup.exit_times(at, 7)
        for entry in range(-1, 75):
            until = entry
            for t in at:
                if t >= until:
                    until = t + 7
            i = int((breaks < entry).sum())
            assert (exits[i] if i < len(exits) else entry) == until


def test_wide_rows_are_stored_in_small_row_groups(spark):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from clausework import scratch

    wide = spark.range(12, numPartitions=1).withColumn("x", F.expr("transform(sequence(1, 600000), i -> xxhash64(id, i))"))
    scratch.materialize(wide, "wide", **scratch.WIDE_ROWS)
    newest = max(glob.glob(f"{scratch.shared_folder(spark)}/wide-*/*.parquet".replace("file:", "")))
    groups = pq.ParquetFile(newest).metadata
    assert max(groups.row_group(i).total_byte_size for i in range(groups.num_row_groups)) < 40 << 20
