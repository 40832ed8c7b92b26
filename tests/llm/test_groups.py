"""Operators that compare rows: passages, quality, near duplicates, mixing, and the pipeline."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.llm import queries
from tests.llm.helpers import AWKWARD, SCHEMA, SF_DIR, empty, near_components, stored_rows, table, without_repeats, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# Repeated passages.


def test_passages_query(spark):
    out = {r["doc_id"]: r for r in queries.QUERIES["op4_passages"](spark, SF_DIR).collect()}
    rows = [(i, t) for i, t, *_ in stored_rows()]
    for i, kept in without_repeats(rows).items():
        n = len(words(dict(rows)[i]))
        assert (out[i]["n_words"], out[i]["n_removed"], out[i]["kept_sha256"]) == (n, n - len(kept), sha(" ".join(kept)))


def random_passages(seed):
    """Documents pasted together from few passages at every offset, with repeats inside a document."""
    rng = np.random.default_rng(seed)
    pool = [[f"p{k}w{i}" for i in range(int(rng.integers(15, 60)))] for k in range(6)] + [["same"] * 50]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            passage = pool[int(rng.integers(len(pool)))]
            a = int(rng.integers(0, len(passage) // 2))
            parts += passage[a : a + int(rng.integers(5, 60))] + [f"u{rng.integers(1 << 40)}" for _ in range(int(rng.integers(0, 3)))]
        texts.append(" ".join(parts))
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_match_brute_force(spark, seed):
    from clausework.llm.substring import remove_repeats

    texts = random_passages(seed)
    out = {r["doc_id"]: r["kept_text"] for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert out == {i: " ".join(k) for i, k in without_repeats(list(enumerate(texts))).items()}


def test_passages_of_awkward_rows(spark):
    from clausework.llm.substring import remove_repeats

    rows = remove_repeats(table(spark)).collect()
    assert len(rows) == len(AWKWARD)
    removed = defaultdict(list)
    for r in rows:
        removed[r["doc_id"]].append(r["n_removed"])
    assert removed[6] == [0] and removed[7] == [40] and removed[8] == [42]
    assert removed[None] == [0, 0] and removed[9] == [0, 0]
    assert remove_repeats(empty(spark)).collect() == []


# Quality rules.


def base_statistics(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def check_statistics(rows, texts):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in rows:
        want = base_statistics(texts[r["doc_id"]])
        assert tuple(r[n] for n in names) == want, r
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_query(spark):
    rows = queries.QUERIES["op5_quality"](spark, SF_DIR).collect()
    check_statistics(rows, {i: t for i, t, *_ in stored_rows()})


def test_quality_statistics_of_repeats(spark):
    from clausework.llm.quality import judge

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcd"), int(rng.integers(0, 60)))) + "\n" * int(rng.integers(0, 3)) + "x y\nx y\n\n x y" for _ in range(60)]
    texts += ["a b c d e a b c d e", "a b c d e f a b c d e", "a a a a a a", "\n \n\n", "one\n\none\none two"]
    check_statistics(judge(docs_of(spark, texts), ["doc_id"]).collect(), dict(enumerate(texts)))


def test_robust_estimate_rejects_symbol_soup_and_keeps_clean_documents(spark):
    from clausework.llm.quality import judge

    rng = np.random.default_rng(6)
    clean = [" ".join("".join(rng.choice(list("aeioustrn"), int(rng.integers(3, 8)))) for _ in range(int(rng.integers(30, 200)))) for _ in range(150)]
    dirty = [" ".join(w + "%$#" for w in t.split()) for t in clean[:30]]
    kept = {r["doc_id"]: r["kept"] for r in judge(docs_of(spark, clean + dirty), ["doc_id"]).collect()}
    assert all(kept[i] for i in range(150)) and not any(kept[i] for i in range(150, 180))


def test_each_statistic_alone_rejects_a_planted_outlier(spark, folder):
    from clausework.llm.stages import quality_rules

    rng = np.random.default_rng(7)
    clean = ["\n".join(" ".join("".join(rng.choice(list("aeioustrn"), int(rng.integers(3, 8)))) for _ in range(8)) for _ in range(int(rng.integers(20, 40)))) for _ in range(150)]
    phrase = "one two three four five"
    symbols = " ".join(w + "%$#" for w in clean[0].split())
    long_words = " ".join(w * 6 for w in clean[1].split())
    repeated = clean[2] + f"\n{phrase} once\n{phrase} twice\n{phrase} thrice\n{phrase} again\n{phrase} still\n{phrase} more\n{phrase} here"
    lines = "\n".join(f"{line}\nMenu" for line in (clean[3] + "\n" + clean[4]).split("\n"))
    docs = docs_of(spark, [*clean, symbols, long_words, repeated, lines])
    kept = {r["doc_id"] for r in quality_rules(spark, docs, SF_DIR).collect()}
    assert kept == set(range(150))
    assert check_against_sql(spark, [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in docs.collect()], folder) == kept
    from clausework.llm.quality import judge

    last = {r["doc_id"]: r for r in judge(docs, ["doc_id"]).where("doc_id >= 150").collect()}
    assert not any(r["base_failed"] for r in last.values())
    assert [[last[i][c] > 0 for c in ("n_symbols", "n_repeat_words", "n_dup_lines")] for i in range(150, 154)] == [[True, False, False], [False, False, False], [False, True, False], [False, False, True]]


def check_against_sql(spark, rows, folder):
    """op5_quality over ``rows`` equals its SQL; the ids it keeps."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tests.oracle_check import compare, duck

    pq.write_table(pa.table(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), zip(*rows)))), f"{folder}/documents.parquet")
    ok, message = compare(queries.QUERIES["op5_quality"](spark, folder), duck(folder), queries.ORACLE_SQL["op5_quality"])
    assert ok, message
    return {r["doc_id"] for r in queries.QUERIES["op5_quality"](spark, folder).where("kept").collect()}


def test_rare_pairs_are_judged_beside_large_cells(spark, folder):
    rng = np.random.default_rng(9)
    clean = [" ".join("".join(rng.choice(list("aeioustrn"), int(rng.integers(3, 8)))) for _ in range(int(rng.integers(30, 200)))) for _ in range(130)]
    soup = [" ".join(w + "%$#" for w in t.split()) for t in clean[:24]]
    places = [("en", "s"), ("fr", "s")]
    rows = [(i, t, *places[i % 2], len(t)) for i, t in enumerate(clean[:120])]
    rare = [("en", "rare"), (None, None), ("xx", "s")]
    rows += [(200 + i, t, *rare[i % 3], len(t)) for i, t in enumerate(clean[120:])]
    rows += [(300 + i, t, *rare[i % 3], len(t)) for i, t in enumerate(soup)]
    docs = spark.createDataFrame(rows, SCHEMA)
    from clausework.llm import quality

    got = quality.judge(docs, ["doc_id"]).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == {r[0] for r in rows if r[0] < 300} and all(r["distance"] is not None for r in got)
    assert check_against_sql(spark, rows, folder) == {r[0] for r in rows if r[0] < 300}
    named = {(r["lang"], r["source"]): (r["cell"], set(r["points"])) for r in quality.cells(docs, 50).collect()}
    en, whole = '{"level":4,"lang":"en"}', '{"level":5}'
    assert named[("en", "rare")] == (en, {en, whole}) and named[("xx", "s")] == named[(None, None)] == (whole, {whole})
    assert named[("en", "s")][1] == {named[("en", "s")][0], en, whole} and named[("fr", "s")][1] == {named[("fr", "s")][0], whole}


def test_estimate_equals_plain_concentration_steps(spark):
    from clausework.llm import quality

    rng = np.random.default_rng(8)
    x = np.rint(rng.multivariate_normal([0, 0, 0, 0], 1e5 * (np.eye(4) + 0.3), 400) + np.r_[np.zeros((300, 4)), np.full((100, 4), 5000)]).astype(int)
    points = spark.createDataFrame([("c", *map(int, r)) for r in x], "cell string, x0 long, x1 long, x2 long, x3 long")
    got = quality.minimum_determinant(points).collect()[0]
    centre, cov = np.sort(x, axis=0)[199].astype(float), np.diag((1000 * np.array(quality.FLOORS)) ** 2)
    for _ in range(quality.C_STEPS):
        d = np.einsum("ij,ij->i", (x - centre) @ np.linalg.inv(cov), x - centre)
        bins = np.floor(np.log1p(d) * 1000)
        own = x[bins <= np.sort(bins)[299]]
        centre, cov = own.mean(axis=0), quality.CONSISTENCY * np.cov(own.T, bias=True) + np.diag((1000 * np.array(quality.FLOORS)) ** 2)
    assert np.allclose([got[f"m{i}"] for i in range(4)], centre)
    assert np.allclose([got[f"l{i}{j}"] for i in range(4) for j in range(i + 1)], np.linalg.cholesky(cov)[np.tril_indices(4)])
    assert np.abs(centre).max() < 200


def test_quality_of_awkward_rows(spark):
    from clausework.llm.quality import judge

    rows = judge(table(spark), ["doc_id", "size"]).collect()
    assert len(rows) == len(AWKWARD) and {r["size"] for r in rows} == {"extra size"}
    assert all(not r["kept"] for r in rows if r["n_words"] < 10) and judge(empty(spark), ["doc_id"]).collect() == []


# Near duplicates.


def variants(seed, n=60):
    """Copies of a few texts with some words changed, around the threshold on both sides."""
    rng = np.random.default_rng(seed)
    texts = []
    for k in range(5):
        base = [f"b{k}w{i}" for i in range(120)]
        for _ in range(n // 5):
            own = list(base)
            for at in rng.integers(0, 120, int(rng.integers(0, 9))):
                own[at] = f"v{rng.integers(1 << 40)}"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, small):
    from clausework.llm import neardup

    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    texts = variants(small) + ["", "one two", "one two", "ONE two", "one two three four five"]
    rows = neardup.near_duplicates(docs_of(spark, texts)).collect()
    want = near_components(list(enumerate(texts)))
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_query(spark):
    rows = queries.QUERIES["op7_near_duplicates"](spark, SF_DIR).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == near_components([(i, t) for i, t, *_ in stored_rows()])


def test_estimates_follow_similarity():
    from clausework.llm import neardup

    rng = np.random.default_rng(9)
    for share in (0.5, 0.8, 0.95):
        n = 4000
        common = int(2 * n * share / (1 + share))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:common], pool[n : 2 * n - common]])
        x, y = (neardup.packed(neardup.minima(s, neardup._WIDE_KEYS)) for s in (a, b))
        d = x ^ y
        differing = int(np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
        assert abs(((1 - differing / neardup.WIDE) - 0.25) / 0.75 - share) < 0.05


def test_components_of_a_long_chain(spark):
    from clausework.llm.neardup import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges, "test-chain").collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == 100


def test_near_duplicates_of_awkward_rows(spark):
    from clausework.llm.neardup import first_documents, near_duplicates

    rows = near_duplicates(table(spark)).collect()
    assert len(rows) == len(AWKWARD)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert by[8][0]["component_id"] == 6 and by[2][0]["n_shingles"] == by[3][0]["n_shingles"] == 0 and by[2][0]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    kept = first_documents(table(spark))
    assert kept.columns == table(spark).columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 9: 1, 10: 1, None: 2, **({7: 1} if by[7][0]["component_id"] == 7 else {})}
    assert near_duplicates(empty(spark)).collect() == [] and first_documents(empty(spark)).collect() == []


# Mixing.


def level_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by handing the excess of capped sources on, until none is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, open_sources = share * sum(sizes.values()), {}, set(order)
    while open_sources:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_sources)
        above = {s for s in open_sources if level * weight[s] > cap * sizes[s]}
        if not above:
            target.update({s: level * weight[s] for s in open_sources})
            break
        target.update({s: cap * sizes[s] for s in above})
        open_sources -= above
    return target


def test_mixing_query(spark):
    rows = queries.QUERIES["op9_mixing"](spark, SF_DIR).collect()
    again = queries.QUERIES["op9_mixing"](spark, SF_DIR).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {i: s for i, _, _, s in stored_rows()}
    size = {i: len(words(t)) for i, t, *_ in stored_rows()}
    totals, taken, longest = Counter(), Counter(), Counter()
    for r in rows:
        s = source[r["doc_id"]]
        totals[s] += r["size"]
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
        assert r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"])
    target = level_targets(dict(totals))
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == totals[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
    assert all(abs(taken[s] - target[s]) <= longest[s] + 1 for s in totals)


def test_mixing_awkward_rows(spark):
    from clausework.llm.mixing import mix, mixed_documents

    rows = mix(table(spark)).collect()
    assert sum(r["n_rows"] for r in rows) == len(AWKWARD)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    out = mixed_documents(table(spark))
    assert out.columns == table(spark).columns
    copies = Counter(r["doc_id"] for r in out.collect())
    for r in rows:
        if r["size"] and r["doc_id"] is not None:
            assert copies[r["doc_id"]] == r["taken"] // r["size"] * r["n_rows"]
    assert mix(empty(spark)).collect() == [] and mixed_documents(empty(spark)).collect() == []


# Pipeline.


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline
    from clausework.llm import quality

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixed_sources", "token_ids"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        if name != "token_ids":
            assert out.dtypes == docs.dtypes
        seen[name] = [r.asDict() for r in out.collect()]
        docs = spark.createDataFrame([tuple(r.values()) for r in seen[name]], out.schema)
    first = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge(first, ["doc_id"]).collect()}
    assert {r["doc_id"] for r in seen["quality_rules"]} == {i for i, k in verdict.items() if k}
    groups = near_components([(r["doc_id"], r["text"]) for r in seen["quality_rules"]])
    assert {r["doc_id"] for r in seen["near_duplicates"]} == set(groups.values())
    assert len(seen["personal_data"]) == len(seen["near_duplicates"]) and not any("@mail" in r["text"] for r in seen["personal_data"])
    assert all(r["n_chars"] == len(r["text"]) for r in seen["personal_data"])
    assert set(Counter(r["doc_id"] for r in seen["mixed_sources"]).values()) <= {1, 2}
    assert [r["decoded_sha256"] for r in sorted(seen["token_ids"], key=lambda r: r["doc_id"])] == [sha(r["text"]) for r in sorted(seen["mixed_sources"], key=lambda r: r["doc_id"])]
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in seen["token_ids"])


def test_pipeline_stages_on_awkward_and_empty_tables(spark):
    import corpus_pipeline

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (table(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            rows = out.collect()
            if name == "token_ids":
                assert len(rows) == docs.count()
            else:
                assert out.columns == columns
            assert rows or docs.isEmpty()


def test_registered_queries_are_part_of_the_entry():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert F.lit is not None
