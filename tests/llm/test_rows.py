"""Operators that treat rows on their own: language id, personal data, encoding, media, sharding, token files."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from clausework.llm import queries
from tests.llm.helpers import AWKWARD, LONG, SCHEMA, SF_DIR, empty, stored_rows, table


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


# Language identification.


def test_language_query_is_right_on_held_out_documents(spark):
    out = by_id(queries.QUERIES["op1_langid"](spark, SF_DIR))
    rows = stored_rows()
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    held = [(out[i]["lang_pred"], lang) for i, _, lang, _ in rows if out[i]["held_out"]]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95


def test_language_query_equals_plain_naive_bayes(spark):
    """Counts, smoothing, priors and posteriors by dictionaries over the same buckets."""
    import math
    from collections import Counter

    from clausework.llm.langid import SMOOTHING, grams

    rows = stored_rows()
    counts, documents = {}, Counter()
    for i, text, lang, _ in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(grams(text or "").tolist())
            documents[lang] += 1
    totals = {k: sum(c.values()) + SMOOTHING * 2**15 for k, c in counts.items()}
    out = by_id(queries.QUERIES["op1_langid"](spark, SF_DIR))
    for i, text, *_ in rows:
        if text and any(map(str.isalpha, text)):
            joint = {k: math.log(documents[k] / sum(documents.values())) + sum(math.log((c[g] + SMOOTHING) / totals[k]) for g in grams(text).tolist()) for k, c in counts.items()}
            best = max(sorted(joint), key=joint.get)
            assert out[i]["lang_pred"] == best
            assert abs(out[i]["score"] - 1 / sum(math.exp(v - joint[best]) for v in joint.values())) < 2e-6


def test_language_ties_and_many_labels(spark):
    from clausework.llm.langid import bucket_bits, predict, train

    rows = [(i, "same words here", lang, "s", 15) for i, lang in enumerate(("b", "a") * 40)]
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    even = min(sum(r[2] == "a" for r in kept), sum(r[2] == "b" for r in kept))
    tied = [r for k in "ab" for r in [r for r in kept if r[2] == k][:even]]
    docs = spark.createDataFrame(tied, SCHEMA)
    assert {r["lang_pred"] for r in predict(docs, train(docs)).collect()} == {"a"}  # the first in code point order
    many = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * 9, f"l{i:03d}", "s", 9) for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    model = train(spark.createDataFrame(many, SCHEMA))
    assert len(model.labels) == len(many) > 256 and model.bits == bucket_bits(len(many)) == 14


def test_language_of_awkward_rows(spark):
    from clausework.llm.langid import predict, train

    model = train(table(spark))
    assert set(model.labels) <= {"en", "fr", "de"}
    rows = predict(table(spark), model).collect()
    assert len(rows) == len(AWKWARD)
    for r, (_, text, *_) in zip(rows, AWKWARD):
        has_letter = bool(text) and any(map(str.isalpha, text))
        assert (r["lang_pred"] == "und") == (not has_letter) and 0 <= r["score"] <= 1
    assert train(empty(spark)) is None
    assert predict(empty(spark), None).collect() == []
    assert {r["lang_pred"] for r in predict(table(spark), None).collect()} == {"und"}


def test_language_scores_do_not_depend_on_other_rows(spark):
    from clausework.llm.langid import predict, train

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = train(docs)
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs, model).collect()}
    other = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in predict(docs.repartition(7), model).collect()}
    assert one == other


# Personal data.

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    def checks(number):
        total = 0
        for place, c in enumerate(reversed(number)):
            value = int(c) * (1 + place % 2)
            total += value - 9 * (value > 9)
        return total % 10 == 0

    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and checks(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c", "@b.c a@ a@b a@b. x@a.b.", "a@b@c.de", "a@b.c@d.ef", "a@b.c.d-e%f@g.h", "..%+-@-.-", "é@b.co ä.b@c.d",
        "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "1.2.3", "001.002.0003.4 1.2.3.4.", "999999999.1.1.1",
        "4111111111111111", "4111-1111 1111-1111", "4111  1111", "41111111111111112222", "4111 1111 1111 1111 4111 1111 1111 1111", "0" * 16, "0" * 20,
        "+1 (555) 123-4567", "+1234567", "+12345678 +", "+1 2.3.4.5.6.7.8", "++1 222 333 44 ", "+1((((((((9", "+1 555 123 4567+1 555 123 4567", "",
    ],
)
def test_base_spans_match_plain_patterns(text):
    from clausework.llm.pii import base_spans

    assert base_spans(text) == plain_spans(text)


def test_base_spans_on_random_strings():
    from clausework.llm.pii import base_spans

    rng = np.random.default_rng(3)
    for alphabet in ("a1.@-", "0123 -", "+1(). -2", "12.", "ab@.%é 1"):
        for _ in range(400):
            text = "".join(rng.choice(list(alphabet), int(rng.integers(0, 40))))
            assert base_spans(text) == plain_spans(text), text


def test_base_spans_are_linear_on_long_runs():
    from clausework.llm.pii import base_spans

    for run in ("a" * 300_000, "1" * 100_000, "@" * 100_000, "a@" * 50_000, "1." * 100_000, "+1" * 100_000):
        base_spans(run)


def test_personal_data_query(spark):
    rows = queries.QUERIES["op3_pii"](spark, SF_DIR).collect()
    texts = {i: t or "" for i, t, *_ in stored_rows()}
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        spelled = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == sha(",".join(spelled).encode())
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert set(spelled) <= set(r["spans"].split(",")) or not spelled


def test_personal_data_of_awkward_rows(spark):
    from clausework.llm.pii import find_personal_data, train

    rows = find_personal_data(table(spark), None).collect()
    assert len(rows) == len(AWKWARD)
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert nine["pii"]["redacted"] == "mail [EMAIL] or [IP], card [CARD], call [PHONE]"
    assert all((r["pii"]["redacted"] is None) == (r["text"] is None) for r in rows)
    assert train(empty(spark)) is None and find_personal_data(empty(spark), None).collect() == []


def test_boosted_trees_add_other_spellings_and_leave_lookalikes():
    from clausework.llm.boosting import calibrate, fit
    from clausework.llm.pii import KINDS, Model, all_spans, labelled

    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        number = "".join(map(str, rng.integers(0, 10, 15)))
        card = next(number + str(d) for d in range(10) if plain_spans(number + str(d)))
        text = f"words of{i} some text u{i}@mail.example.org and 10.{i % 256}.3.4 then {card} or +1 ({100 + i}) 555-{1000 + i} more words"
        rows += labelled(text)
    x, y = np.array([r[0] for r in rows], float), np.array([r[2] for r in rows], float)
    trees = fit(x, y)
    model = Model(trees, *calibrate(trees.margin(x), y), (0.9,) * len(KINDS))
    found = all_spans(["write to joe [at] mail.example.org now", "build 2023.11.4000 of 12345678 items", "nothing here"], model)
    assert [s[0] for s in found[0][1]] == ["email"] and found[1][1] == [] and found[2] == ([], [])
    assert ((model.probability(x) > 0.5) == (y > 0)).mean() > 0.97


def test_candidates_between_base_spans_overlap():
    from clausework.llm.pii import base_spans, candidates

    for text, want in [("(030) 1234567 192.168.0.1", "(030) 1234567"), ("4111 1111 1111 1111 (030) 1234567 2024", "(030) 1234567"), ("joe [at] mail.example.org.uk", "joe [at] mail.example.org")]:
        base = base_spans(text)
        found = list(candidates(text, base))
        assert want in {text[a:b] for _, a, b in found} and len(set(found)) == len(found)
        assert not any(a < e and s < b for _, a, b in found for _, s, e in base)


def test_numbers_beside_base_spans_are_redacted():
    from clausework.llm.pii import KINDS, all_spans, redacted

    class Phones:
        trees, slope, offset = None, 1.0, 0.0
        thresholds = (1.1, 1.1, 1.1, 0.9)
        probability = staticmethod(lambda x: np.where((x[:, 0] == KINDS.index("phone")) & (x[:, 2] == 10) & (x[:, 10] > 0), 0.95, 0.1))

    text = "(030) 1234567 192.168.0.1"
    base, added = all_spans([text], Phones)[0]
    assert redacted(text, base + added) == "[PHONE] [IP]"


def test_rare_kinds_have_held_out_rows(spark):
    from clausework.llm.pii import KINDS, train, training_rows

    rng = np.random.default_rng(12)
    texts = [f"item {rng.integers(10**9, 10**10)} and {rng.integers(10**11, 10**12)} u{i}@mail.example.org 10.{i % 256}.3.4 +1 ({100 + i % 800}) 555-{1000 + i} end" for i in range(1500)]
    for i in (17, 800, 1300):
        texts[i] += " pay by card 4111 1111 1111 1111 now" if i == 17 else f" card {['5500 0000 0000 0004', '4012 8888 8888 1881'][i == 1300]} now"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, kind, y, held, weight = training_rows(docs, 100, 800)
    card = (kind == KINDS.index("card")) & (y == 1)
    assert (card & held).any() and (card & ~held).any() and len(y) <= 800
    assert all(((kind == k) & (y == 1) & held).any() for k in range(len(KINDS))) and weight[card].sum() == 6
    assert all(t <= 1 for t in train(docs, 100, 800).thresholds[:2])


def test_model_is_fitted_on_all_documents(spark, monkeypatch):
    """F16, F18: nothing is drawn; trees grown from sums in Spark are those of all rows, and thresholds those of all held-out rows."""
    from pyspark.sql import functions as F

    from clausework.llm import boosting, pii

    rng = np.random.default_rng(21)
    texts = [f"item {rng.integers(10**9, 10**10)} u{i % 90}@mail.example.org 10.{i % 256}.3.4 +1 ({100 + i % 800}) 555-{1000 + i % 300} card {rng.integers(10**15, 10**16)} end" for i in range(400)] + [None, "", "no numbers"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pii, "training_rows", None)
    model = pii.train(docs)
    rows = [r for t in texts if t for r in pii.labelled(t)]
    seen = []
    whole = pii.grown
    monkeypatch.setattr(pii, "grown", lambda df, share: seen.append(df) or whole(df, share))
    again = pii.train(docs)
    used = seen[0].select("x", "y", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).toPandas()
    x, y = np.array(used["x"].tolist()), used["y"].to_numpy(float)
    local = boosting.fit(x, y)
    assert 0.6 * len(rows) < len(x) < 0.95 * len(rows)
    assert (model.trees.features == again.trees.features).all() and model.thresholds == again.thresholds and (model.slope, model.offset) == (again.slope, again.offset)
    assert (model.trees.features == local.features).all() and np.allclose(model.trees.leaves, local.leaves, atol=1e-4)
    taken = {(*a, b) for a, b in zip(map(tuple, x), y)}
    held = [r for r in rows if (*map(float, r[0]), r[2]) not in taken]
    p = model.probability(np.array([r[0] for r in held], float))
    for k, cut in enumerate(model.thresholds):
        own = sorted(((q, r[2]) for q, r in zip(p, held) if r[1] == k), reverse=True)
        good = [q for q in {q for q, _ in own} if sum(y for v, y in own if v >= q) >= 0.995 * sum(v >= q for v, _ in own)]
        assert cut == (max(0.9, min(good)) if good else 1.1)


# Byte-pair encoding.


def plain_encoder():
    from clausework.llm.bpe import encoder

    return encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_every_vocabulary_entry_encodes_to_itself_by_merges():
    """The border rule of long pieces needs merges alone to reach every token."""
    tool = plain_encoder()
    ranks = {b: i for i, b in tool.bytes_of.items()}
    for i, token in tool.bytes_of.items():
        parts = [token[j : j + 1] for j in range(len(token))]
        while len(parts) > 1:
            pairs = [(ranks.get(a + b, 1 << 30), j) for j, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, j = min(pairs)
            if rank == 1 << 30:
                break
            parts[j : j + 2] = [parts[j] + parts[j + 1]]
        assert parts == [token], (i, token)


def test_tree_encoding_equals_whole_encoding(monkeypatch):
    from clausework.llm import bpe

    tool = plain_encoder()
    rng = np.random.default_rng(7)
    texts = ["", "a", " ", "'", "it's we'll they're 'tis don'", "  lead", "trail   ", "a\n\n\n  b", "ab" * 3000, " " * 3000 + "x", "日本語テキスト" * 400, "!!!'s" * 300, "1234567890" * 300, LONG[:20_000], "é" * 2500 + "'ll" + " \r\n" * 40]
    for alphabet in ("ab 's", "'rel vt", " \n\tx", "1a!'. é", "日a 1'"):
        texts += ["".join(rng.choice(list(alphabet), int(rng.integers(1, 300)))) for _ in range(60)]
    for leaf, long_piece in ((3, 8), (17, 32), (256, 64)):
        monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
        monkeypatch.setattr(bpe, "LONG_PIECE", long_piece)
        tool.cache.clear()
        for t in texts:
            ids = tool.encode_ids(t)
            assert ids.tolist() == tool.bpe.encode_ordinary(t), (leaf, t[:60])
            assert tool.decode(ids) == t.encode()


def test_bpe_query_and_awkward_rows(spark):
    from clausework.llm.bpe import encode_documents

    tool = plain_encoder()
    rows = queries.QUERIES["op6_bpe"](spark, SF_DIR).collect()
    texts = {i: t or "" for i, t, *_ in stored_rows()}
    for r in rows:
        ids = np.array(tool.bpe.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(ids.tobytes()), sha(texts[r["doc_id"]].encode()))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = encode_documents(table(spark), path, public_tokenizers.PATTERN).collect()
    assert [r["decoded_sha256"] for r in out] == [sha((t or "").encode()) for _, t, *_ in AWKWARD]
    assert encode_documents(empty(spark), path, public_tokenizers.PATTERN).collect() == []


# Token files.


def test_units_encode_as_whole_texts():
    from clausework.llm.token_files import encoder

    tool = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(11)
    texts = [t or "" for _, t, *_ in AWKWARD] + ["", " ", "a's b'll ", "x²y 3½4 a²,b", "l'été, c'est.", "a\xa0b \xa0 c ", "x\n\n y", "<|endoftext|>.", "a <|endoftext|> b<|endof", "ł, łódź."]
    for alphabet in ("ab ',.\n", "é1 .'s", " \t\r\nx,", "²3a. "):
        texts += ["".join(rng.choice(list(alphabet), int(rng.integers(1, 60)))) for _ in range(200)]
    want = [e.ids for e in tool.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, sizes = tool.ids(pa.array(texts))
    assert ids.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_token_files_query(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, at = by_id(queries.QUERIES["op8_token_files"](spark, SF_DIR)), 0
    for i, text in sorted((i, t) for i, t, *_ in stored_rows()):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_awkward_rows(spark, folder):
    from clausework.llm.token_files import checksums, read_tokens, write_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    write_tokens(table(spark), path, f"{folder}/tokens")
    rows = checksums(read_tokens(spark, f"{folder}/tokens")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in AWKWARD), key=lambda i: (i is not None, i or 0))
    assert rows[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    one = read_tokens(spark, f"{folder}/tokens").where("doc_id = 3").collect()
    assert [r["ids"] for r in one] == [[0]]
    write_tokens(empty(spark), path, f"{folder}/none")
    assert spark.read.schema("doc_id long, n_tokens long, first long, part long, ids array<int>").orc(f"{folder}/none").count() == 0


# Sharding.


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    rows = queries.QUERIES["op2_sharding"](spark, SF_DIR).collect()
    texts = {i: t or "" for i, t, *_ in stored_rows()}
    assert {r["law"] for r in rows} == {"key"} and {r["shard"] for r in rows} == set(range(8))
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["grown_shard"] in (r["shard"], 8)
    for shard in range(8):
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for _, i in own)


def test_shards_equal_a_plain_rendezvous(spark):
    import math

    def winner(key, shards):
        scores = []
        for shard in range(shards):
            digest = hashlib.md5(f"shard:{shard}:{key}".encode()).hexdigest()[:13]
            scores.append((-1.0 / math.log((int(digest, 16) + 0.5) / 16**13), -shard))
        return -max(scores)[1]

    for r in queries.QUERIES["op2_sharding"](spark, SF_DIR).collect():
        assert (r["shard"], r["grown_shard"]) == (winner(r["doc_id"], 8), winner(r["doc_id"], 9))


def test_sharding_by_weight_and_awkward_rows(spark):
    from pyspark.sql import functions as F

    from clausework.llm.sharding import rendezvous, shard_documents

    rows = shard_documents(table(spark), [1.0] * 3, [1.0] * 4).collect()
    assert len(rows) == len(AWKWARD) and sum(r["size"] for r in rows) == sum(len((t or "").encode()) + 1 for _, t, *_ in AWKWARD)
    for shard in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert shard_documents(empty(spark), [1.0], [1.0, 1.0]).collect() == []
    counts = spark.range(20_000).groupBy(rendezvous(F.col("id"), [1.0, 2.0, 5.0]).alias("s")).count().collect()
    share = {r["s"]: r["count"] / 20_000 for r in counts}
    assert all(abs(share[s] - w / 8) < 0.02 for s, w in enumerate((1, 2, 5)))
    with pytest.raises(ValueError):
        rendezvous(F.col("id"), [0.0])


# Media.


def test_media_query(spark):
    from clausework.llm.webp import payload

    out = by_id(queries.QUERIES["op10_webp"](spark, SF_DIR))
    for i, text, *_ in stored_rows():
        data = payload((text or "").encode())
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((text or "").encode()), len(data), sha(data), zlib.crc32(data[-64:]))
        assert r["media_bytes"] > 0 and len(r["feature"].split(",")) == 18


def test_media_of_awkward_rows(spark):
    from clausework.llm.webp import media_column, payload

    rows = media_column(table(spark)).collect()
    assert sorted(r["payload"] for r in rows) == sorted(payload((t or "").encode()) for _, t, *_ in AWKWARD)
    nines = [r for r in rows if r["doc_id"] == 9]
    assert nines[0] == nines[1]
    assert media_column(empty(spark)).collect() == []


def test_passes_of_the_fit_read_files_by_rows_not_by_shuffle_partitions(spark, monkeypatch):
    """op3_pii on check_h: with many shuffle partitions each of the passes opened as many small files."""
    from clausework.llm import pii

    docs = spark.createDataFrame([(i, f"item {10**9 + 7919 * i} u{i}@mail.example.org 10.{i % 256}.3.4 +1 ({100 + i % 800}) 555-{1000 + i} end") for i in range(300)], "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    stored, keep, grow = [], pii.materialize, pii.grow
    monkeypatch.setattr(pii, "grow", lambda *a: grow(*a, rounds=3))
    monkeypatch.setattr(pii, "materialize", lambda df, name: stored.append((name, out := keep(df, name))) or out)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        few = pii.train(docs)
        files = {name: len(df.inputFiles()) for name, df in stored}
        assert files["pii-rows"] > 8 and files["pii-bins"] == files["pii-held"] == 1
        stored.clear()
        monkeypatch.setattr(pii, "FILE_ROWS", 200)
        many = pii.train(docs)
        files = {name: len(df.inputFiles()) for name, df in stored}
        assert files["pii-bins"] > 4 and files["pii-held"] > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (few.trees.features == many.trees.features).all() and (few.trees.leaves == many.trees.leaves).all()
    assert (few.slope, few.offset, few.thresholds) == (many.slope, many.offset, many.thresholds)
