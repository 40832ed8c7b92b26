"""The transducer lexicon against the tokenizers library, and phrase counts and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from clausework.llm import lexicon as L, phrases as P, pretokens, queries, rtree
from tests.llm.helpers import AWKWARD, SF_DIR, empty, stored_rows, table

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = list("aZsdtmrevl'  \n\t'.,19é日\U0001f600\x1c　Ᲊ") + ["'re", "'s", "'ll", "<|endoftext|>", "<|endof", "text|>", " '", "the", "tion"]


def random_texts(seed, count, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(count)]


@pytest.mark.parametrize("words", [[], [b"the", b" the", b"tion", b"s", b"'s", b"a", b"ab", b"b"]])
def test_ids_and_texts_equal_the_library(words):
    """Whatever the lexicon holds; long matches go through the queue."""
    library, tool = Tokenizer.from_file(PATH), L.merger(PATH)
    texts = random_texts(5, 4000) + ["ab" * 3000, "x" * 1000, "é" * 300, "aaab" * 200, ""]
    coded = L.encode_texts(pa.array(texts), PATH, L.compile_lexicon(words, tool))
    want = library.encode_batch(texts, add_special_tokens=False)
    assert coded.ids.tolist() == [i for w in want for i in w.ids]
    assert coded.sizes.tolist() == [len(w.ids) for w in want]
    assert L.decode_ids(coded.ids, coded.sizes, PATH) == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_decoding_replaces_what_is_not_utf8():
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    runs = [[rng.randrange(50257) for _ in range(8)] for _ in range(300)]
    got = L.decode_ids(np.array(sum(runs, [])), np.full(len(runs), 8), PATH)
    assert got == [library.decode(r, skip_special_tokens=False) for r in runs]


def test_every_character_class_equals_the_library():
    classes = pretokens.character_classes(PATH)
    cut = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    rng = random.Random(9)
    points = [c for c in rng.sample(range(0x110000), 20_000) if not 0xD800 <= c < 0xE000] + list(range(0x3000))
    text = "".join(f"a{chr(c)}\n" for c in points)
    joined = {a // 3 for _, (a, b) in cut(text) if b - a == 2 and a % 3 == 0}
    assert joined == {i for i, c in enumerate(points) if classes[c] == pretokens.LETTER}


def test_automaton_is_minimal_and_numbers_words():
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    moves, final = L.minimal_automaton(words)
    rights = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            rights[w[:i]].add(w[i:])
    reached, todo = {0}, [0]
    while todo:
        for t in moves[todo.pop()].values():
            if t not in reached:
                reached.add(t)
                todo.append(t)
    assert len(reached) == len({frozenset(r) for r in rights.values()})
    lexicon = L.compile_lexicon(words, L.merger(PATH))
    asked = words + [b"zz", b"abcabcabc", b"aaaaaaaaaaaaaaaaaaaa"]
    sizes = np.array(list(map(len, asked)))
    data = np.frombuffer(b"".join(asked), np.uint8)
    got = lexicon.words_of(data, np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [words.index(w) if w in words else -1 for w in asked]


def digest_rows(rows):
    library = Tokenizer.from_file(PATH)
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        yield (key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_lexicon_query_equals_the_library(spark):
    got = [tuple(r) for r in queries.QUERIES["op11_lexicon"](spark, SF_DIR).collect()]
    assert sorted(got) == sorted(digest_rows(stored_rows(("doc_id", "text"))))


def test_lexicon_on_awkward_rows(spark):
    rows = L.encode_documents(table(spark), PATH, words=50).drop("ids").collect()
    assert Counter(map(tuple, rows)) == Counter(digest_rows((r[0], r[1]) for r in AWKWARD))
    assert L.encode_documents(empty(spark), PATH).collect() == []


def test_lexicon_counts_the_words_of_all_texts(spark):
    """every text is counted, not a draw of some 20,000."""
    words = ["".join(p) for p in itertools.product("abcd", repeat=3)]
    docs = spark.createDataFrame([(w,) for w in words], "text string").crossJoin(spark.range(500))
    assert sorted(L.frequent_words(docs, PATH)) == sorted(w.encode() for w in words)


# Phrases.


def brute_phrases(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, grams in counts.items():
        held = {g: c for g, c in grams.items() if c >= least}
        found = []
        for g, a in held.items():
            inside = lambda o: any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1))
            if len(g) < 2 or any(len(o) > len(g) and c >= a and inside(o) for o, c in held.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (held[g[:k]] * held[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), held[g[:k]], held[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows(seed=4):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "Cc", "dé", "e日", "f\x0bg", "h i", "j"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", "!"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    return [(t, rng.choice(["en", "fr", None, "und"])) for t in texts] + [(None, "en"), ("", None), (None, None), ("x y z . " * 3000, "de")]


@pytest.mark.parametrize("least,top", [(3, 2000), (2, 7)])
def test_phrases_equal_brute_force(spark, least, top):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = sorted(tuple(r) for r in P.collocations(docs, least, top).collect())
    assert got == brute_phrases(rows, least, top)


def test_phrases_on_awkward_rows(spark):
    assert sorted(map(tuple, P.collocations(table(spark), 2).collect())) == brute_phrases([(r[1], r[2]) for r in AWKWARD], 2, 2000)
    assert P.collocations(empty(spark), 2).collect() == []


def test_shared_fingerprints_are_counted_by_text(monkeypatch):
    """With fingerprints of two bits every slice has collisions; counts stay those of the text."""
    texts = ["a b c a b", "b a. c c a b", "a b"]
    monkeypatch.setattr(P, "mix", lambda x: x & np.uint64(3))
    words = P.Words(pa.array(texts), pa.array(["en", "fr", "en"]))
    got = Counter()
    for n in (1, 2, 3):
        at, prints = words.grams(n)
        for lang, phrase, times in words.counted(at, prints, n):
            got[words.langs[lang], phrase] += times
    want = Counter()
    for text, lang in zip(texts, ("en", "fr", "en")):
        for piece in text.split("."):
            w = piece.split()
            want.update((lang, " ".join(w[i : i + n])) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert got == want


def test_window_hashes_equal_horner(monkeypatch):
    monkeypatch.setattr(P, "WINDOWS", 9)
    rng = np.random.default_rng(0)
    values = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    starts = np.arange(40)
    got = P.window_hashes(values, P.WORD_BASE, starts, starts + 7)
    for s in range(40):
        h = 0
        for v in values[s : s + 7].tolist():
            h = (h * P.WORD_BASE + v + 1) % (1 << 64)
        assert h * P.WORD_BASE % (1 << 64) == int(got[s])


# Hard negatives.


def brute_negatives(rows, every=100, scale=256):
    import math

    usable = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(float(np.float32(x)) * scale) for x in v]
        if sum(x * x for x in w) < 2**62:
            usable[vec_id] = min(usable.get(vec_id, (label, w)), (label, w))
    dims = max((len(w) for _, w in usable.values()), default=0)
    full = {i: (l, w + [0] * (dims - len(w))) for i, (l, w) in usable.items()}
    out = []
    for a, (label, v) in full.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, l == label) for i, (l, w) in full.items() if i != a)
        for s, p, _ in [x for x in scores if x[2]][:5]:
            fits = [x for x in scores if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(fits)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def vector_rows(seed, count, dims=6):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.integers(-4, 5, dims) / 8]) for i in range(count)]
    return rows + [(count + i, 1, [0.5] * dims) for i in range(count // 3)]  # one vector holds a quarter of the rows


@pytest.mark.parametrize("every,tile", [(10, 64), (1, 50), (7, 8192)])
def test_hard_negatives_equal_brute_force(spark, every, tile):
    rows = vector_rows(every, 300)
    got = sorted(map(tuple, rtree.hard_negatives(vectors(spark, rows), every=every, tile_rows=tile).collect()))
    assert got == brute_negatives(rows, every)


def test_hard_negatives_on_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0]), (0, None, [1.0]), (1, 1, None), (2, 1, [1.0, None]), (3, 1, [nan]), (4, 2, [inf]), (5, 2, [-inf]), (6, 3, []), (8, 2, [0.5]), (9, 2, [0.25, 0.5, 1.0] * 5)]
    odd += [(10, 1, [0.5, 0.5]), (10, 2, [0.5, 0.25]), (10, 1, [0.5, 0.5]), (12, 1, [1e30]), (14, 2, [4e6] * 3), (16, 1, [4e6] * 3), (18, 1, [4e6, 3.9e6, 4e6]), (20, 2, [3.9e6] * 3), (-2, 1, [-0.001])]
    rows = vector_rows(3, 30) + [((None if i is None else i + 100), *r) for i, *r in odd]
    frame = vectors(spark, rows).selectExpr("*", "'extra' as tile", "'extra' as ids", "'extra' as low", "'extra' as anchor_id")
    assert sorted(map(tuple, rtree.hard_negatives(frame, every=2, tile_rows=16).collect())) == brute_negatives(rows, 2)
    assert rtree.hard_negatives(vectors(spark, [])).collect() == []
    assert rtree.hard_negatives(vectors(spark, [(0, 1, []), (100, 1, []), (200, 2, [])])).collect() == [(0, 100, 1, 200, 0, 0), (100, 0, 1, 200, 0, 0)]


def test_queue_prunes_nodes_that_cannot_win():
    """Far clusters are never scored, and boxes bound every score inside them."""
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.integers(-3, 4, (200, 4)) + 100 * np.eye(4, dtype=int)[i] for i in range(4)])
    labels, ids = np.arange(800) % 2, np.arange(800)
    leaves = []
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        leaves += [own[p] for p in rtree.str_order(rows[own], ids[own], 25, [0, 1, 2])]
    order = np.concatenate(leaves)
    assert sorted(order.tolist()) == ids.tolist() and max(map(len, leaves)) <= 25
    tree = rtree.Tree(ids[order], labels[order], rows[order], np.r_[0, np.cumsum(list(map(len, leaves)))])
    touched = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                touched.append(key.stop - key.start)
            return super().__getitem__(key)

    tree.ids = tree.ids.view(Watched)
    jobs = rtree.Jobs(np.zeros(1, int), np.array([rtree.LOWEST]), np.array([rtree.HIGHEST]))
    job, row, score = rtree.search(tree, rows[:1], ids[:1], labels[:1], jobs, True, 5)
    want = sorted((-int(rows[0] @ rows[i]), i) for i in range(800) if i and labels[i] == labels[0])[:5]
    assert [(-int(s), int(tree.ids[r])) for s, r in zip(score, row)] == want
    assert sum(touched) <= 200  # the other three clusters of the label stay unread
