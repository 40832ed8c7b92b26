"""Brute-force versions and awkward rows that the operators are tested with."""

from __future__ import annotations

import re

import pyarrow.parquet as pq

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(40))

#: Nulls in every column, empty and blank texts, a very long one, copies, repeated rows and ids.
AWKWARD = [
    (1, "Plain words of an ordinary document that says nothing twice at all.", "en", "a", 66),
    (2, None, "en", "a", None),
    (3, "", None, "a", 0),
    (4, " \t\n ", "en", None, 4),
    (5, LONG, "en", "b", len(LONG)),
    (6, "one " + PASSAGE + " end", None, None, None),
    (7, "two " + PASSAGE + " stop", "fr", "b", 9),
    (8, "one " + PASSAGE + " end", "fr", "b", 9),
    (9, "mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 123-4567", "en", "a", 70),
    (9, "mail a.b@c.org or 10.0.0.1, card 4111 1111 1111 1111, call +1 (555) 123-4567", "en", "a", 70),
    (10, "ünïcode 日本語 \U0001f600 <|endoftext|> a  b\r\n\tc\x1cd", "de", "b", 30),
    (None, "a row without an id " + PASSAGE, "en", "a", 20),
    (None, None, None, None, None),
]


def table(spark, rows=AWKWARD):
    """The rows with extra columns whose names clash with those the operators use inside."""
    from pyspark.sql import functions as F

    names = ("size", "words", "shard", "stats", "pii", "node", "taken", "ids", "before", "_key", "kept", "x0", "cell", "component", "spans")
    return spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(f"extra {n}") for n in names})


def empty(spark):
    return table(spark, [])


def stored_rows(columns=("doc_id", "text", "lang", "source")):
    return [tuple(r.values()) for r in pq.read_table(f"{SF_DIR}/documents.parquet", columns=list(columns)).to_pylist()]


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def near_components(rows):
    """Smallest linked id of each id, by comparing every pair."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def without_repeats(rows):
    """Kept words of each id, ids in ascending order."""
    seen, kept = set(), {}
    for i, text in sorted(rows):
        w = words(text)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        kept[i] = [x for x, g in zip(w, gone) if not g]
    return kept
