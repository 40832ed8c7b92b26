"""Near-duplicate groups: b-bit MinHash signatures, band candidates, exact confirmation, components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausework.llm.common import lists, map_rows, materialize

SHINGLE = 4
HASHES, BAND_ROWS, BITS = 128, 4, 2
BANDS = HASHES // BAND_ROWS
WORDS = HASHES * BITS // 64
#: Pairs are linked from this Jaccard similarity on, in hundredths.
LINK = 80
#: Estimates this far below cannot belong to a link: six standard deviations at 0.8 with 128 hashes of two bits.
LEAST_ESTIMATE = 0.55
STAR_ROUNDS = 1
#: Wide sketches for large divided bands: 2048 hashes put 5.5 standard deviations at 0.058.
WIDE, LEAST_WIDE = 2048, 0.742
SMALL, BLOCK = 16, 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEYS, _WIDE_KEYS = (_scramble(np.arange(1, n + 1, dtype=np.uint64) * _MIX) | np.uint64(1) for n in (HASHES, WIDE))


def word_hashes(text: str = "text") -> Column:
    """64-bit hashes of the words of a text, A to Z lower-cased; empty for null."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.regexp_extract_all(plain, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the four-word shingles; a shorter sequence is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(SHINGLE, len(words))
    mixed = np.full(len(words) - size + 1, np.uint64(size))
    for i in range(size):
        mixed = _scramble(mixed * _MIX + words[i : len(words) - size + 1 + i])
    return np.unique(mixed)


def minima(shingles: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The least value of the hash function of each key, in blocks of shingles."""
    low, step = np.full(len(keys), np.iinfo(np.uint64).max, np.uint64), (1 << 19) // len(keys)
    for i in range(0, len(shingles), step):
        mixed = shingles[i : i + step, None] * keys
        np.minimum(low, (mixed ^ (mixed >> np.uint64(29))).min(axis=0), out=low)
    return low * _MIX


def packed(low: np.ndarray) -> np.ndarray:
    """The two top bits of each scrambled minimum, packed into 64-bit words."""
    bits = (low >> np.uint64(64 - BITS)).reshape(-1, 64 // BITS)
    return (bits << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, BAND_ROWS)
    mixed = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(BAND_ROWS):
        mixed = _scramble(mixed * _MIX + rows[:, i])
    return mixed


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), set_key (digest of the shingle set), n_shingles, sig (packed bits) and bands of every row."""

    def run(batch):
        words = batch.column("words")
        ends, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False).view(np.uint64)
        keys, sizes, sigs, bands = [], [], [], []
        for a, b in zip(ends[:-1], ends[1:]):
            shingles = shingle_set(flat[a:b])
            sizes.append(len(shingles))
            if len(shingles):
                low = minima(shingles, _KEYS)
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest())
                sigs.append(packed(low)), bands.append(band_keys(low))
            else:
                keys.append(None), sigs.append(np.zeros(0, np.uint64)), bands.append(np.zeros(0, np.uint64))
        flatten = lambda rows: lists(np.r_[0, np.cumsum([len(r) for r in rows])], np.concatenate(rows).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), flatten(sigs), flatten(bands)], names=["doc_id", "text_key", "set_key", "n_shingles", "sig", "bands"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_hashes().alias("words"))
    kind = dict(docs.dtypes)["doc_id"]
    return map_rows(rows, "words", run, f"doc_id {kind}, text_key long, set_key string, n_shingles long, sig array<long>, bands array<long>", 1 << 19)


def estimate(a: str, b: str) -> Column:
    """Similarity from equal low bits, corrected for the quarter of unequal minima whose two bits agree."""
    differing = F.lit(0)
    for i in range(WORDS):
        x = F.col(f"{a}.sig")[i].bitwiseXOR(F.col(f"{b}.sig")[i])
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differing = differing + F.bit_count(either)
    chance = 1.0 / (1 << BITS)
    return ((1 - differing / HASHES) - chance) / (1 - chance)


def _fitting() -> Column:
    """Sizes that a link allows, and an estimate that is not too far below one, for rows aliased a and b."""
    a, b = F.col("a.n_shingles"), F.col("b.n_shingles")
    return (100 * a >= LINK * b) & (100 * b >= LINK * a) & (estimate("a", "b") >= LEAST_ESTIMATE)


def _plausible(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and signatures leave possible."""
    both = pairs.join(first.alias("a"), F.col("a") == F.col("a.node")).join(first.alias("b"), F.col("b") == F.col("b.node"))
    return both.where(_fitting()).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, set): the full shingle sets of the given documents, made from their texts once more and stored."""

    def run(batch):
        words = batch.column("words")
        ends, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False).view(np.uint64)
        rows = [shingle_set(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        sets = lists(np.r_[0, np.cumsum([len(r) for r in rows])], np.concatenate(rows).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "set"])

    needed = docs.select(F.col("doc_id").alias("node"), "text").join(nodes, "node", "left_semi").select("node", word_hashes().alias("words"))
    kind = dict(docs.dtypes)["doc_id"]
    return materialize(map_rows(needed, "words", run, f"node {kind}, set array<long>", 1 << 19), "neardup-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    counted = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return counted.where(100 * F.col("common") >= LINK * (F.col("total") - F.col("common"))).select("a", "b").distinct()


def _open_bands(members: DataFrame, found: DataFrame) -> DataFrame:
    """(band, node, component, n) of the bands of three or more documents that hold more than one component."""
    tagged = members.select("band", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = tagged.groupBy("band").agg(F.min("component").alias("_c"), F.max("component").alias("_d"), F.count("*").alias("_n")).where("_d > _c and _n > 2").select("band", F.col("_n").alias("n"))
    return materialize(tagged.join(split, "band"), "neardup-open")


def _star_pairs(opened: DataFrame, turn: int) -> DataFrame:
    """Each open band's documents with one of them, drawn by hash, where their components differ."""
    drawn = F.xxhash64(F.lit(turn), "node")
    leaders = opened.groupBy("band").agg(F.min(drawn).alias("_draw"))
    leaders = opened.withColumn("_draw", drawn).join(leaders, ["band", "_draw"]).select("band", F.col("node").alias("leader"), F.col("component").alias("_c"))
    apart = opened.join(leaders, "band").where("component <> _c")
    return apart.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _small_pairs(opened: DataFrame, first: DataFrame) -> DataFrame:
    """All possible pairs between components in bands of at most ``SMALL`` documents."""
    rows = opened.where(F.col("n") <= SMALL).select("band", "node", "component").join(first, "node")
    apart = (F.col("a.band") == F.col("b.band")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component"))
    return rows.alias("a").join(rows.alias("b"), apart & _fitting()).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def _wide_sketches(sets: DataFrame) -> DataFrame:
    """(node, size, wide): 2048 hashes of two bits, which tell 0.8 from 0.7 for sure."""

    def run(batch):
        column = batch.column("set")
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
        rows = [packed(minima(flat[a:b], _WIDE_KEYS)).view(np.int64) for a, b in zip(ends[:-1], ends[1:])]
        wide = lists(np.arange(len(rows) + 1) * (WIDE * BITS // 64), np.concatenate(rows))
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(ends).astype(np.int64)), wide], names=["node", "size", "wide"])

    return map_rows(sets, "set", run, f"node {dict(sets.dtypes)['node']}, size long, wide array<long>", 1 << 19)


def _block_pairs(opened: DataFrame, sets: DataFrame, bands: DataFrame) -> DataFrame:
    """Likely pairs between components in larger bands, which are compared block by block.

    A band's documents fall into blocks of about ``BLOCK`` by hash; each two blocks meet in one group of
    bounded size, where wide sketches are compared by bit counts. Only pairs whose estimate is within
    5.5 standard deviations of a link leave a group, and only the group of the first band they share:
    other bands they share hold both documents too, so that one is compared here, as a small
    band, or was its leader's comparison.
    """
    large = opened.where(F.col("n") > SMALL)
    nodes = large.select("node").distinct()
    wide = materialize(_wide_sketches(sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])), "neardup-wide")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = large.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("band", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "node", F.xxhash64("component").alias("component")).join(wide, "node").join(bands, "node")

    def compare(key, group):
        band, i, j = (k.as_py() for k in key)
        own = group.column("_own").to_numpy()
        bits = group.column("wide").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(own), -1)
        shared = group.column("bands").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
        component, size = group.column("component").to_numpy(), group.column("size").to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found_a, found_b = [], []
        for row in left.tolist():
            to = right[right > row] if i == j else right
            to = to[(component[to] != component[row]) & (100 * np.minimum(size[to], size[row]) >= LINK * np.maximum(size[to], size[row]))]
            x = bits[to] ^ bits[row]
            differing = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1, dtype=np.int64)
            chance = 1 / (1 << BITS)
            to = to[(1 - differing / WIDE - chance) / (1 - chance) >= LEAST_WIDE]
            to = to[shared[row][(shared[to] == shared[row]).argmax(axis=1)] == band]
            found_a.append(np.full(len(to), row)), found_b.append(to)
        a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
        node = group.column("node")
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b))})

    kind = dict(opened.dtypes)["node"]
    pairs = met.groupBy("band", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the least node reachable over ``edges`` (a, b), for all nodes with an edge.

    Alternating large and small stars, stored after every round, until nothing changes. Each star step
    groups by node with a minimum that is pre-aggregated before the shuffle.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    total = _summary(current)
    while True:
        ways = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        current, old = materialize(small, name), total
        total = _summary(current)
        if total == old:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _summary(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum, by which a round without change is noticed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _labels(links: DataFrame) -> DataFrame:
    """(node, component): the least document within two links of each linked one.

    Equal labels mean connected documents; connected ones farther apart may differ, which costs comparisons
    and loses nothing.
    """
    ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    reached = ways.join(near.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("low").alias("_low"))
    return reached.join(near, "a").select(F.col("a").alias("node"), F.least("_low", "low").alias("component"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and kept for every input row.

    Rows with equal shingle sets form one class, known by its smallest doc_id; only classes are compared.
    Documents in a band are first compared with the band's smallest document, then, in bands that hold more
    than one group of documents linked so far, with one drawn by hash. Bands that are still divided are compared between
    components in full, large ones block by block, so none of their links is lost. The chance that a linked pair shares none
    of 32 bands of four is below 5e-8. Rows without words, and rows with a
    null doc_id, are linked with nothing (a null id has a null component and is kept). Rows that share
    an id count as one node wherever that id is their class's smallest.
    """
    rows = materialize(sketches(docs), "neardup-sketches")
    known = rows.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    classes = known.groupBy("set_key").agg(F.min("doc_id").alias("node"))
    first = known.join(classes, "set_key").where(F.col("doc_id") == F.col("node"))
    first = materialize(first.dropDuplicates(["node", "set_key"]).select("node", "n_shingles", "sig", "bands"), "neardup-first")
    keys, first = first.select("node", "bands"), first.drop("bands")
    bands = keys.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).where("_last > leader").select("band", "leader")
    members = materialize(bands.join(shared, "band"), "neardup-members")
    pairs = materialize(_plausible(members.where("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), first), "neardup-pairs")
    sets = _sets(members.select("node").distinct(), docs)
    links = materialize(_confirmed(pairs, sets), "neardup-links")
    for turn in range(STAR_ROUNDS):
        more = _plausible(_star_pairs(_open_bands(members, _labels(links)), turn), first)
        links = materialize(links.unionByName(_confirmed(more, sets)), "neardup-links")
    opened = _open_bands(members, _labels(links))
    rest = materialize(_small_pairs(opened, first).unionByName(_block_pairs(opened, sets, keys)).distinct(), "neardup-pairs")
    final = components(links.unionByName(_confirmed(rest, sets)), "neardup-components")
    classed = rows.join(classes, "set_key", "left").join(final, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return classed.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_documents(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id.

    Rows with a null doc_id stay. Of rows that repeat an id within a group one stays: the text with the
    smallest hash, and of equal texts any one row.
    """
    judged = near_duplicates(docs).where(F.col("kept") & F.col("doc_id").isNotNull())
    chosen = judged.groupBy("doc_id").agg(F.min("text_key").alias("text_key"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.struct("*").alias("row"))
    once = W.partitionBy("doc_id", "text_key").orderBy("doc_id")  # the join leaves rows in this order already
    found = rows.join(chosen, ["doc_id", "text_key"]).withColumn("turn", F.row_number().over(once)).where("turn = 1")
    return found.unionByName(rows.where(F.col("doc_id").isNull()), allowMissingColumns=True).select("row.*")
