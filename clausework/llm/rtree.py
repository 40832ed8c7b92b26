"""Hard negatives from an STR-packed R-tree over integer vectors.

The rows are packed into tiles by sort-tile-recursive cuts along the two coordinates that vary most, and the rows of a tile
into leaves in the same way, label by label. The minimum bounding box of a node gives an interval for each coordinate of a row and
so an interval for its inner product with an anchor. A best-first queue visits the node with the highest upper bound next and drops
nodes outside the wanted score window, of unwanted labels, or strictly behind the kth row found.
"""

from __future__ import annotations

import heapq
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from clausework.llm.common import map_rows
from clausework.scratch import materialize

#: Rows of a tile, and the most tiles (larger tables get larger tiles, so that their cuts stay a few MB).
TILE_ROWS, MOST_TILES = 8192, 1 << 18
LEAF_ROWS, FAN_OUT = 64, 16
#: Tiles whose anchors travel together, and anchors searched together.
BLOCK_TILES, BATCH = 16, 512
#: Rows (chosen by hash) that decide which coordinates are cut. They shape the tree, never a result.
SAMPLE_ROWS = 4096
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def str_order(rows: np.ndarray, ids: np.ndarray, leaf: int, axes: list[int]) -> list[np.ndarray]:
    """Leaves of at most ``leaf`` rows: slabs along the first axis, slabs of those along the next, runs along the last."""
    parts = [np.arange(len(ids))]
    for i, axis in enumerate(axes):
        out = []
        for part in parts:
            part = part[np.lexsort((ids[part], rows[part, axis]))]
            leaves = math.ceil(len(part) / leaf)
            slabs = leaves if i == len(axes) - 1 else math.ceil(leaves ** (1 / (len(axes) - i)))
            size = leaf * math.ceil(leaves / slabs) if slabs else leaf
            out += [part[j : j + size] for j in range(0, len(part), size)]
        parts = out
    return parts


class Level(NamedTuple):
    low: np.ndarray
    high: np.ndarray
    first_id: np.ndarray  # smallest id below each node
    labels: tuple[np.ndarray, np.ndarray]  # smallest and largest label below
    starts: np.ndarray  # children (rows, at leaves) of node i are starts[i] to starts[i + 1]


class Tree:
    """A tile's rows in leaf order with the boxes of every level; level 0 holds the leaves."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, starts: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        cuts = starts[:-1]
        self.levels = [Level(np.minimum.reduceat(rows, cuts), np.maximum.reduceat(rows, cuts), np.minimum.reduceat(ids, cuts), (labels[cuts], labels[cuts]), starts)]
        while len(self.levels[-1].first_id) > FAN_OUT:
            below = self.levels[-1]
            cuts = np.arange(0, len(below.first_id), FAN_OUT)
            lo, hi = below.labels
            self.levels.append(
                Level(np.minimum.reduceat(below.low, cuts), np.maximum.reduceat(below.high, cuts), np.minimum.reduceat(below.first_id, cuts), (np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)), np.r_[cuts, len(below.first_id)])
            )


class Jobs(NamedTuple):
    """Searches: rows of the anchor's label (``same``) or of others, scoring from ``low`` to ``high``."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray


def search(tree: Tree, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, jobs: Jobs, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(job, row, score) of the best ``k`` rows of each job, by score, then smaller id. An anchor never finds its own id.

    All jobs share one queue: a node's place is its highest upper bound among the jobs that still want it, and a leaf is
    scored for those jobs at once. Scores are exact: doubles where every bound is below 2^53, else 64-bit integers.
    """
    dims = max(1, anchors.shape[1])
    peak = float(np.abs(anchors).max(initial=0)) * float(np.abs(tree.rows).max(initial=0)) * dims
    exact = peak < 2**53
    slack = 0.0 if exact else peak * 1e-12
    q, rows = anchors.astype(np.float64), tree.rows.astype(np.float64)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bounds = []
    for level in tree.levels:
        low, high = level.low.astype(np.float64), level.high.astype(np.float64)
        bounds.append((up @ high.T + down @ low.T + slack, up @ low.T + down @ high.T - slack))
    count = len(jobs.anchor)
    best = np.full((count, k), LOWEST, np.int64)
    best_row = np.full((count, k), -1, np.int64)
    last_id = np.full(count, HIGHEST, np.int64)  # id of the kth row found
    labels = anchor_labels[jobs.anchor]

    def wanted(level: int, node: int) -> np.ndarray:
        upper, lower = (b[jobs.anchor, node] for b in bounds[level])
        lo, hi = (x[node] for x in tree.levels[level].labels)
        fits = (lo <= labels) & (labels <= hi) if same else (labels != lo) | (labels != hi)
        fits &= (upper >= jobs.low) & (lower <= jobs.high)
        kth = best[:, -1]
        return fits & ((upper > kth) | (upper == kth) & (tree.levels[level].first_id[node] < last_id) if exact else upper >= kth)

    def push(level: int, node: int) -> None:
        fits = wanted(level, node)
        if fits.any():
            heapq.heappush(queue, (-float(bounds[level][0][jobs.anchor[fits], node].max()), int(tree.levels[level].first_id[node]), level, node))

    queue: list[tuple[float, int, int, int]] = []
    top = len(tree.levels) - 1
    for node in range(len(tree.levels[top].first_id)):
        push(top, node)
    while queue:
        _, _, level, node = heapq.heappop(queue)
        active = np.flatnonzero(wanted(level, node))
        if not len(active):
            continue
        a, b = tree.levels[level].starts[node : node + 2]
        if level:
            for child in range(a, b):
                push(level - 1, child)
            continue
        users, back = np.unique(jobs.anchor[active], return_inverse=True)
        scores = (q[users] @ rows[a:b].T).astype(np.int64) if exact else anchors[users].astype(np.int64) @ tree.rows[a:b].astype(np.int64).T
        scores, ids = scores[back], tree.ids[a:b]
        keep = (scores >= jobs.low[active, None]) & (scores <= jobs.high[active, None]) & (ids != anchor_ids[jobs.anchor[active], None])
        kth = best[active, -1][:, None]
        keep &= (scores > kth) | (scores == kth) & (ids < last_id[active, None])
        i, j = np.nonzero(keep)
        if not len(i):
            continue
        changed = np.unique(i)
        held = active[changed]
        job = np.r_[np.repeat(held, k), active[i]]
        score = np.r_[best[held].ravel(), scores[i, j]]
        row = np.r_[best_row[held].ravel(), a + j]
        job, score, row = (x[row >= 0] for x in (job, score, row))
        order = np.lexsort((tree.ids[row], ~score, job))  # ~ reverses the order of integers
        job, score, row = job[order], score[order], row[order]
        starts = np.flatnonzero(np.r_[True, job[1:] != job[:-1]])
        place = np.arange(len(job)) - np.repeat(starts, np.diff(np.r_[starts, len(job)]))
        kept = place < k
        best[held], best_row[held] = LOWEST, -1
        best[job[kept], place[kept]], best_row[job[kept], place[kept]] = score[kept], row[kept]
        last_id[held] = np.where(best_row[held, -1] >= 0, tree.ids[best_row[held, -1]], HIGHEST)
    job, place = np.nonzero(best_row >= 0)
    return job, best_row[job, place], best[job, place]


def usable_rows(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): whole-number vectors of the rows that take part, one row per vec_id.

    Left out are rows with a null id, label, vector or component or a component that is not finite, and rows whose squared
    length reaches 2^62, as their scores need not fit a long. Of rows that share a vec_id the one with the smallest label, then
    vector, stands for all.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate("w", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    rows = rows.select("vec_id", "label", whole.alias("w")).where(length < float(2**62))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct("label", F.col("w").cast("array<int>").alias("v")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def padded(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of a list column as a matrix; missing components are 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def places(values: np.ndarray, cuts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Slab of each value; values equal to several cuts are dealt over all slabs between them by id, so no value fills a slab alone."""
    low, high = np.searchsorted(cuts, values, "left"), np.searchsorted(cuts, values, "right")
    return low + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % (high - low + 1)


def pack_tiles(rows: DataFrame, dims: int, count: int, tile_rows: int) -> tuple[DataFrame, int]:
    """One row per tile (tile, ids, labels, flat, starts) with its rows in leaf order, and the number of tiles."""
    tiles = max(1, min(MOST_TILES, math.ceil(count / tile_rows)))
    slabs = math.ceil(math.sqrt(tiles))
    runs = math.ceil(tiles / slabs)
    sample = rows.where(F.abs(F.xxhash64("vec_id") % 1_000_000) < int(1_000_000 * min(1, SAMPLE_ROWS / count))).select("v").toArrow()["v"].combine_chunks()
    spread = padded(sample, dims).astype(np.float64).var(axis=0) if len(sample) else np.zeros(dims)
    first, second = (int(x) for x in np.r_[np.argsort(-spread, kind="stable"), 0, 0][:2])
    at = lambda axis: F.coalesce(F.get("v", F.lit(axis)), F.lit(0))
    quantiles = lambda n: [i / n for i in range(1, n)]
    cuts = np.array(rows.agg(F.percentile_approx(at(first), quantiles(slabs), 10_000)).first()[0], np.int64) if slabs > 1 else np.zeros(0, np.int64)
    inner = np.zeros((slabs, runs - 1), np.int64)

    def slab_of(batch):
        return pa.RecordBatch.from_arrays([pa.array(places(batch.column("x").to_numpy(), cuts, batch.column("vec_id").to_numpy())), batch.column("y")], names=["slab", "y"])

    if runs > 1:
        narrow = rows.select("vec_id", at(first).alias("x"), at(second).alias("y")).mapInArrow(lambda batches: map(slab_of, batches), "slab long, y int")
        for slab, ys in narrow.groupBy("slab").agg(F.percentile_approx("y", quantiles(runs), 10_000)).collect():  # one row a slab: at most 512
            inner[slab] = ys

    def tile_of(batches):
        for batch in batches:
            v, ids = padded(batch.column("v"), dims), batch.column("vec_id").to_numpy()
            slab = places(v[:, first], cuts, ids) if dims else np.zeros(len(ids), np.int64)
            run = np.zeros(len(ids), np.int64)
            for s in np.unique(slab):
                run[slab == s] = places(v[slab == s, second], inner[s], ids[slab == s]) if dims else 0
            yield pa.RecordBatch.from_arrays([pa.array(slab * runs + run), *batch.columns], names=["tile", *batch.schema.names])

    def pack(table: pa.Table) -> pa.Table:
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        v = padded(table["v"].combine_chunks(), dims)
        axes = np.argsort(-v.var(axis=0), kind="stable")[:3].tolist() or [0]
        v = v if dims else np.zeros((len(ids), 1), np.int64)
        leaves = []
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            leaves += [own[part] for part in str_order(v[own], ids[own], LEAF_ROWS, axes)]
        order = np.concatenate(leaves)
        starts = np.r_[0, np.cumsum([len(x) for x in leaves])]
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        return pa.table([table["tile"].slice(0, 1), one(ids[order], pa.int64()), one(labels[order], pa.int64()), one(v[order].ravel(), pa.int32()), one(starts, pa.int32())], names=["tile", "ids", "labels", "flat", "starts"])

    dealt = rows.mapInArrow(tile_of, "tile long, vec_id long, label long, v array<int>")
    packed = dealt.groupBy("tile").applyInArrow(pack, "tile long, ids array<long>, labels array<long>, flat array<int>, starts array<int>")
    return materialize(packed, "tiles"), slabs * runs


def tree_of(batch, i: int, dims: int) -> Tree:
    ids, labels, flat, starts = (batch.column(c)[i].values.to_numpy() for c in ("ids", "labels", "flat", "starts"))
    return Tree(ids, labels, flat.reshape(len(ids), -1), starts)


def batches_of(n: int):
    return (slice(i, i + BATCH) for i in range(0, n, BATCH))


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, scale: int = 256, tile_rows: int = TILE_ROWS) -> DataFrame:
    """For each anchor (vec_id divisible by ``every``) and each of its best rows of the same label: the best rows of other labels
    that score between 80 % and all of the positive's score.

    Scores are inner products of ``floor(scale * x)``; vectors of unequal length are filled up with 0. Ties go to the smaller vec_id. See
    ``usable_rows`` for nulls, numbers that are not finite and repeated ids. An anchor without another row of its label, or a positive
    without a row in its window, has no rows; an empty table gives none. Columns: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; other columns are not read.

    Anchors are the stated query set: blocks of them travel to every tile, and only rows that can still be among the best leave a tile, as
    its own tile first gives every anchor a kth score to beat. Tiles are balanced by quantiles of all rows, equal values dealt out by id.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = materialize(usable_rows(vectors, scale), "vectors")
    count, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    tiles, tile_count = pack_tiles(rows, dims, count, tile_rows)
    width = max(1, dims)

    def seeds(batch):
        """Anchors of each tile with the score of the kth row of their label there."""
        ids, labels, flat, lows, where = [], [], [], [], []
        for i in range(batch.num_rows):
            tree = tree_of(batch, i, dims)
            own = np.flatnonzero(tree.ids % every == 0)
            low = np.full(len(own), LOWEST, np.int64)
            for part in batches_of(len(own)):
                a = own[part]
                jobs = Jobs(np.arange(len(a)), np.full(len(a), LOWEST, np.int64), np.full(len(a), HIGHEST, np.int64))
                job, _, score = search(tree, tree.rows[a], tree.ids[a], tree.labels[a], jobs, True, positives)
                full = np.bincount(job, minlength=len(a)) == positives
                worst = np.full(len(a), HIGHEST, np.int64)
                np.minimum.at(worst, job, score)
                low[part] = np.where(full, worst, LOWEST)
            ids.append(tree.ids[own])
            labels.append(tree.labels[own])
            flat.append(tree.rows[own].ravel())
            lows.append(low)
            where.append(np.full(len(own), batch.column("tile")[i].as_py() // BLOCK_TILES, np.int64))
        ids, labels, flat, lows, where = map(np.concatenate, (ids, labels, flat, lows, where))
        v = pa.FixedSizeListArray.from_arrays(pa.array(flat.astype(np.int32)), width).cast(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(where), pa.array(ids), pa.array(labels), v, pa.array(lows)], names=["block", "anchor_id", "label", "v", "low"])

    anchors = materialize(map_rows(tiles, "flat", seeds, "block long, anchor_id long, label long, v array<int>, low long"), "anchors")
    to_tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tile_count - 1).cast("long"))).alias("tile")

    def meet(df: DataFrame, extra: list[str]) -> DataFrame:
        """Blocks of anchors next to every tile, as arrays."""
        names = ["anchor_id", "label", "v", *extra]
        blocks = df.groupBy("block").agg(F.collect_list(F.struct(*names)).alias("a"))
        arrays = [F.flatten("a.v").alias("a_flat"), *[F.col(f"a.{n}").alias(f"a_{n}") for n in names if n != "v"]]
        return blocks.select(to_tiles, *arrays).join(tiles, "tile")

    def parts(batch):
        for i in range(batch.num_rows):
            tree = tree_of(batch, i, dims)
            ids, labels, flat = (batch.column(c)[i].values.to_numpy() for c in ("a_anchor_id", "a_label", "a_flat"))
            yield i, tree, ids, labels, flat.reshape(len(ids), -1)

    def joined(found, names):
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def same_label(batch):
        found = []
        for i, tree, ids, labels, v in parts(batch):
            low = batch.column("a_low")[i].values.to_numpy()
            for part in batches_of(len(ids)):
                n = len(ids[part])
                job, row, score = search(tree, v[part], ids[part], labels[part], Jobs(np.arange(n), low[part], np.full(n, HIGHEST, np.int64)), True, positives)
                found.append((ids[part][job], tree.ids[row], score))
        return joined(found, ["anchor_id", "positive_id", "positive_score"])

    ranked = lambda keys, score, other: F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), other))
    near = map_rows(meet(anchors, ["low"]), "flat", same_label, "anchor_id long, positive_id long, positive_score long")
    best = near.withColumn("place", ranked(["anchor_id"], "positive_score", "positive_id")).where(F.col("place") <= positives)
    windows = materialize(best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found")), "positives")

    def other_labels(batch):
        found = []
        for i, tree, ids, labels, v in parts(batch):
            lists = batch.column("a_found")[i].values
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            pairs = lists.flatten()
            positive, high = pairs.field("positive_id").to_numpy(), pairs.field("positive_score").to_numpy()
            low = high - high // 5  # 80 * high <= 100 * score
            anchor = np.repeat(np.arange(len(ids)), sizes)
            for part in batches_of(len(anchor)):
                used, back = np.unique(anchor[part], return_inverse=True)
                job, row, score = search(tree, v[used], ids[used], labels[used], Jobs(back, low[part], high[part]), False, negatives)
                found.append((ids[anchor[part]][job], positive[part][job], tree.ids[row], high[part][job], score))
        return joined(found, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    far = map_rows(meet(anchors.drop("low").join(windows, "anchor_id"), ["found"]), "flat", other_labels, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    out = far.withColumn("rank", ranked(["anchor_id", "positive_id"], "negative_score", "negative_id").cast("int")).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
