"""Dense and hashed-token nearest neighbours for whole tables of queries."""

from __future__ import annotations

import math
from hashlib import sha1

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window as W, functions as F

from clausework import scratch
from clausework.functions import text as T, vectors as V

QUERY_BLOCK, VECTOR_BLOCK, SPARSE_BLOCK = 1024, 16_384, 4096
#: Scores that a task holds at once.
CELLS = 1 << 20
#: Characters of text whose tokens a task counts.
TASK_CHARS = 2 << 20
VECTOR_DIM = 512  # fixed value: hashed token buckets
TOKEN_WORDS = f"[A-Z0-9]+(?:/[A-Z0-9]+)?(?:[-.][A-Z0-9]+)*|[{T.HAN}]{{2,}}"


def dense_rows(dims: slice):
    """Rows of a list column as unit vectors."""

    def rows(table: pa.Table, name: str) -> np.ndarray:
        column = table.column(name).combine_chunks()
        m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)[:, dims]
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    return rows


def sparse_rows(table: pa.Table, name: str) -> np.ndarray:
    """Rows of a column of (idx, w) lists as full vectors of ``VECTOR_DIM`` components."""
    column = table.column(name).combine_chunks()
    cells = column.flatten()
    out = np.zeros((len(column), VECTOR_DIM))
    out[np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), cells.field("idx").to_numpy()] = cells.field("w").to_numpy()
    return out


def _shared_numbers(q: pa.Table, v: pa.Table, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes at one place of both blocks as small numbers: equal codes, equal numbers."""
    codes = [pc.list_element(t.column("codes"), at).to_numpy() for t in (q, v)]
    distinct, number = np.unique(np.concatenate(codes), return_inverse=True)
    number = number.astype(np.uint8 if len(distinct) <= 256 else np.uint16)  # a block has fewer rows than 2^16
    return number[: q.num_rows], number[q.num_rows :]


def blocked_product(queries: DataFrame, vectors: DataFrame, keys: list[str], rows, k: int, above: float | None, block: int) -> DataFrame:
    """Best ``k`` rows of ``vectors`` (``keys``, v) for each query (query_id, q) by inner product: (query_id, keys, score), ties included per block.

    Queries and vectors fall into hashed blocks of about 1,024 and ``block`` rows. Each query block meets
    each vector block in one group of bounded size, which multiplies the two and keeps its own top k (ties
    included); so at most k rows per query and vector block reach the ranking shuffle. Blocks of queries
    are copied once per vector block, a few hundredths of the vectors' own bytes. If ``vectors`` has a column ``scope``,
    only the queries listed there may find the row. If both have a column ``codes``, only rows that share a code at one place may meet.
    """
    query_blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    vector_blocks = max(1, math.ceil(vectors.count() / block))
    scoped, coded = "scope" in vectors.columns, "codes" in vectors.columns
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda names, n: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int")
    left = queries.select("query_id", "q", *["codes"] * coded, own(["query_id"], query_blocks).alias("qb"), every(vector_blocks).alias("vb"))
    right = vectors.select(*keys, "v", *["scope"] * scoped, *["codes"] * coded, own(keys, vector_blocks).alias("vb"), every(query_blocks).alias("qb"))
    kinds = dict(vectors.dtypes)
    names = ["query_id", *keys, "score"]

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return pa.table([q.column("query_id").slice(0, 0), *[v.column(c).slice(0, 0) for c in keys], pa.array([], pa.float64())], names=names)
        asked, held = rows(q, "q"), rows(v, "v").T
        ids, allowed = q.column("query_id"), None
        if scoped:
            place = {query_id: i for i, query_id in enumerate(ids.to_pylist())}
            allowed = np.zeros((len(asked), held.shape[1]), bool)
            for u, wanted in enumerate(v.column("scope").to_pylist()):
                allowed[[place[w] for w in wanted if w in place], u] = True
        met = [_shared_numbers(q, v, t) for t in range(len(q.column("codes")[0]))] if coded else []
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, CELLS // held.shape[1])
        for start in range(0, len(asked), step):  # a few queries at once, so that the scores need little memory
            scores = np.round(asked[start : start + step] @ held, 9)
            if above is not None:
                scores[~(scores > above)] = -np.inf
            if scoped:
                scores[~allowed[start : start + step]] = -np.inf
            if coded:
                near = np.zeros(scores.shape, bool)
                for a, b in met:
                    near |= a[start : start + step, None] == b
                scores[~near] = -np.inf
            keep = np.isfinite(scores)
            if scores.shape[1] > k:
                least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
                keep &= scores >= least
            qi, ui = np.nonzero(keep)
            found.append((qi + start, ui, scores[qi, ui]))
        qi, ui, best_scores = (np.concatenate(c) for c in zip(*found))
        return pa.table([ids.take(pa.array(qi)), *[v.column(c).take(pa.array(ui)) for c in keys], pa.array(best_scores)], names=names)

    pairs = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb"))
    return pairs.applyInArrow(best, ", ".join(["query_id long", *[f"{c} {kinds[c]}" for c in keys], "score double"]))


def exact_knn(queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, dims: slice = slice(None)) -> DataFrame:
    """Exact cosine top-k: (query_id, unit_id, document_id, score, rank)."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    v = vectors.select("unit_id", "document_id", F.col("embedding").alias("v"))
    return rank_by_score(blocked_product(q, v, ["unit_id", "document_id"], dense_rows(dims), k, threshold, VECTOR_BLOCK), k)


def rank_by_score(rows: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def lsh_knn(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 12, width: int = 3, bucket: float = 0.5) -> DataFrame:
    """Approximate neighbours: candidates agree on ``width`` random projections in one of ``tables`` keys.

    The keys of a row stay with it as ``tables`` codes. Blocks of queries meet blocks of vectors, where only rows that share a code are
    ranked, so that no candidate pair leaves a task: what is shuffled grows with rows and blocks, not with candidates.
    """
    normed = lambda df: df.withColumn("embedding", V.l2_normalize("embedding", 64)).where("embedding is not null").withColumn("v", array_to_vector("embedding"))
    q, v = normed(queries), normed(vectors)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables * width, seed=7).fit(v)
    # ``width`` neighbouring hashes make one code.
    codes = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.xxhash64(F.array_join(F.slice("f", t * width + 1, width), ","))).alias("codes")
    hashed = lambda df, *cols: model.transform(df).select(*cols, F.split(F.regexp_replace(F.col("h").cast("string"), "[\\[\\] ]", ""), ",").alias("f")).select(*[F.col(c).alias({"embedding": "q" if df is q else "v"}.get(c, c)) for c in cols], codes)
    left = scratch.materialize(hashed(q, "query_id", "embedding"), "coded")
    right = scratch.materialize(hashed(v, "unit_id", "document_id", "embedding"), "coded")
    return rank_by_score(blocked_product(left, right, ["unit_id", "document_id"], dense_rows(slice(None)), k, None, VECTOR_BLOCK), k)


def vector_tokens(col):
    """Upper-case Latin and number words, Han runs, and two- to four-character grams of Han runs."""
    words = F.regexp_extract_all(F.upper(T._c(col)), F.lit(TOKEN_WORDS), F.lit(0))

    def grams(w):
        size = F.char_length(w)
        cut = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.when(w.rlike(f"^[{T.HAN}]{{3,}}$"), F.concat(F.array(w), cut(2), cut(3), cut(4))).otherwise(F.array(w))

    return F.flatten(F.transform(words, grams))


def hash_buckets(units: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Raw bucket weights (keys, idx, x): 1 + ln(count) per token, summed where tokens share a bucket.

    Texts are dealt out by key once; counting, bucket sums and the norm then need no further exchange. Their number of
    partitions follows from the length of all texts, so that what a task counts does not grow with the input.
    """
    texts = units.select(*keys, T._c(text).alias("_text"))
    parts = math.ceil((texts.agg(F.sum(F.char_length("_text"))).first()[0] or 1) / TASK_CHARS)
    counts = texts.repartition(max(parts, units.sparkSession.sparkContext.defaultParallelism), *keys).select(*keys, F.explode(vector_tokens("_text")).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    idx = (F.conv(F.substring(F.sha1("token"), 1, 8), 16, 10).cast("long") % VECTOR_DIM).alias("idx")
    return counts.select(*keys, idx, (1.0 + F.log(F.col("n").cast("double"))).alias("x")).groupBy(*keys, "idx").agg(F.sum("x").alias("x"))


def hash_vectors(units: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sparse hashed vectors as rows (keys, idx, w) of unit length."""
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(*keys)))
    return hash_buckets(units, keys, text).select(*keys, "idx", (F.col("x") / norm).alias("w"))


def packed(vectors: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Hashed vectors as one row per key with a list of (idx, w). They are dealt out by key already, so nothing is shuffled."""
    return vectors.groupBy(*keys).agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "w")).alias(name))


def hash_knn(query_vectors: DataFrame, unit_vectors: DataFrame, unit_keys: list[str], k: int, floor: float = 0.08, scope: DataFrame | None = None) -> DataFrame:
    """Inner products of hashed vectors, above ``floor``, best ``k`` per query: a blocked product, so no pair is emitted per shared bucket.

    ``scope`` (query_id, document_id) restricts the units of each query; units of no scope are dropped before the product.
    """
    v = packed(unit_vectors, unit_keys, "v")
    if scope is not None:
        v = v.join(scope.groupBy("document_id").agg(F.collect_set("query_id").alias("scope")), "document_id")
    q = scratch.materialize(packed(query_vectors, ["query_id"], "q"), "hashed")
    dots = blocked_product(q, scratch.materialize(v, "hashed"), unit_keys, sparse_rows, k, floor, SPARSE_BLOCK)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), *unit_keys)
    return dots.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


#: Units of a part, and units whose scores are worked out together.
PART_UNITS, CHUNK = 8192, 2048


def hash_parts(units: DataFrame, text: str) -> DataFrame:
    """Parts of units (document_id, unit_order, each pair once; ``text``) with their hashed vectors, made where the units lie: the weights of ``hash_vectors``
    without a row for each token. A column ``scope`` (queries that may find the unit) is carried along."""
    scoped = "scope" in units.columns

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("tokens")
        coded = lists.flatten().dictionary_encode()
        owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        bucket = np.array([int(sha1(t.encode()).hexdigest()[:8], 16) % VECTOR_DIM for t in coded.dictionary.to_pylist()], np.int64)
        width = max(1, len(bucket))
        cell, n = np.unique(owner * width + coded.indices.to_numpy(), return_counts=True)
        place, at = np.unique(cell // width * VECTOR_DIM + bucket[cell % width], return_inverse=True)
        x = np.bincount(at, 1.0 + np.log(n.astype(np.float64)), len(place))
        norm = np.sqrt(np.bincount(place // VECTOR_DIM, x * x, batch.num_rows))
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        arrays = [whole(batch.column(c).cast(pa.int64())) for c in ("document_id", "unit_order")]
        arrays += [one(place // VECTOR_DIM, pa.int32()), one(place % VECTOR_DIM, pa.int32()), one(x / norm[place // VECTOR_DIM], pa.float64())]
        arrays += [whole(batch.column("scope"))] if scoped else []
        return pa.RecordBatch.from_arrays(arrays, names=["document_id", "unit_order", "unit", "idx", "w"] + ["scope"] * scoped)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PART_UNITS):
                yield part(batch.slice(start, PART_UNITS))

    schema = "document_id array<long>, unit_order array<long>, unit array<int>, idx array<int>, w array<double>" + ", scope array<array<long>>" * scoped
    return units.where("document_id is not null").select("document_id", "unit_order", F.coalesce(vector_tokens(text), F.array().cast("array<string>")).alias("tokens"), *["scope"] * scoped).mapInArrow(run, schema)


class HashedQueries:
    """A block of hashed queries with the best units of each that a task has met."""

    def __init__(self, asked: list[dict]):
        self.ids = np.array([a["query_id"] for a in asked], np.int64)
        self.place = {query_id: i for i, query_id in enumerate(self.ids.tolist())}
        self.matrix = np.zeros((len(asked), VECTOR_DIM))
        for i, a in enumerate(asked):
            for cell in a["q"]:
                self.matrix[i, cell["idx"]] = cell["w"]
        none = np.zeros(0, np.int64)
        self.best = [(none, none, np.zeros(0)) for _ in asked]
        self.least = np.full(len(asked), -np.inf)


def hash_knn_parts(query_vectors: DataFrame, parts: DataFrame, k: int, floor: float) -> DataFrame:
    """``hash_knn`` over ``hash_parts``: blocks of queries meet the parts, only the best ``k`` units of a task leave it and nothing of a unit is shuffled."""
    from clausework.operators.lexical import in_blocks, meet
    from clausework.operators.postings import met_rows

    def near(batches):
        held: dict = {}

        def leave(block):
            for q, (d, u, s) in enumerate(block.best):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), block.ids[q])), pa.array(d), pa.array(u), pa.array(s)], names=["query_id", "document_id", "unit_order", "score"])

        for block, row in met_rows(batches, HashedQueries):
            if block not in held:
                held[block] = None
                if len(held) > 4:
                    yield from leave(first := next(iter(held)))
                    del held[first]
            docs, orders = row["document_id"].to_numpy(zero_copy_only=False), row["unit_order"].to_numpy()
            unit, idx, w = (row[c].to_numpy() for c in ("unit", "idx", "w"))
            for start in range(0, len(docs), CHUNK):
                rows = min(CHUNK, len(docs) - start)
                low, high = np.searchsorted(unit, [start, start + rows])
                vectors = np.zeros((rows, VECTOR_DIM))
                vectors[unit[low:high] - start, idx[low:high]] = w[low:high]
                scores = np.round(block.matrix @ vectors.T, 9)
                keep = (scores > floor) & (scores >= block.least[:, None])
                if "scope" in row:
                    allowed = np.zeros(keep.shape, bool)
                    for u, wanted in enumerate(row["scope"].slice(start, rows).to_pylist()):
                        allowed[[block.place[x] for x in wanted if x in block.place], u] = True
                    keep &= allowed
                for q in np.flatnonzero(keep.any(axis=1)):
                    at = np.flatnonzero(keep[q])
                    d, u, s = (np.concatenate(c) for c in zip(block.best[q], (docs[start + at], orders[start + at], scores[q, at])))
                    order = np.lexsort((u, d, -s))[:k]
                    block.best[q] = d[order], u[order], s[order]
                    if len(order) == k:
                        block.least[q] = s[order[-1]]
        for block in held:
            yield from leave(block)

    q = scratch.materialize(packed(query_vectors, ["query_id"], "q"), "hashed")
    dots = meet(in_blocks(q, QUERY_BLOCK), parts).mapInArrow(near, "query_id long, document_id long, unit_order long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "document_id", "unit_order")
    return dots.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
