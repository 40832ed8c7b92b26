"""What the operators of this package share: word pattern, bounded Arrow slices, range-ordered running totals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from clausework.scratch import materialize
from clausework.session import prepare

#: A word is a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def ready(spark: SparkSession) -> SparkSession:
    """The package on the executors, and Arrow batches small enough for workers with little memory."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{2 * SLICE_BYTES}b")
    return spark


def load_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (strings or lists) holds at most ``limit`` units a slice, or one row."""
    for batch in batches:
        values = batch.column(column)
        length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        ends = np.cumsum(length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            used = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, used + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_rows(df: DataFrame, column: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded size."""

    def run(batches):
        for part in slices(batches, column, limit):
            yield fn(part)

    return df.mapInArrow(run, schema)


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def word_count(text: str = "text"):
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def running_totals(df: DataFrame, group: str, order: list[str], value: str, name: str = "before") -> DataFrame:
    """Add the sum of ``value`` (long) over earlier rows of the same ``group`` (long) in ``order``.

    One range exchange; each partition sums its own rows and the result is stored, so the ranges stay
    fixed. What lies before a partition is a sum over one row per group and partition. No group is ever
    gathered in one task.
    """

    def local(batches):
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(group).to_numpy(zero_copy_only=False)
            values = batch.column(value).to_numpy(zero_copy_only=False)
            before = np.cumsum(values) - values
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            base = before[starts].copy()
            base[0] -= carry if groups[0] == last else 0
            before -= np.repeat(base, np.diff(np.r_[starts, len(values)]))
            last, carry = groups[-1], int(before[-1] + values[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(values), part, np.int64)), pa.array(before)], names=[*batch.schema.names, "_part", "_local"]
            )

    kinds = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    stored = materialize(ranged.mapInArrow(local, f"{kinds}, _part long, _local long"), "ranges")
    sums = stored.groupBy(group, "_part").agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(group, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    return stored.join(offsets, [group, "_part"]).withColumn(name, F.col("_local") + F.col("_offset")).drop("_part", "_local", "_offset")
