"""Structured Streaming jobs. Each transformation also runs on a batch DataFrame, which is its checked twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clausework.operators import corpus


def rate_limit(events: DataFrame, key: str, window: str, limit: int) -> DataFrame:
    """Calls per key and fixed window: allowed, rejected, and seconds until the window ends."""
    w = F.window("ts", window)
    last = F.max(F.unix_seconds("ts"))
    counted = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("calls"), last.alias("last"))
    start, end = F.unix_seconds("w.start"), F.unix_seconds("w.end")
    return counted.select(
        key, start.alias("window_start"), "calls", F.least("calls", F.lit(limit)).cast("long").alias("allowed"),
        F.greatest(F.col("calls") - limit, F.lit(0)).cast("long").alias("rejected"), (end - F.col("last")).alias("retry_after"),
    )


def rate_limit_stream(events: DataFrame, key: str, window: str, limit: int, delay: str):
    """The same counts over a stream; windows close once the watermark passes them."""
    return rate_limit(events.withWatermark("ts", delay), key, window, limit)


def usage_by_window(events: DataFrame, window: str) -> DataFrame:
    """Mergeable counters per window and endpoint."""
    return events.groupBy(F.window("ts", window).alias("w"), "endpoint").agg(
        F.count("*").alias("calls"), F.sum("latency").alias("latency_sum")
    ).select(F.unix_seconds("w.start").alias("window_start"), "endpoint", "calls", "latency_sum")


def usage_writer(events: DataFrame, window: str, delay: str, path: str, checkpoint: str):
    """Upsert window counters per micro-batch into versioned Parquet; the highest version of a window is current."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("version", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    counted = usage_by_window(events.withWatermark("ts", delay), window)
    return counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)


def current_usage(versions: DataFrame) -> DataFrame:
    """Latest counters of every window and endpoint from the versioned table."""
    return corpus.upsert(versions, versions.limit(0), ["window_start", "endpoint"], "version").drop("version")


def ttl_dedup_stream(events: DataFrame, key: str, ttl: str) -> DataFrame:
    """First sighting per key inside the watermark."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


STALE_SCHEMA = StructType([StructField("request_id", LongType()), StructField("status", StringType()), StructField("refunded", LongType())])


class StaleRelease(StatefulProcessor):
    """Open requests time out after the limit and are refunded; settled and deep requests are not."""

    def __init__(self, minutes: int):
        self.millis = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.units = handle.getValueState("units", StructType([StructField("units", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for kind, mode, units, at in zip(pdf["kind"], pdf["mode"], pdf["units"], pdf["ts"]):
                if kind == "settle":
                    self.units.clear()
                    for timer in self.handle.listTimers():
                        self.handle.deleteTimer(timer)
                elif mode != "deep":
                    self.units.update((int(units),))
                    self.handle.registerTimer(int(at.timestamp() * 1000) + self.millis)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.units.exists():
            units = self.units.get()[0]
            self.units.clear()
            yield pd.DataFrame({"request_id": [key[0]], "status": ["error"], "refunded": [units]})

    def close(self) -> None:
        pass


def stale_release_stream(events: DataFrame, minutes: int, delay: str) -> DataFrame:
    """``events``: request_id, kind open/settle, mode, units, ts."""
    return events.withWatermark("ts", delay).groupBy("request_id").transformWithStateInPandas(
        statefulProcessor=StaleRelease(minutes), outputStructType=STALE_SCHEMA, outputMode="append", timeMode="eventTime"
    )


def embed_missing(chunks: DataFrame, vectors_path: str, vectorise, checkpoint: str):
    """Per micro-batch, vectorise only chunks that have no vector yet and append them."""

    def save(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(vectors_path).select("document_id").distinct()
            batch = batch.join(done, "document_id", "left_anti")
        except Exception as exc:  # noqa: BLE001 - the first batch finds no vector table yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise
        vectorise(batch).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(vectors_path)

    return chunks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
