"""Time-bound de-duplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from clausework.scratch import materialize


def _runs(batches, columns: list[str]):
    """Yield (k, part, columns) for every run of equal (k, _part) in a sorted stream, however the batches cut it."""
    held, key = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        k, part = pdf["k"].to_numpy(), pdf["_part"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (part[1:] != part[:-1]), True])
        for lo, hi in zip(edges[:-1], edges[1:]):
            if (k[lo], part[lo]) != key:
                if held:
                    yield *key, [np.concatenate(c) for c in zip(*held)]
                held, key = [], (k[lo], part[lo])
            held.append([pdf[c].to_numpy()[lo:hi] for c in columns])
    if held:
        yield *key, [np.concatenate(c) for c in zip(*held)]


def exit_times(at: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """A block of sorted sightings as a step function from the time until which the key is suppressed to that time after the block.

    (breaks, exits): entry times up to ``breaks[i]`` (and above the break before) leave with ``exits[i]``; later ones leave unchanged. The
    last sighting kept is the end of the chain "next sighting a time-to-live later", found by squaring the chain.
    """
    step = np.searchsorted(at, at + ttl)
    step = np.where(step == len(at), np.arange(len(at)), step)
    while True:
        further = step[step]
        if np.array_equal(further, step):
            break
        step = further
    exits = at[step] + ttl
    ends = np.flatnonzero(np.r_[exits[1:] != exits[:-1], True])
    return at[ends], exits[ends]


def ttl_first_sightings(events: DataFrame, key: str, ttl_micros: int) -> DataFrame:
    """First sighting of each key per time-to-live; a suppressed event does not extend the time.

    ``events``: key, at (microseconds). Equal sightings are merged first. Sightings are range-partitioned by key and time, so a busy
    key lies in many blocks. Each block is summarised as a step function (``exit_times``); composing a key's functions in order gives
    the state it enters each block with, and then all blocks are filtered at once. A task holds one block at most.
    """
    seen = events.select(F.col(key).cast("string").alias("k"), "at").distinct()
    ranged = seen.repartitionByRange("k", "at").sortWithinPartitions("k", "at").withColumn("_part", F.spark_partition_id())
    stored = materialize(ranged, "sightings")

    def summarise(batches):
        for k, part, (at,) in _runs(batches, ["at"]):
            breaks, exits = exit_times(at, ttl_micros)
            yield pd.DataFrame({"k": [k], "_part": [part], "breaks": [breaks.tolist()], "exits": [exits.tolist()]})

    ordered = lambda df: df.repartition("k", "_part").sortWithinPartitions("k", "_part", "at")
    functions = ordered(stored).mapInPandas(summarise, "k string, _part int, breaks array<long>, exits array<long>")
    # One small row per key and block; only keys of several blocks enter one suppressed.
    blocks = functions.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("_part", "breaks", "exits"))).alias("fs")).where(F.size("fs") > 1)
    start = F.struct(F.lit(None).cast("long").alias("until"), F.array().cast("array<struct<_part:int,until:long>>").alias("entries"))

    def follow(state, f):
        until = state["until"]
        left = F.when(until.isNull(), F.get(f["exits"], F.lit(0))).otherwise(F.coalesce(F.get(f["exits"], F.size(F.filter(f["breaks"], lambda b: b < until))), until))
        return F.struct(left.alias("until"), F.concat(state["entries"], F.array(F.struct(f["_part"].alias("_part"), until.alias("until")))).alias("entries"))

    entries = blocks.select("k", F.inline(F.aggregate("fs", start, follow, lambda s: s["entries"]))).where("until is not null")
    entry = materialize(entries, "entries").withColumnsRenamed({"k": "_k", "_part": "_block"})
    states = stored.join(entry, stored["k"].eqNullSafe(entry["_k"]) & (stored["_part"] == entry["_block"]), "left")
    states = states.select("k", "_part", "at", F.coalesce("until", F.lit(np.iinfo(np.int64).min)).alias("until"))

    def keep(batches):
        for k, _, (at, until) in _runs(batches, ["at", "until"]):
            out, i = [], int(np.searchsorted(at, until[0]))
            while i < len(at):
                out.append(at[i])
                i = int(np.searchsorted(at, at[i] + ttl_micros))
            yield pd.DataFrame({"k": pd.Series([k] * len(out), dtype="object"), "at": pd.Series(out, dtype="int64")})

    return ordered(states).mapInPandas(keep, "k string, at long")
