"""Usage, quota, feedback and limit roll-ups over request events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def rejection_reasons(runs: DataFrame) -> DataFrame:
    """Frequency and mean latency per reason, plus one row for eligible runs with their false admissions."""
    label = F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("(eligible)"))).otherwise(F.col("reasons")))
    rows = runs.select(label.alias("reason"), "latency", "wrong")
    return rows.groupBy("reason").agg(
        F.count("*").alias("n"), F.round(F.avg("latency"), 4).alias("mean_latency"),
        F.count_if((F.col("reason") == "(eligible)") & F.col("wrong")).alias("false_admissions"),
    )


def usage_summary(log: DataFrame, today: Column) -> DataFrame:
    """Long-form counters: total, today, per endpoint and per status, with mean latency and last use.

    One pass: each event is counted under its four counter names, partially aggregated before the shuffle.
    """
    names = F.array_compact(F.array(
        F.struct(F.lit("total").alias("metric"), F.lit("").alias("value")),
        F.when(today, F.struct(F.lit("today").alias("metric"), F.lit("").alias("value"))),
        F.struct(F.lit("endpoint").alias("metric"), F.col("endpoint").alias("value")),
        F.struct(F.lit("status").alias("metric"), F.col("status").alias("value")),
    ))
    return log.select(F.inline(names), "latency", "ts").groupBy("metric", "value").agg(
        F.count("*").alias("calls"), F.round(F.avg("latency"), 6).alias("mean_latency"), F.max("ts").cast("string").alias("last_seen")
    )


def settle_requests(events: DataFrame) -> DataFrame:
    """Last status of each request: request_id, user_id, day, units, and (seq, status) events."""
    return events.groupBy("request_id", "user_id", "day", "units").agg(F.max(F.struct("seq", "status")).alias("last")).withColumn("status", F.col("last.status")).drop("last")


def quota_ledger(settled: DataFrame) -> DataFrame:
    """Daily used and reserved units per user; refunded requests consume nothing."""
    units = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("units"))), F.lit(0))
    return settled.groupBy("user_id", "day").agg(units("settled").alias("used"), units("reserved").alias("reserved"))


def quota_snapshot(users: DataFrame, ledger: DataFrame) -> DataFrame:
    """Remaining units on the last day each user was active: limit + bonus - used - reserved, at least 0."""
    last = ledger.groupBy("user_id").agg(F.max_by(F.struct("used", "reserved"), "day").alias("q"))
    zero = lambda c: F.coalesce(F.col(f"q.{c}"), F.lit(0))
    return users.join(last, "user_id", "left").select("user_id", F.greatest(F.lit(0), F.col("quota") + F.col("bonus") - zero("used") - zero("reserved")).cast("long").alias("remaining"))


def send_throttle(events: DataFrame, cooldown: int, daily: int, seconds: int = 86400) -> DataFrame:
    """Per event: seconds since the user's previous event, events in the last 24 hours, and whether it may be sent.

    A user's events are cut into day buckets; each bucket also gets the day before as context, so a
    busy user is spread over many tasks instead of one window.
    """
    bucket = F.floor(F.col("epoch") / seconds)
    spread = events.withColumn("own", bucket).withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))
    w = W.partitionBy("user_id", "bucket").orderBy("epoch")
    within = w.rangeBetween(-seconds, 0)
    ordered = W.partitionBy("user_id", "bucket").orderBy("epoch", "event_id")
    seen = spread.withColumn("previous", F.lag("epoch").over(ordered)).withColumn("recent", F.count("*").over(within))
    gap = F.col("epoch") - F.col("previous")
    out = seen.where(F.col("own") == F.col("bucket"))
    recent_gap = F.when(gap <= seconds, gap)
    return out.select("event_id", F.coalesce(recent_gap, F.lit(-1)).alias("since_previous"), "recent", ((F.coalesce(recent_gap, F.lit(cooldown)) >= cooldown) & (F.col("recent") <= daily)).alias("allowed"))


def llm_usage(ledger: DataFrame) -> DataFrame:
    """Tokens, null-safe cache ratio, latency and errors by stage and attempt."""
    return ledger.groupBy("stage", "attempt").agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").cast("long").alias("prompt_tokens"), F.sum("hit_tokens").cast("long").alias("hit_tokens"),
        F.round(F.sum("hit_tokens") / F.nullif(F.sum("prompt_tokens"), F.lit(0)), 6).alias("cache_hit_ratio"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency"), F.count_if(~F.col("success")).alias("errors"),
    )


def stale_release(requests: DataFrame, settlements: DataFrame, minutes: int) -> DataFrame:
    """Requests without a settlement inside the limit become refunded errors; deep requests are exempt."""
    done = settlements.groupBy("request_id").agg(F.min("settled_at").alias("settled_at"))
    joined = requests.join(done, "request_id", "left")
    late = F.col("settled_at").isNull() | (F.col("settled_at") > F.col("opened_at") + minutes * 60)
    stale = late & (F.col("mode") != "deep")
    return joined.select("request_id", F.when(stale, "error").otherwise("open").alias("status"), F.when(stale, F.col("units")).otherwise(0).cast("long").alias("refunded"))


def latest_status(events: DataFrame, key: str, order: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by("status", order).alias("status"), F.max(order).alias("at"))
