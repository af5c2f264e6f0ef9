"""Streaming operators over job events: minute counters, first-seen dedup, queue filter, token bucket."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTED = {"completed": "job.completed", "failed": "job.failed", "retried": "job.retrying"}


def timed(events: DataFrame) -> DataFrame:
    """Event time as watermarks want it; the session's zone is UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp_ltz"))


def minute_counters(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(queue, bucket_ts, completed, failed, retried) of each minute with a counted event; streaming or batch."""
    counted = timed(events.where(F.col("type").isin(*COUNTED.values()))).withWatermark("ts", late)
    sums = [F.count(F.when(F.col("type") == kind, 1)).alias(name) for name, kind in COUNTED.items()]
    out = counted.groupBy("queue", F.window("ts", "1 minute").alias("_w")).agg(*sums)
    return out.select("queue", F.col("_w.start").cast("timestamp_ntz").alias("bucket_ts"), *COUNTED)


def in_queues(events: DataFrame, queues: list[str]) -> DataFrame:
    """Events of the named queues; all of them for an empty list."""
    return events.where(F.col("queue").isin(*queues)) if queues else events


def first_seen(events: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """The first event of each key within ``ttl`` (streaming only); state leaves with the watermark."""
    return timed(events).withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def token_bucket(events: DataFrame, per_second: float, burst: int) -> DataFrame:
    """(queue, event_id, ts, admitted) by a continuously refilled bucket for each queue (streaming only).

    The state is two numbers a queue. Within a micro-batch a queue's events are
    taken by time; an event older than the bucket's clock sets that back and
    refills nothing. A rate or burst of zero or less admits everything.
    """
    shape = "queue string, event_id long, ts timestamp_ntz, admitted boolean"
    named = events.select("queue", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    if per_second <= 0 or burst <= 0:
        return named.withColumn("admitted", F.lit(True))

    def admit(key, parts, state):
        tokens, clock = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for now in rows["ts"].astype("datetime64[us]").astype("int64"):
            if clock is not None and now > clock:
                tokens = min(float(burst), tokens + (now - clock) / 1e6 * per_second)
            clock = now
            out.append(tokens >= 1)
            tokens -= out[-1]
        state.update((float(tokens), int(clock)))
        yield rows[["event_id", "ts"]].assign(queue=key[0], admitted=out)[["queue", "event_id", "ts", "admitted"]]

    return named.groupBy("queue").applyInPandasWithState(admit, shape, "tokens double, clock long", "append", "NoTimeout")
