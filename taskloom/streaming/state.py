"""Keyed recurrences, one step function for batch and stream, and event-time timers.

A step takes (state or None, row) and returns (state, output rows). Rows carry
their time as ``at``, epoch microseconds. A recurrence is sequential by nature:
a key's rows go through one task in order, streamed in Arrow batches, so memory
doesn't grow with a key but a hot key's time does.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Step = Callable[[tuple | None, object], tuple[tuple, list[tuple]]]

# fixed values: which event moves a job from which status to which
MOVES = {
    ("pending", "job.started"): "running",
    ("running", "job.completed"): "completed",
    ("running", "job.failed"): "failed",
    ("running", "job.retrying"): "pending",
    ("running", "job.waiting"): "waiting",
    ("waiting", "job.resumed"): "pending",
    ("paused", "job.resumed"): "pending",
    ("pending", "job.paused"): "paused",
    ("waiting", "job.paused"): "paused",
    ("pending", "job.cancelled"): "cancelled",
    ("waiting", "job.cancelled"): "cancelled",
    ("running", "job.cancelled"): "cancelled",
    ("failed", "job.requeued"): "pending",
    ("cancelled", "job.requeued"): "pending",
}


def bucket_step(per_second: float, burst: int) -> Step:
    """(key, event_id, admitted) of a continuously refilled bucket."""

    def step(state, row):
        tokens, clock = state or (float(burst), row.at)
        if row.at > clock:
            tokens = min(float(burst), tokens + (row.at - clock) / 1e6 * per_second)
        admitted = tokens >= 1
        return (tokens - admitted, row.at), [(row.key, row.event_id, admitted)]

    return step


def lock_step(ttl: int) -> Step:
    """(key, event_id, holder) for each enqueue: itself if it takes the lock, else the job that holds it.

    A lock is taken when there is none, when it has expired, or when its holder
    has failed or was cancelled or deleted.
    """

    def step(state, row):
        holder, expires, dead = state or (0, 0, True)
        if row.type in ("job.failed", "job.cancelled", "job.deleted"):
            return (holder, expires, True), []
        if dead or expires <= row.at:
            holder, expires, dead = row.event_id, row.at + ttl, False
        return (holder, expires, dead), [(row.key, row.event_id, holder)]

    return step


def slot_step(limit: int, ttl: int) -> Step:
    """(key, event_id, admitted) of leases on ``limit`` slots; a lease with one slot has one owner.

    A holder that is live renews; else it's admitted if a slot is free or has
    expired. The state is at most ``limit`` leases.
    """

    def step(state, row):
        held = {w: e for w, e in zip(*state, strict=True) if e > row.at} if state else {}
        admitted = row.worker in held or len(held) < limit
        if admitted:
            held[int(row.worker)] = int(row.at + ttl)
        return (list(held), list(held.values())), [(row.key, row.event_id, admitted)]

    return step


def mailbox_step(state, row):
    """(key, event_id, taken, depth) of a first-in first-out mailbox: 'job.started' sends the event's id, 'job.completed' takes the oldest.

    The state is the signals that nobody took yet.
    """
    box, taken = list(state[0]) if state else [], None
    if row.type == "job.started":
        box.append(int(row.event_id))
    elif row.type == "job.completed" and box:
        taken = box.pop(0)
    return (box,), [(row.key, row.event_id, taken, len(box))]


def status_step(state, row):
    """(key, event_id, before, after) of a job's status; an event that may not move it leaves it."""
    (before,) = state or ("pending",)
    after = MOVES.get((before, row.type), before)
    return (after,), [(row.key, row.event_id, before, after)]


def in_batch(rows: DataFrame, step: Step, schema: str) -> DataFrame:
    """The outputs of all keys; rows of a key in the order of (at, event_id)."""
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]

    def walk(parts):
        # a key's rows arrive in order
        key, state = None, None
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                if row.key != key:
                    key, state = row.key, None
                state, made = step(state, row)
                out += made
            yield pd.DataFrame(out, columns=names)

    return rows.where(F.col("key").isNotNull()).repartition("key").sortWithinPartitions("key", "at", "event_id").mapInPandas(walk, schema)


def in_stream(rows: DataFrame, step: Step, state_schema: str, schema: str) -> DataFrame:
    """The same on a stream; a key's rows of one micro-batch are taken in order, so bound it by the source's trigger."""
    names = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]

    def walk(_, parts, held):
        state, out = held.get if held.exists else None, []
        for row in pd.concat(list(parts)).sort_values(["at", "event_id"]).itertuples(index=False):
            state, made = step(state, row)
            out += made
        held.update(tuple(x.item() if hasattr(x, "item") else x for x in state))
        yield pd.DataFrame(out, columns=names)

    return rows.where(F.col("key").isNotNull()).groupBy("key").applyInPandasWithState(walk, schema, state_schema, "append", "NoTimeout")


def timers(rows: DataFrame, late: str = "1 minute") -> DataFrame:
    """(key, outcome, event_id, at) of waits with a deadline and of sleeps; streaming only.

    Rows: (key, event_id, kind, ts, seconds), kind 'wait', 'sleep' or 'signal'.
    A key's first wait or sleep fixes the deadline at its time plus ``seconds``.
    A wait ends with the earliest signal, also one sent before it, or at its
    deadline; a signal that is there when the deadline passes wins. A sleep ends
    at its deadline only. Later waits of the key are ignored.
    """

    def walk(key, parts, held):
        deadline, kind, signal, done = held.get if held.exists else (None, None, None, False)
        ended = []
        if held.hasTimedOut:
            if not done:
                ended, done = [(key[0], "woke" if kind == "sleep" else "timed_out", None, pd.Timestamp(deadline, unit="ms"))], True
        else:
            for row in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples(index=False):
                if row.kind == "signal":
                    signal = int(row.event_id) if signal is None else signal
                    now = row.ts
                elif kind is None:
                    kind, deadline = row.kind, int(row.ts.timestamp() * 1000 + row.seconds * 1000)
                    now = row.ts
                else:
                    continue
                if kind == "wait" and signal is not None and not done:
                    ended, done = [(key[0], "signal", signal, now.tz_localize(None))], True
            if kind is not None and not done and deadline <= held.getCurrentWatermarkMs():
                ended, done = [(key[0], "woke" if kind == "sleep" else "timed_out", None, pd.Timestamp(deadline, unit="ms"))], True
        held.update((deadline, kind, signal, done))
        if kind is not None and not done:
            held.setTimeoutTimestamp(deadline)
        yield pd.DataFrame(ended, columns=["key", "outcome", "event_id", "at"]).astype({"event_id": "Int64", "at": "datetime64[us]"})

    named = rows.select("key", "event_id", "kind", F.col("ts").cast("timestamp_ltz").alias("ts"), "seconds").withWatermark("ts", late)
    return named.groupBy("key").applyInPandasWithState(
        walk, "key long, outcome string, event_id long, at timestamp_ntz", "deadline long, kind string, signal long, done boolean", "append", "EventTimeTimeout"
    )
