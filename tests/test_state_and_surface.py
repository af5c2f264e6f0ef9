"""Cron, streams with state, timers, sinks and handlers against plain Python."""

import datetime as dt
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.functions import schedules, texts
from taskloom.operators import handlers, policies, trees
from taskloom.sources import sinks
from taskloom.streaming import state


def slow_next(cron, at):
    """Minute by minute."""
    t = at.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    for _ in range(60 * 24 * 400):
        days = [t.day in cron.day, (t.weekday() + 1) % 7 in cron.weekday]
        if t.month in cron.month and (all(days) if cron.both else any(days)) and 60 * t.hour + t.minute in cron.minutes:
            return t
        t += dt.timedelta(minutes=1)


def micros(t):
    return int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.mark.parametrize("text", ["* * * * *", "*/7 3-5 * * *", "0 0 1,15 * mon", "30 4 31 * *", "5 */6 * jan-mar 0", "0 12 * * */2", "15 10 13 * 5"])
def test_next_cron(text):
    cron, rng = schedules.Cron.parse(text), random.Random(3)
    at = [dt.datetime(2023, 12, 28) + dt.timedelta(seconds=rng.randrange(86400 * 100)) for _ in range(6)]
    at += [dt.datetime(2024, 2, 28, 23, 59, 59), dt.datetime(2024, 1, 1), dt.datetime(1969, 12, 31, 12)]
    fire, there = cron.next(np.array([micros(t) for t in at]))
    assert there.all() and list(fire) == [micros(slow_next(cron, t)) for t in at]


def test_cron_bounds():
    for bad in ["* * * *", "60 * * * *", "* * 0 * *", "* * * * 7", "5-3 * * * *", "*/0 * * * *", "x * * * *", "@hourly"]:
        with pytest.raises(ValueError):
            schedules.Cron.parse(bad)
    _, there = schedules.Cron.parse("0 0 30 2 *").next(np.array([0]))
    assert not there[0]  # no 30 February
    fire, there = schedules.Cron.parse("0 0 29 2 *").next(np.array([micros(dt.datetime(2097, 1, 1))]))
    assert not there[0]  # 2100 has no leap day, 2104 is over five years on


def test_seed_leaves_one_fire():
    cron = schedules.Cron.parse("0 * * * *")
    h = lambda k, m=0: micros(dt.datetime(2024, 1, 1)) + k * 3_600_000_000 + m * 60_000_000
    now = np.array([h(10, 30)] * 4)
    got = cron.seed(np.array([h(3, 5), h(9, 30), h(10), h(8)]), now)
    assert list(got) == [h(9), h(9, 30), h(10), h(9)]
    far = np.array([h(0)])
    assert cron.seed(far, far + 100_001 * 3_600_000_000)[0] == far[0] + 100_001 * 3_600_000_000
    assert cron.seed(far, far + 100_000 * 3_600_000_000)[0] == far[0] + 99_999 * 3_600_000_000


def test_next_cron_keeps_null(spark):
    rows = spark.createDataFrame([(1, None), (2, dt.datetime(2024, 1, 1, 0, 0, 30))], "k int, t timestamp_ntz")
    got = dict(rows.select("k", schedules.next_cron("0 0 * * *")("t")).collect())
    assert got == {1: None, 2: dt.datetime(2024, 1, 2)}


def test_prose(spark):
    want = {
        None: None, "": "", "0 0 * * *": "every day at midnight", "0 12 * * 7": "every Sunday at noon", "30 13 * * *": "every day at 1:30 PM", "*/1 * * * *": "every 1 minute",
        "7 */2 * * *": "every 2 hours at minute 7", "0 */1 * * *": "every 1 hour", "61 1 * * *": "61 1 * * *", "0 9 15 * *": "every month on day 15 at 9 AM", "0 9 15 * 1": "0 9 15 * 1", " 1 2 3 ": "1 2 3",
        "05 00 * * *": "every day at 12:05 AM", "5 23 * * 0": "every Sunday at 11:05 PM", "0 24 * * *": "0 24 * * *", "0 * * * *": "every hour", " 0\t12  1 * * ": "every month on day 1 at noon", "0 12 1 5 *": "0 12 1 5 *",
    }
    rows = spark.createDataFrame([(k,) for k in want], "c string")
    assert dict(rows.select("c", schedules.prose(F.col("c"))).collect()) == want


def test_codec_and_errors(spark):
    key, other = (texts.aes(F.lit(k).cast("binary")) for k in ("0123456789abcdef", "fedcba9876543210"))
    rows = spark.createDataFrame([("boom é",), ("",), (None,)], "t string")
    for tag in ("enc:", "x:"):
        stored = texts.encode_error(key, F.col("t"), tag)
        r = rows.select("t", texts.decode_error(key, stored, tag).alias("same"), texts.decode_error(other, stored, tag).alias("wrong"), texts.decode_error(key, F.concat(F.lit("p "), F.col("t")), tag).alias("plain")).collect()
        assert [x.same for x in r] == ["boom é", "", None] and [x.wrong for x in r] == [None, "", None] and r[0].plain == "p boom é"
    assert texts.IDENTITY.identity


def test_json_equal_and_stamps(spark):
    pairs = [('{"a":1,"b":2}', '{"b":2.0,"a":1}'), ("[1,2]", "[2,1]"), ("1", "true"), ("x", "1"), (None, "1")]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").coalesce(1)
    got = dict(rows.select("k", texts.json_equal(F.col("a"), F.col("b"))).collect())
    assert got == {0: True, 1: False, 2: False, 3: None, 4: None}
    stamps = {"2024-01-02T03:04:05Z": 1704164645_000000, "2024-01-02 03:04:05.5+01:00": 1704161045_500000, "2024-13-02T03:04:05Z": None, "2024-01-02": None, "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in stamps], "t string")
    assert dict(rows.select("t", texts.parse_stamp(F.col("t"))).collect()) == stamps


def test_handlers(spark):
    def job(args):
        if args == 1:
            raise handlers.NoRetry("stop")
        return "x" * handlers.MAX_RESULT if args == 2 else None if args == 3 else args["a"]

    rows = spark.createDataFrame([(k, p) for k, p in enumerate([None, "", "{", "1", "2", "3", '{"a":[1]}', "{}"])], "k int, p string")
    got = {r.k: (r.o.result, r.o.kind) for r in rows.select("k", handlers.outcome(job)("p").alias("o")).collect()}
    assert got == {0: (None, "no_retry"), 1: (None, "no_retry"), 2: (None, "retry"), 3: (None, "no_retry"), 4: (None, "no_retry"), 5: (None, ""), 6: ("[1]", ""), 7: (None, "retry")}
    parents = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "id long, n int")
    assert sorted(map(tuple, handlers.fan_out(parents, F.col("n"), "c").collect())) == [(1, 0, "c"), (1, 1, "c")]


def drain(stream, tmp_path):
    name = "t_" + "".join(c if c.isalnum() else "_" for c in tmp_path.name)
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


@pytest.mark.parametrize(
    ("step", "held", "schema"),
    [
        (state.status_step, "status string", "key long, event_id long, before string, after string"),
        (state.lock_step(40), "holder long, expires long, dead boolean", "key long, event_id long, holder long"),
        (state.bucket_step(50_000.0, 2), "tokens double, clock long", "key long, event_id long, admitted boolean"),
    ],
)
def test_stream_equals_batch(spark, tmp_path, step, held, schema):
    rng = random.Random(5)
    kinds = ["job.started", "job.completed", "job.failed", "job.retrying", "job.paused", "job.resumed", "job.requeued", "job.cancelled"]
    rows = [(rng.choice([1, 1, 1, 2, 3]), k, rng.choice(kinds), k * 7) for k in range(300)]
    batch = spark.createDataFrame([*rows, (None, 999, "job.started", 1)], "key long, event_id long, type string, at long")
    for k in range(3):
        batch.where(F.col("event_id").between(100 * k, 100 * k + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, state.in_batch(batch, step, schema).collect()))
    assert len(want) > 200 and sorted(map(tuple, drain(state.in_stream(stream, step, held, schema), tmp_path))) == want
    # and one key by hand
    kept, by_hand = None, []
    for row in batch.where("key = 1").orderBy("at").toPandas().itertuples(index=False):
        kept, made = step(kept, row)
        by_hand += made
    assert sorted(map(tuple, by_hand)) == [w for w in want if w[0] == 1]


def test_lock_passes_on_from_a_dead_holder(spark):
    rows = [(1, 10, "job.started", 0), (1, 11, "job.started", 5), (1, 12, "job.failed", 6), (1, 13, "job.started", 7), (1, 14, "job.started", 106), (1, 15, "job.started", 107)]
    got = state.in_batch(spark.createDataFrame(rows, "key long, event_id long, type string, at long"), state.lock_step(100), "key long, event_id long, holder long")
    assert {r.event_id: r.holder for r in got.collect()} == {10: 10, 11: 10, 13: 13, 14: 13, 15: 15}


def test_timers(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [
        [(1, 1, "wait", at(0), 60.0), (2, 2, "wait", at(0), 60.0), (3, 3, "sleep", at(0), 60.0), (4, 4, "signal", at(0), 0.0), (5, 5, "wait", at(0), 86400.0)],
        [(2, 6, "signal", at(30), 0.0), (3, 7, "signal", at(30), 0.0), (4, 8, "wait", at(31), 60.0)],
        [(9, 9, "signal", at(3600), 0.0)],
        [(9, 10, "signal", at(3601), 0.0)],
    ]
    schema = "key long, event_id long, kind string, ts timestamp, seconds double"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.key: (r.outcome, r.event_id, r["at"]) for r in drain(state.timers(stream), tmp_path)}
    assert got == {1: ("timed_out", None, at(60)), 2: ("signal", 6, at(30)), 3: ("woke", None, at(60)), 4: ("signal", 4, at(31))}


def test_sinks(spark, tmp_path):
    rows = spark.range(10)
    for _ in range(2):  # a retry replaces the first try
        sinks.append_once(rows, str(tmp_path / "out"), 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    for _ in range(2):
        sinks.write_stream(stream, str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10
    assert sinks.completion_bounds(10**6, 0) == (4096, 1) and sinks.completion_bounds(0, 10**6) == (1, 5000)


def test_hot_cache():
    now, loads = [0.0], []
    cache = sinks.HotCache(2, lambda: now[0])
    load = lambda: loads.append(1) or len(loads)
    assert [cache.get("a", load), cache.get("a", load)] == [1, 1]
    now[0] = 2.0
    assert cache.get("a", load) == 2
    with pytest.raises(ZeroDivisionError):
        cache.get("b", lambda: 1 / 0)
    assert cache.get("b", load) == 3


def test_trees(spark):
    # a chain of 40, a cycle, a missing parent, a shortcut to a shared child
    rows = [(k, k - 1 if k else None) for k in range(40)] + [(100, 101), (101, 100), (102, 101), (200, 999)]
    jobs = spark.createDataFrame(rows, "id long, parent_job_id long")
    root = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert {r.id: r.depth for r in trees.subtree(jobs, root(35, 37)).collect()} == {35: 0, 37: 0, 36: 1, 38: 1, 39: 2}
    assert {r.id: r.depth for r in trees.subtree(jobs, root(100)).collect()} == {100: 0, 101: 1, 102: 2}
    assert trees.subtree(jobs, root()).count() == 0
    up = {r.start_id: (r.root, r.hops) for r in trees.climb(jobs, root(0, 1, 39, 100, 102, 200)).collect()}
    assert up == {0: (0, 0), 1: (0, 1), 39: (0, 39)}
    assert trees.climb(jobs, root(39), max_hops=38).count() == 0
    few = trees.shown(jobs, root(0), 5).collect()
    assert [r.id for r in few] == [1, 2, 3, 4, 5] and all(r.truncated for r in few)
    assert not any(r.truncated for r in trees.shown(jobs, root(34), 5).collect())


def test_slots_and_mailbox_by_hand(spark):
    shape = "key long, event_id long, type string, worker long, at long"
    rows = [(1, 1, "", 7, 0), (1, 2, "", 8, 5), (1, 3, "", 9, 6), (1, 4, "", 7, 9), (1, 5, "", 9, 15), (1, 6, "", 8, 16), (1, 7, "", 7, 19), (1, 8, "", 8, 25)]
    got = state.in_batch(spark.createDataFrame(rows, shape), state.slot_step(2, 10), "key long, event_id long, admitted boolean")
    # 9 waits until the lease of 8 ends at 15, then 8 is out until one of 7 (renewed to 29) or 9 (25) ends
    assert {r.event_id: r.admitted for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: True}
    kinds = ["job.completed", "job.started", "job.started", "job.failed", "job.completed", "job.completed", "job.completed"]
    got = state.in_batch(spark.createDataFrame([(1, k, t, 0, k) for k, t in enumerate(kinds)], shape), state.mailbox_step, "key long, event_id long, taken long, depth long")
    assert [(r.taken, r.depth) for r in got.orderBy("event_id").collect()] == [(None, 0), (None, 1), (None, 2), (None, 2), (1, 1), (2, 0), (None, 0)]


def test_keyed_merges(spark, tmp_path):
    path, shape = str(tmp_path / "t"), "k long, v long"
    for n, rows in enumerate([[(1, 1), (2, 2)], [], [(2, 5), (3, None)]]):
        for _ in range(2):  # a retry
            sinks.append_once(spark.createDataFrame(rows, shape), path, n)
    assert sorted(map(tuple, sinks.newest(sinks.batches(spark, path, shape), ["k"]).collect())) == [(1, 1), (2, 5), (3, None)]
    assert sorted(map(tuple, sinks.added(sinks.batches(spark, path, shape), ["k"]).collect())) == [(1, 1), (2, 7), (3, None)]


def test_single_flight():
    cache, loads, gate = sinks.HotCache(60), [], threading.Event()

    def load():
        loads.append(1)
        gate.wait(5)
        return len(loads)

    with ThreadPoolExecutor(4) as pool:
        calls = [pool.submit(cache.get, "a", load) for _ in range(4)]
        gate.set()
        assert [c.result() for c in calls] == [1] * 4 and len(loads) == 1


def test_policies(spark):
    rows = spark.createDataFrame([(0, None, None), (1, "", False), (9, "boom", False), (2, "ok", False), (3, "", True)], "n int, e string, p boolean")
    odd = lambda n, e: F.when(e == "boom", -5)
    got = rows.select(
        policies.retry_delay(F.col("n"), F.col("e")).alias("a"), policies.retry_delay(F.col("n"), F.col("e"), odd).alias("b"),
        policies.is_failure(F.col("e"), F.col("p"), lambda e: F.when(e == "ok", False)).alias("f"), policies.partition_key("cap", [F.col("e")], F.col("n") > 1).alias("k"),
    ).collect()
    assert [r.a for r in got] == [1, 2, 60, 4, 8] and {r.b for r in got} == {0.0}
    assert [r.f for r in got] == [False, False, True, False, True] and [r.k for r in got] == ["", "", "cap:boom", "cap:ok", "cap:"]
    mark = lambda name: lambda df, then: then(df.withColumn("t", F.concat("t", F.lit(name))))
    stop = lambda df, then: df
    start = spark.createDataFrame([("",)], "t string")
    end = lambda df: df.withColumn("t", F.concat("t", F.lit(".")))
    assert policies.chain(start, [mark("a"), mark("b")], end).first().t == "ab." and policies.chain(start, [mark("a"), stop, mark("b")], end).first().t == "a"
    assert policies.chain(start, [], end).first().t == "."
    with pytest.raises(ValueError):
        policies.Hooks().on("nothing", print)
