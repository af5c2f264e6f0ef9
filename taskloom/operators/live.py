"""Queries that run as streams until their source is read, writes that are read back, and the user surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.operators import extended, handlers, policies, surface
from taskloom.sources import fixtures, sinks
from taskloom.streaming import events, state

ALL: dict[str, tuple] = {}  # name -> (Spark callable, oracle SQL)
AT = "timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', ts)"
WORKERS, SLOTS, TTL = 4, 2, 86_400_000_000


def _query(name: str, oracle: str):
    def keep(f):
        ALL[name] = f, fixtures.expand(oracle)
        return f

    return keep


def _drained(rows: DataFrame, name: str, **how) -> DataFrame:
    return sinks.drained(rows, name, **how).drop("batch")


# -- streams

_query("src_events", "select event_id, ts, queue, job_id, type from f_events")(
    lambda spark, sf_dir: _drained(fixtures.stream(spark, sf_dir, "f_events").select("event_id", "ts", "queue", "job_id", "type"), "src_events")
)
_query("snk_watch_events", "select event_id, queue, type from f_events where queue in ('q0', 'q2')")(
    lambda spark, sf_dir: _drained(events.in_queues(fixtures.stream(spark, sf_dir, "f_events"), ["q0", "q2"]).select("event_id", "queue", "type"), "snk_watch_events")
)


@_query("str_source", "select queue, count(*) as published, count(*) as delivered, cast(0 as bigint) as dropped from f_events group by queue")
def _source(spark, sf_dir):
    """The source replays, so a slow subscriber drops nothing."""
    got = _drained(fixtures.stream(spark, sf_dir, "f_events").select("queue"), "str_source")
    sent = fixtures.view(spark, sf_dir, "f_events").groupBy("queue").agg(F.count("*").alias("published"))
    got = got.groupBy("queue").agg(F.count("*").alias("delivered"))
    return sent.join(got, "queue", "full").select("queue", "published", "delivered", (F.col("published") - F.coalesce("delivered", F.lit(0))).alias("dropped"))


@_query("str_flush_retry", "select queue, cast(sum(completed) as bigint) as completed, cast(sum(failed) as bigint) as failed from f_job_stats group by queue")
def _flushed(spark, sf_dir):
    """Counters whose first flush fails after it wrote; the next run writes the batch again in its place."""
    counted = fixtures.stream(spark, sf_dir, "f_events").select("queue", F.col("type").alias("kind")).where(F.col("kind").isin(*events.COUNTED.values()))
    tried: list[int] = []

    def flush(rows: DataFrame, path: str, batch: int) -> None:
        sinks.append_once(rows, path, batch)
        tried.append(batch)
        if len(tried) == 1:
            raise OSError("flush failed")

    rows = _drained(counted, "str_flush_retry", write=flush, tries=2)
    sums = [F.count(F.when(F.col("kind") == events.COUNTED[c], 1)).alias(c) for c in ("completed", "failed")]
    return rows.groupBy("queue").agg(*sums)


@_query(
    "str_depth_snapshot",
    "select queue, AS_OF as bucket_ts, count(case when status = 'pending' then 1 end) as pending, count(case when status = 'running' then 1 end) as running from f_jobs group by queue",
)
def _depths(spark, sf_dir):
    """Each trigger of the event stream writes the depths of that time; the newest snapshot of a minute holds."""
    depths = fixtures.run(spark, sf_dir, "select queue, AS_OF as bucket_ts, count(case when status = 'pending' then 1 end) as pending, count(case when status = 'running' then 1 end) as running from f_jobs group by queue")
    ticks = fixtures.stream(spark, sf_dir, "f_events").select("event_id")
    path = sinks.new_table(spark, "depths")
    sinks.write_stream(ticks, path, path + "-state", write=lambda _, to, batch: sinks.append_once(depths, to, batch)).awaitTermination()
    return sinks.newest(sinks.batches(spark, path, depths.schema), ["queue", "bucket_ts"])


@_query(
    "str_rate_window",
    "select queue, cast(date_trunc('minute', ts) as timestamp) as window_start, least(count(*), 2) as admitted, greatest(count(*) - 2, 0) as denied from f_events group by queue, cast(date_trunc('minute', ts) as timestamp)",
)
def _windows(spark, sf_dir):
    """Counts of a window live in the state for two windows; each trigger writes those that changed."""
    rows = events.timed(fixtures.stream(spark, sf_dir, "f_events")).withWatermark("ts", "2 minutes")
    counts = rows.groupBy("queue", F.window("ts", "1 minute").alias("_w")).agg(F.count("*").alias("n"))
    counts = counts.select("queue", F.col("_w.start").cast("timestamp_ntz").alias("window_start"), "n")
    last = sinks.newest(sinks.drained(counts, "str_rate_window", mode="update"), ["queue", "window_start"])
    return last.select("queue", "window_start", F.least("n", F.lit(2)).alias("admitted"), F.greatest(F.col("n") - 2, F.lit(0)).alias("denied"))


def _steps(spark, sf_dir, name: str, key: str, step, held: str, schema: str) -> DataFrame:
    rows = fixtures.stream(spark, sf_dir, "f_events").selectExpr(f"{key} as key", "event_id", "type", f"event_id % {WORKERS} as worker", f"{AT} as at")
    return _drained(state.in_stream(rows, step, held, schema), name)


_BY = f"(e.event_id % {WORKERS})"
_LIVE = " ".join(f"when w.h{k} = {_BY} and w.e{k} > e.us then {k}" for k in range(1, SLOTS + 1))
_FREE = " ".join(f"when w.e{k} <= e.us then {k}" for k in range(1, SLOTS + 1))
_SLOT = f"(case {_LIVE} {_FREE} else 0 end)"
_query(
    "str_slots",
    surface._steps(
        "job_id",
        f"event_id % {WORKERS} as h1, us + {TTL} as e1, cast(-1 as bigint) as h2, cast(0 as bigint) as e2, true as admitted",
        ", ".join(f"case when {_SLOT} = {k} then {_BY} else w.h{k} end, case when {_SLOT} = {k} then e.us + {TTL} else w.e{k} end" for k in range(1, SLOTS + 1)) + f", {_SLOT} > 0",
        "admitted",
    ),
)(lambda spark, sf_dir: _steps(spark, sf_dir, "str_slots", "job_id", state.slot_step(SLOTS, TTL), "holders array<long>, expires array<long>", "key long, event_id long, admitted boolean"))

_MINE = f"(w.owner = {_BY} or w.until <= e.us)"
_query(
    "str_lease",
    surface._steps("job_id", f"event_id % {WORKERS} as owner, us + {TTL} as until, true as admitted", f"case when {_MINE} then {_BY} else w.owner end, case when {_MINE} then e.us + {TTL} else w.until end, {_MINE}", "admitted"),
)(lambda spark, sf_dir: _steps(spark, sf_dir, "str_lease", "job_id", state.slot_step(1, TTL), "holders array<long>, expires array<long>", "key long, event_id long, admitted boolean"))

_query(
    "str_signal_mailbox",
    surface._steps(
        "job_id",
        "case when type = 'job.started' then [event_id] else cast([] as bigint[]) end as box, cast(null as bigint) as taken",
        "case when e.type = 'job.started' then list_append(w.box, e.event_id) when e.type = 'job.completed' then w.box[2:] else w.box end, case when e.type = 'job.completed' then w.box[1] end",
        "taken, len(box) as depth",
    ),
)(lambda spark, sf_dir: _steps(spark, sf_dir, "str_signal_mailbox", "job_id", state.mailbox_step, "box array<long>", "key long, event_id long, taken long, depth long"))

_query("str_token_bucket", surface.BUCKET_ORACLE)(
    lambda spark, sf_dir: _steps(spark, sf_dir, "str_token_bucket", "queue", state.bucket_step(*surface.BUCKET), "tokens double, clock long", "key string, event_id long, admitted boolean")
)

_WAITS = "select id, created_at, created_at + cast(id % 2000 as int) * interval '1' day as deadline from f_jobs where status = 'waiting'"
_SENT = "select job_id, id, created_at from f_signals where consumed_at is null and name = 'user'"


def _timers(spark, sf_dir, name: str, kind: str) -> DataFrame:
    """The waits or sleeps and the signals as a stream that ends with a row of the clock, which moves the watermark just past AS_OF.

    A wait that starts later is told at AS_OF, with its own deadline, so that it doesn't move the clock.
    """
    waits = fixtures.run(spark, sf_dir, f"select id as key, id as event_id, '{kind}' as kind, least(created_at, AS_OF) as ts, cast(timestampdiff(SECOND, least(created_at, AS_OF), deadline) as double) as seconds from ({_WAITS}) x")
    sent = fixtures.run(spark, sf_dir, f"select job_id as key, id as event_id, 'signal' as kind, created_at as ts, cast(0 as double) as seconds from ({_SENT}) x")
    clock = fixtures.run(spark, sf_dir, "select cast(-1 as bigint) as key, cast(-1 as bigint) as event_id, 'signal' as kind, AS_OF + interval '61' second as ts, cast(0 as double) as seconds")
    path = sinks.new_table(spark, name + "-in")
    rows = waits.unionByName(sent).unionByName(clock)
    sinks.append_once(rows, path, 0)
    return _drained(state.timers(spark.readStream.schema(rows.schema).parquet(path + "/batch=0")), name)


@_query(
    "str_signal_timeout",
    f"""select w.id, s.signal_id, case when s.signal_id is not null then 'signal' when w.deadline <= AS_OF then 'timed_out' else 'waiting' end as outcome
        from ({_WAITS}) w left join (select job_id, min(id) as signal_id from ({_SENT}) y group by job_id) s on s.job_id = w.id""",
)
def _waited(spark, sf_dir):
    ended = _timers(spark, sf_dir, "str_signal_timeout", "wait").select(F.col("key").alias("id"), F.col("event_id").alias("signal_id"), "outcome")
    waits = fixtures.run(spark, sf_dir, f"select id from ({_WAITS}) x")
    return waits.join(ended, "id", "left").select("id", "signal_id", F.coalesce("outcome", F.lit("waiting")).alias("outcome"))


@_query("str_durable_timer", f"select id, deadline as wake_at, deadline <= AS_OF as woke from ({_WAITS}) x")
def _slept(spark, sf_dir):
    ended = _timers(spark, sf_dir, "str_durable_timer", "sleep").select(F.col("key").alias("id"), F.col("at"))
    waits = fixtures.run(spark, sf_dir, f"select id, deadline from ({_WAITS}) x")
    return waits.join(ended, "id", "left").select("id", F.coalesce("at", "deadline").alias("wake_at"), F.col("at").isNotNull().alias("woke"))


@_query(
    "str_resume",
    "select distinct j.id from f_jobs j left join f_signals s on s.job_id = j.id and s.consumed_at is null where j.status = 'waiting' and (s.id is not null or j.run_at <= AS_OF)",
)
def _resumed(spark, sf_dir):
    """Signals as a stream against the waiting jobs as they are, and what is due by the clock."""
    sent = fixtures.stream(spark, sf_dir, "f_signals").where(F.col("consumed_at").isNull()).select(F.col("job_id").alias("id"))
    woken = _drained(sent.join(fixtures.run(spark, sf_dir, "select id from f_jobs where status = 'waiting'"), "id").dropDuplicates(["id"]), "str_resume")
    return woken.union(fixtures.run(spark, sf_dir, "select id from f_jobs where status = 'waiting' and run_at <= AS_OF")).distinct()


def _scheduled(spark, sf_dir):
    """Two workers see each schedule; a boundary is claimed once, with one catch-up fire."""
    seconds = "timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', {})".format
    rows = fixtures.stream(spark, sf_dir, "f_scheduled_fires").selectExpr(
        "name", "60L * every_minutes as d", f"{seconds('last_fired_at')} as p", f"{seconds(fixtures.AS_OF.replace('timestamp', 'timestamp_ntz'))} as n", "explode(array('w1', 'w2')) as worker"
    )
    rows = rows.selectExpr("name", "d", "cast(floor(n / d) as bigint) as newest", "cast(floor(p / d) as bigint) + 1 as oldest").where("newest >= oldest")
    return _drained(rows.selectExpr("name", "newest * d as fire_s", "newest - oldest as missed").dropDuplicates(["name", "fire_s"]), "str_scheduler")


ALL["str_scheduler"] = _scheduled, surface.ALL["str_scheduler"][1]


@_query("str_hot_cache", "select queue, status, count(*) as n from f_jobs group by queue, status")
def _cached(spark, sf_dir):
    cache = sinks.HotCache()
    # at most queues times statuses
    load = lambda: fixtures.run(spark, sf_dir, "select queue, status, count(*) as n from f_jobs group by queue, status").collect()
    cache.get("depth", load)
    return spark.createDataFrame(cache.get("depth", load), "queue string, status string, n long")


# -- writes that are read back


def _written(*texts_: str, merge=None):
    """The rows of each text appended as a batch, then read and merged."""

    def run(spark, sf_dir):
        path = sinks.new_table(spark, "written")
        for n, text in enumerate(texts_):
            rows = fixtures.run(spark, sf_dir, text)
            sinks.append_once(rows, path, n)
        back = sinks.batches(spark, path, rows.schema)
        return back.drop("batch") if merge is None else merge(back)

    return run


for _name, _text in {**{n: surface.TEXTS[n] for n in ("snk_enqueue", "snk_enqueue_tx")}, "snk_enqueue_batch": extended.SINKS["snk_enqueue_batch"]}.items():
    _query(_name, _text)(_written(_text))
_query("snk_result", extended.SINKS["snk_result"])(
    _written("select id, args as result from f_jobs", "select id, '{}' as result from f_jobs where status = 'running' and locked_by = 'w4'", merge=lambda rows: sinks.newest(rows, ["id"]))
)
_query("snk_checkpoint", extended.SINKS["snk_checkpoint"][1])(
    _written(
        "select job_id, call_index, call_type, result from f_checkpoints",
        f"select job_id, call_index, call_type, result from ({extended._INCOMING}) n",
        merge=lambda rows: sinks.newest(rows, ["job_id", "call_index", "call_type"]),
    )
)
_query("snk_stats_upsert", extended.SINKS["snk_stats_upsert"])(
    _written(
        "select queue, bucket_ts, completed, failed from f_job_stats",
        "select queue, bucket_ts, completed, failed from f_job_stats where completed > 0",
        merge=lambda rows: sinks.added(rows, ["queue", "bucket_ts"]),
    )
)
_query("snk_stats_snapshot", extended.SINKS["snk_stats_snapshot"])(
    _written("select queue, cast(0 as bigint) as pending, cast(0 as bigint) as running from f_jobs group by queue", extended.SINKS["snk_stats_snapshot"], merge=lambda rows: sinks.newest(rows, ["queue"]))
)

# -- the user surface


@_query("udf_backoff", "select id, cast(case when last_error = 'boom 3' then 5 * attempt else least(60, power(2, attempt)) end as double) as delay_s from f_jobs")
def _delays(spark, sf_dir):
    usual = policies.exponential()
    own = lambda attempt, error: F.when(error == "boom 3", 5 * attempt).otherwise(usual(attempt, error))
    return fixtures.run(spark, sf_dir, "select id, attempt, last_error from f_jobs").select("id", policies.retry_delay(F.col("attempt"), F.col("last_error"), own).alias("delay_s"))


@_query("udf_is_failure", "select id, id % 13 = 0 or (last_error <> '' and last_error <> 'boom 3') as failure from f_jobs")
def _failures(spark, sf_dir):
    rows = fixtures.run(spark, sf_dir, "select id, last_error, id % 13 = 0 as panicked from f_jobs")
    return rows.select("id", policies.is_failure(F.col("last_error"), F.col("panicked"), lambda error: error != "boom 3").alias("failure"))


@_query("udf_partition_key", surface.TEXTS["udf_partition_key"])
def _keys(spark, sf_dir):
    rows = fixtures.run(spark, sf_dir, "select id, tenant, type, queue from f_jobs")
    limit = policies.partition_key("rate", [F.col("queue"), F.col("tenant")], F.col("type").endswith("building"))
    return rows.select("id", policies.partition_key("cap", [F.col("tenant")]).alias("cap_key"), limit.alias("rate_key"))


def _traced(name: str) -> policies.Around:
    add = lambda rows, mark: rows.withColumn("trace", F.concat("trace", F.lit(mark)))
    return lambda rows, then: add(then(add(rows, f"{name}(")), ")")


@_query("udf_enqueue_mw", "select id, 'outer(inner(saved))' as trace from f_jobs where status = 'pending' and queue <> 'ASIA'")
def _enqueued(spark, sf_dir):
    """A trace shows the order, a third middleware vetoes the jobs of one queue."""
    rows = fixtures.run(spark, sf_dir, "select id, queue, '' as trace from f_jobs where status = 'pending'")
    veto = lambda rows, then: then(rows.where(F.col("queue") != "ASIA"))
    save = lambda rows: rows.withColumn("trace", F.concat("trace", F.lit("saved")))
    return policies.chain(rows, [_traced("outer"), veto, _traced("inner")], save).select("id", "trace")


@_query("udf_exec_mw", "select id, case when id % 7 = 0 then 'handled' else 'done' end as ended, 'outer(inner())' as trace from f_jobs where status = 'running'")
def _executed(spark, sf_dir):
    """A handler that fails on some jobs, inside a middleware that mends its errors."""

    def handler(args):
        if args["order"] % 7 == 0:
            raise ValueError("seven")
        return "done"

    def mend(rows, then):
        return then(rows).withColumn("ended", F.when(F.col("o.error") != "", "handled").otherwise(F.from_json("o.result", "array<string>")[0]))

    rows = fixtures.run(spark, sf_dir, "select id, args, '' as trace from f_jobs where status = 'running'")
    run = handlers.outcome(lambda args: [handler(args)])
    return policies.chain(rows, [_traced("outer"), mend, _traced("inner")], lambda rows: rows.withColumn("o", run("args"))).select("id", "ended", "trace")


@_query(
    "udf_hooks",
    "select case type when 'job.started' then 'start' when 'job.completed' then 'complete' when 'job.failed' then 'fail' else 'retry' end as hook, queue, count(*) as n from f_events where type <> 'job.paused' group by 1, 2",
)
def _hooked(spark, sf_dir):
    """Each hook's listener writes its counts by queue, a batch of its own number for each micro-batch."""
    path, hooks, shape = sinks.new_table(spark, "hooks"), policies.Hooks(), "hook string, queue string, n long"
    for k, hook in enumerate(policies.HOOKS):
        count = lambda rows, hook: rows.groupBy("queue").agg(F.count("*").alias("n")).select(F.lit(hook).alias("hook"), "queue", "n")
        hooks.on(hook, lambda rows, batch, k=k, hook=hook: sinks.append_once(count(rows, hook), path, len(policies.HOOKS) * batch + k))
    sinks.write_stream(fixtures.stream(spark, sf_dir, "f_events").select("queue", "type"), path, path + "-state", write=hooks.write).awaitTermination()
    return sinks.added(sinks.batches(spark, path, shape), ["hook", "queue"])
