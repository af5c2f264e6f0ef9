"""Functions, handlers, recurrences and further sinks over the job dataset, each with an independent oracle text."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from taskloom.functions import redaction, schedules, texts
from taskloom.operators import handlers, trees
from taskloom.sources import fixtures
from taskloom.streaming import state

ALL: dict[str, tuple] = {}  # name -> (Spark callable, oracle SQL)
TEXTS: dict[str, str] = {}  # name -> its SQL for Spark, where it has one


def _sql(name: str, ours: str, theirs: str | None = None) -> None:
    TEXTS[name] = ours
    ALL[name] = (lambda spark, sf_dir, text=ours: fixtures.run(spark, sf_dir, text)), fixtures.expand(ours if theirs is None else theirs)


def _query(name: str, oracle: str):
    def keep(f):
        ALL[name] = f, fixtures.expand(oracle)
        return f

    return keep


def _both(name: str, text: str) -> None:
    """One text where E(x) is a timestamp in whole seconds since the epoch."""
    ours = re.sub(r"E\(([\w ]+)\)", r"timestampdiff(SECOND, timestamp '1970-01-01 00:00:00', \1)", text)
    theirs = re.sub(r"E\(([\w ]+)\)", r"cast(floor(epoch(\1)) as bigint)", text)
    _sql(name, ours, theirs)


# -- deduplication and texts

_sql(
    "dedup_scope_hash",
    "select id, sha2(concat(" + ", ".join(f"unhex(lpad(hex(octet_length({c})), 16, '0')), encode({c}, 'utf-8')" for c in ("queue", "type", "how", "v")) + "), 256) as scope_hash"
    " from (select id, queue, type, case when unique_key = '' then 'args' else 'key' end as how, case when unique_key = '' then args else unique_key end as v from f_jobs) x",
    "select id, sha256(" + " || ".join(f"unhex(printf('%016X', octet_length(encode({c})))) || encode({c})" for c in ("queue", "type", "how", "v")) + ") as scope_hash"
    " from (select id, queue, type, case when unique_key = '' then 'args' else 'key' end as how, case when unique_key = '' then args else unique_key end as v from f_jobs) x",
)

_TOKENS = """select id, case id % 7 when 0 then substring(h, 1, 40) when 1 then substring(h, 1, 24) when 2 then concat(substring(h, 1, 12), '/', substring(h, 1, 12), '/x')
    when 3 then concat(upper(substring(h, 1, 12)), 'xyz', substring(h, 13, 10)) when 4 then concat(substring(h, 1, 8), '-0000-7000-8000-', substring(h, 1, 12))
    when 5 then 'justlowercaseletterswithout' else substring(h, 1, 19) end as token from (select id, sha256(k) as h from (select id, cast(id as string) as k from f_jobs) y) x"""


@_query(
    "fn_opaque_token",
    f"""select id, length(token) >= 20 and not regexp_matches(token, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') and len(string_split(token, '/')) < 3
        and not (regexp_matches(token, '^[0-9A-Fa-f]+$') and length(token) = 40)
        and ((regexp_matches(token, '^[0-9A-Fa-f]+$') and regexp_matches(token, '[0-9]')) or regexp_matches(token, '[+/=]')
          or (regexp_matches(token, '[0-9]') and regexp_matches(token, '[A-Z]') and regexp_matches(token, '[a-z]'))) as opaque from ({_TOKENS}) t""",
)
def _opaque(spark, sf_dir):
    return fixtures.run(spark, sf_dir, _TOKENS).select("id", redaction.is_opaque(F.col("token")).alias("opaque"))


@_query(
    "prj_redacted_job",
    "select id, type, queue, args, case when last_error = '' then '' else concat('password=[REDACTED] ', last_error) end as last_error from f_jobs",
)
def _redacted(spark, sf_dir):
    rows = fixtures.run(spark, sf_dir, "select id, type, queue, args, case when last_error = '' then '' else concat('password=', tenant, ' ', last_error) end as last_error from f_jobs")
    return rows.select("id", "type", "queue", redaction.redact(F.col("args")).alias("args"), redaction.sanitize(F.col("last_error")).alias("last_error"))


def _codec() -> texts.Codec:
    return texts.aes(F.lit("0123456789abcdef").cast("binary"))


@_query("prj_decode", "select id, args from f_jobs")
def _decode(spark, sf_dir):
    stored = fixtures.run(spark, sf_dir, "select id, args from f_jobs").select("id", _codec().encode(F.col("args").cast("binary")).alias("stored"))
    return stored.select("id", texts.decode_payload(_codec(), F.col("stored")).alias("args"))


@_query("udf_codec", "select id, args, args as plain, true as sealed from f_jobs")
def _seal(spark, sf_dir):
    rows = fixtures.run(spark, sf_dir, "select id, args from f_jobs")
    sealed = rows.withColumn("stored", _codec().encode(F.col("args").cast("binary")))
    opened = texts.decode_payload(_codec(), F.col("stored"))
    return sealed.select("id", opened.alias("args"), texts.decode_payload(texts.IDENTITY, F.col("args").cast("binary")).alias("plain"), (F.col("stored") != F.col("args").cast("binary")).alias("sealed"))


@_query(
    "fn_error_text_tag",
    "select id, case id % 4 when 0 then concat('boom ', tenant) when 1 then concat('dead: boom ', tenant) when 2 then 'enc:not base64' else '' end as error from f_jobs",
)
def _error_text(spark, sf_dir):
    rows = fixtures.run(spark, sf_dir, "select id, concat('boom ', tenant) as e from f_jobs")
    stored = texts.encode_error(_codec(), F.col("e"))
    kind = F.col("id") % 4
    stored = F.when(kind == 0, stored).when(kind == 1, F.concat(F.lit("dead: "), stored)).when(kind == 2, "enc:not base64").otherwise("")
    return rows.select("id", texts.decode_error(_codec(), stored).alias("error"))


def _fuzzy_sql(q: str, columns: str, rows: str) -> str:
    a, b, c = q
    term = lambda at, last: f"(case when {at} = {last} + 1 then 12 else 4 end + case when {at} = 0 or substr(label, {at}, 1) in ('-', '_', '/') then 8 else 0 end - ({at} - {last} - 1))"
    return f"""select {columns}, score from (select *, case when strpos(label, '{q}') > 0 then cast(700 + 30 - (strpos(label, '{q}') - 1) as double) when p1 < 0 or p2 < 0 or p3 < 0 then cast(0 as double)
        else greatest(cast(1 as double), cast({term("p1", "-1")} + {term("p2", "p1")} + {term("p3", "p2")} as double) - length(label) * cast(0.1 as double)) end as score
        from (select *, case when p2 >= 0 and strpos(substr(label, p2 + 2), '{c}') > 0 then p2 + strpos(substr(label, p2 + 2), '{c}') else -1 end as p3
        from (select *, case when p1 >= 0 and strpos(substr(label, p1 + 2), '{b}') > 0 then p1 + strpos(substr(label, p1 + 2), '{b}') else -1 end as p2
        from (select *, strpos(label, '{a}') - 1 as p1 from ({rows}) r0) r1) r2) r3) r4"""


_LABELS = "select id, concat(type, '/', tenant) as label from f_jobs"
_DISTINCT = "select distinct concat(type, '/', tenant) as label from f_jobs"


@_query("fn_fuzzy_score", _fuzzy_sql("bt1", "id", _LABELS))
def _fuzzy(spark, sf_dir):
    return fixtures.run(spark, sf_dir, _LABELS).select("id", texts.fuzzy_score("bt1", F.col("label")).alias("score"))


@_query("srt_fuzzy", _fuzzy_sql("jm1", "label", _DISTINCT) + " where score > 0 order by score desc, label")
def _fuzzy_sorted(spark, sf_dir):
    return fixtures.run(spark, sf_dir, _DISTINCT).withColumn("score", texts.fuzzy_score("JM1 ", F.col("label"))).where("score > 0").orderBy(F.desc("score"), "label")


# -- JSON and maps


@_query("fn_json_equal", "select id, id % 3 <> 0 as equal from f_jobs")
def _json_equal(spark, sf_dir):
    rows = fixtures.run(spark, sf_dir, "select id, concat('{\"a\": ', cast(id as string), ', \"b\": [1, 2.0]}') as a, concat('{\"b\":[1.0,2],\"a\":', cast(id + case when id % 3 = 0 then 1 else 0 end as string), '}') as b from f_jobs")
    return rows.select("id", texts.json_equal("a", "b").alias("equal"))


_STATE = "concat('{\"deadline\":', cast(id * 1000 as string), ',\"resolved\":', case when id % 2 = 0 then 'true' else 'false' end, '}')"
_sql(
    "fn_json_state",
    f"select id, s.deadline as deadline, s.resolved as resolved, coalesce(s.timed_out, false) as timed_out from (select id, from_json({_STATE}, 'deadline bigint, resolved boolean, timed_out boolean') as s from f_jobs) x",
    f"select id, cast(json_extract(s, '$.deadline') as bigint) as deadline, cast(json_extract(s, '$.resolved') as boolean) as resolved, coalesce(cast(json_extract(s, '$.timed_out') as boolean), false) as timed_out from (select id, {_STATE} as s from f_jobs) x",
)
_MAP = "concat('{\"b\":\"', queue, '\",\"a\":\"', tenant, '\"}')"
_sql(
    "fn_map_keys_sorted",
    f"select id, array_join(transform(array_sort(map_entries(from_json({_MAP}, 'map<string,string>'))), e -> concat(e.key, '=', e.value)), ',') as entries from f_jobs",
    "select id, concat('a=', tenant, ',b=', queue) as entries from f_jobs",
)

# -- times and schedules


@_query("fn_parse_ts", "select id, case id % 5 when 0 then s * 1000000 when 1 then (s - 7200) * 1000000 when 2 then s * 1000000 + 123456 end as micros from (select id, id * 7919 as s from f_jobs) x")
def _stamps(spark, sf_dir):
    rows = fixtures.run(spark, sf_dir, "select id, id * 7919 as s from f_jobs")
    at = F.timestamp_seconds("s")
    text = F.when(F.col("id") % 5 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("id") % 5 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss'+02:00'"))
    text = text.when(F.col("id") % 5 == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.123456789Z'")).when(F.col("id") % 5 == 3, "").otherwise(F.date_format(at, "yyyy-MM-dd"))
    return rows.select("id", texts.parse_stamp(text).alias("micros"))


_SPAN = "select id, E(started_at) as a, E(completed_at) as b from f_jobs where started_at is not null and completed_at is not null"
_STEPS = f"select id, a, b, case when b - a < 300 then 30 when b - a < 1800 then 300 when b - a < 7200 then 900 else 1800 end as step from ({_SPAN}) x"
_FIRST = f"select id, b, step, cast(ceil(a / cast(step as double)) as bigint) * step as first from ({_STEPS}) y"
_E = lambda text, f: re.sub(r"E\((\w+)\)", f, text)
_OURS, _THEIRS = r"timestampdiff(SECOND, timestamp '1970-01-01 00:00:00', \1)", r"cast(floor(epoch(\1)) as bigint)"
_sql(
    "fn_ticks",
    _E(f"select id, explode(sequence(first, b, cast(step as bigint))) as tick from ({_FIRST}) z where first <= b", _OURS),
    _E(f"select id, unnest(generate_series(first, b, step)) as tick from ({_FIRST}) z where first <= b", _THEIRS),
)
_both(
    "fn_seed_last_run",
    """select name, case when due < 2 then p when due - 1 >= 100000 then n else (newest - 1) * d end as cursor_s
        from (select name, p, n, d, cast(floor(n / cast(d as double)) as bigint) as newest, cast(floor(n / cast(d as double)) as bigint) - cast(floor(p / cast(d as double)) as bigint) as due
        from (select name, E(last_fired_at) as p, E(as_of) as n, cast(60 * every_minutes as bigint) as d from (select *, AS_OF as as_of from f_scheduled_fires) w) x) y""",
)
_sql("fn_jitter", "select id, greatest(cast(0 as double), delay * (1 + cast(0.1 as double) * (2 * u - 1))) as delay from (select id, cast(attempt * 1000 as double) as delay, (id * 7919 % 1000) / cast(1000 as double) as u from f_jobs) x")

_CRON = "*/15 9-17 * * mon-fri"


@_query(
    "fn_next_cron",
    """with fires as (select t from (select unnest(generate_series(cast(min(date_trunc('day', ts)) as timestamp), cast(max(date_trunc('day', ts)) as timestamp) + interval '8' day, interval '15' minute)) as t from f_events) x
        where hour(t) between 9 and 17 and dayofweek(t) between 1 and 5) select e.event_id, f.t as next_ts from f_events e asof join fires f on e.ts < f.t""",
)
def _next_cron(spark, sf_dir):
    return fixtures.view(spark, sf_dir, "f_events").select("event_id", schedules.next_cron(_CRON)("ts").alias("next_ts"))


_PARTS = "select id, cast(1 + id % 59 as string) as m, cast(1 + id % 23 as string) as h, cast(id % 8 as string) as d, cast(1 + id % 28 as string) as dom from f_jobs"


@_query(
    "fn_cron_prose",
    f"""with p as (select *, case when cast(h as int) = 12 and m = '0' then 'noon' else concat(cast((cast(h as int) + 11) % 12 + 1 as string), ':', lpad(m, 2, '0'), case when cast(h as int) >= 12 then ' PM' else ' AM' end) end as clock from ({_PARTS}) x)
        select id, case id % 9 when 0 then concat('every ', m, case when m = '1' then ' minute' else ' minutes' end) when 1 then concat('every ', h, case when h = '1' then ' hour' else ' hours' end) when 2 then 'every hour'
        when 3 then concat('every day at ', clock) when 4 then concat('every ', list_extract(['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], cast(d as int) + 1), ' at ', clock)
        when 5 then concat('every month on day ', dom, ' at ', clock) when 6 then '5 4 * 2 *' when 7 then 'not cron' else concat('every ', h, case when h = '1' then ' hour' else ' hours' end, ' at minute ', m) end as words from p""",
)
def _prose(spark, sf_dir):
    text = """case id % 9 when 0 then concat('*/', m, ' * * * *') when 1 then concat('0 */', h, ' * * *') when 2 then ' 0 * * * * ' when 3 then concat(m, ' ', h, ' * * *') when 4 then concat(m, ' ', h, ' * * ', d)
        when 5 then concat(m, ' ', h, ' ', dom, ' * *') when 6 then '5 4 * 2 *' when 7 then 'not cron' else concat(m, ' */', h, ' * * *') end"""
    return fixtures.run(spark, sf_dir, f"select id, {text} as cron from ({_PARTS}) x").select("id", schedules.prose(F.col("cron")).alias("words"))


# -- the surface for user functions


def _order(args):
    n = args["order"]
    if n % 11 == 0:
        raise handlers.NoRetry(f"gone {n}")
    if n % 7 == 0:
        raise ValueError(f"odd {n}")
    return {"double": 2 * n}


_OUTCOME = """select id, case when id % 11 = 0 or id % 7 = 0 then null else concat('{"double":', cast(2 * id as string), '}') end as result,
    case when id % 11 = 0 then concat('gone ', cast(id as string)) when id % 7 = 0 then concat('odd ', cast(id as string)) else '' end as error, case when id % 11 = 0 then 'no_retry' when id % 7 = 0 then 'retry' else '' end as kind from f_jobs"""


@_query("udf_handler", _OUTCOME)
def _handled(spark, sf_dir):
    rows = fixtures.run(spark, sf_dir, "select id, args from f_jobs")
    return rows.select("id", handlers.outcome(_order)("args").alias("o")).select("id", "o.*")


@_query("udf_typed", "select id, case when id % 11 <> 0 and id % 7 <> 0 then 2 * id end as double from f_jobs")
def _typed(spark, sf_dir):
    job = handlers.Typed("job.order", "order long", "double long")
    rows = job.enqueue(fixtures.run(spark, sf_dir, "select id as `order` from f_jobs"))
    done = rows.select(F.get_json_object("args", "$.order").cast("long").alias("id"), handlers.outcome(_order)("args")["result"].alias("r"))
    return done.select("id", job.load(F.col("r"))["double"].alias("double"))


@_query(
    "udf_call",
    """select j.id, case when c.call_type = 'step.n' then c.result when c.call_type is null then cast(j.priority as double) end as value, coalesce(c.call_type = 'step.n', false) as replayed,
        coalesce(c.call_type <> 'step.n', false) as conflict from f_jobs j left join (select job_id, call_type, result from f_checkpoints where call_index = 1) c on c.job_id = j.id""",
)
def _called(spark, sf_dir):
    jobs, points = fixtures.run(spark, sf_dir, "select id, priority from f_jobs"), fixtures.view(spark, sf_dir, "f_checkpoints")
    return handlers.call(jobs, points, 1, "step.n", F.col("priority").cast("double"))


@_query("udtf_fanout", "select id as fan_out_id, cast(unnest(range(total_count)) as int) as fan_out_index, 'job.child' as type from f_fan_outs where total_count > 0")
def _fanned(spark, sf_dir):
    return handlers.fan_out(fixtures.run(spark, sf_dir, "select id, total_count from f_fan_outs"), F.col("total_count"), "job.child")


@_query("udaf_fanin", "select fan_out_id, string_agg(cast(cast(result as bigint) as varchar), ',' order by fan_out_index) as results from f_sub_jobs group by fan_out_id")
def _fanned_in(spark, sf_dir):
    return handlers.fan_in(fixtures.view(spark, sf_dir, "f_sub_jobs")).select("fan_out_id", F.array_join(F.transform("results", lambda r: r.cast("long").cast("string")), ",").alias("results"))


_sql("udf_partition_key", "select id, concat('cap:', tenant) as cap_key, case when type like '%building' then concat('rate:', queue, ':', tenant) else '' end as rate_key from f_jobs")
_sql(
    "udf_phase",
    "select j.id, p.result from f_jobs j left join (select job_id, result from (select job_id, result, row_number() over (partition by job_id order by call_index desc) as k from f_checkpoints where call_type = 'step.n') x where k = 1) p on p.job_id = j.id",
)
_sql(
    "udf_version",
    """select id, case when v between 1 and 3 then v end as version, case when v between 1 and 3 then '' else concat('recorded version ', cast(v as string), ' outside [1, 3]') end as error, recorded is null as saves
        from (select id, recorded, coalesce(recorded, 3) as v from (select id, case when id % 3 = 0 then cast(id % 6 as int) end as recorded from f_jobs) x) y""",
)

# -- sinks, reports, transitions

_sql(
    "snk_enqueue",
    """select n.id, n.queue, n.type, n.unique_key from (select *, row_number() over (partition by case when unique_key = '' then cast(id as string) else unique_key end order by id) as k from f_jobs where status = 'retrying') n
        where n.k = 1 and (n.unique_key = '' or not exists (select 1 from f_jobs o where o.unique_key = n.unique_key and o.status in ('pending', 'running')))""",
)
_sql(
    "agg_bounce_counts",
    """select reason, cast(sum(k) as bigint) as n from (select case when q.paused then 'paused' else 'queue_cap' end as reason, case when q.paused then c.n else greatest(c.n - 50, 0) end as k
        from (select queue, count(*) as n from f_jobs where status = 'pending' group by queue) c join f_queue_states q on q.queue = c.queue) x where k > 0 group by reason""",
    """select reason, count(*) as n from (select case when q.paused then 'paused' when j.rank_in_queue > 50 then 'queue_cap' else 'run' end as reason
        from (select queue, row_number() over (partition by queue order by priority desc, id) as rank_in_queue from f_jobs where status = 'pending') j join f_queue_states q on q.queue = j.queue) x where reason <> 'run' group by reason""",
)
_sql(
    "dml_suspend_fanout",
    """select j.id as parent_job_id, f.id as fan_out_id, 'waiting' as status, cast(f.total_count as int) as total_count, '' as locked_by from f_jobs j join f_fan_outs f on f.parent_job_id = j.id
        where j.status = 'running' and j.locked_by = 'w5'""",
)
_sql(
    "str_rate_refund",
    """select queue, window_start, cast(last_sum - least(0, low) as bigint) as used from (select queue, window_start, sum(delta) as last_sum, min(running) as low from
        (select queue, window_start, delta, sum(delta) over (partition by queue, window_start order by ts, event_id rows between unbounded preceding and current row) as running
        from (select queue, event_id, ts, cast(date_trunc('hour', ts) as timestamp) as window_start, case when type = 'job.started' then 1 else -1 end as delta from f_events where type in ('job.started', 'job.paused')) a) b group by queue, window_start) c""",
)
_both(
    "str_scheduler",
    """select name, (newest * d) as fire_s, newest - oldest as missed from (select name, d, cast(floor(n / cast(d as double)) as bigint) as newest, cast(floor(p / cast(d as double)) as bigint) + 1 as oldest
        from (select name, E(last_fired_at) as p, E(as_of) as n, cast(60 * every_minutes as bigint) as d from (select *, AS_OF as as_of from f_scheduled_fires) w) x) y where newest >= oldest""",
)

# -- recurrences

_AT = "timestampdiff(MICROSECOND, timestamp '1970-01-01 00:00:00', ts)"


def _events(spark, sf_dir, key: str):
    return fixtures.run(spark, sf_dir, f"select {key} as key, event_id, type, {_AT} as at from f_events")


def _steps(key: str, start: str, then: str, out: str, only: str = "true") -> str:
    """A recurrence for the oracle: numbered rows of each key, one more a round."""
    return f"""with recursive e as materialized (select {key} as key, event_id, type, epoch_us(ts) as us, row_number() over (partition by {key} order by ts, event_id) as k from f_events),
        walk as (select key, event_id, type, us, k, {start} from e where k = 1 union all select e.key, e.event_id, e.type, e.us, e.k, {then} from walk w join e on e.key = w.key and e.k = w.k + 1)
        select key, event_id, {out} from walk where {only}"""


_REFILL = "least(cast(3 as double), w.tokens + (e.us - w.us) / cast(1000000 as double) * cast(0.002 as double))"


BUCKET = (0.002, 3)
BUCKET_ORACLE = _steps("queue", "cast(2 as double) as tokens, true as admitted", f"{_REFILL} - case when {_REFILL} >= 1 then 1 else 0 end, {_REFILL} >= 1", "admitted")


@_query("win_token_bucket", BUCKET_ORACLE)
def _bucket(spark, sf_dir):
    return state.in_batch(_events(spark, sf_dir, "queue"), state.bucket_step(*BUCKET), "key string, event_id long, admitted boolean")


@_query(
    "str_dedup_ttl",
    _steps(
        "job_id",
        "case when type = 'job.failed' then 0 else event_id end as holder, case when type = 'job.failed' then 0 else us + 86400000000 end as expires, type = 'job.failed' as dead",
        """case when e.type <> 'job.failed' and (w.dead or w.expires <= e.us) then e.event_id else w.holder end, case when e.type <> 'job.failed' and (w.dead or w.expires <= e.us) then e.us + 86400000000 else w.expires end,
        case when e.type = 'job.failed' then true when w.dead or w.expires <= e.us then false else w.dead end""",
        "holder", "type <> 'job.failed'",
    ),
)
def _locks(spark, sf_dir):
    return state.in_batch(_events(spark, sf_dir, "job_id"), state.lock_step(86_400_000_000), "key long, event_id long, holder long")


def _move(status: str, event: str) -> str:
    """The graceful subset of moves that the fixture's events can make."""
    return f"""case when {status} = 'pending' and {event} = 'job.started' then 'running' when {status} = 'pending' and {event} = 'job.paused' then 'paused' when {status} = 'running' and {event} = 'job.completed' then 'completed'
        when {status} = 'running' and {event} = 'job.failed' then 'failed' when {status} = 'running' and {event} = 'job.retrying' then 'pending' else {status} end"""


@_query("str_job_fsm", _steps("job_id", f"'pending' as before, {_move(chr(39) + 'pending' + chr(39), 'type')} as after", f"w.after, {_move('w.after', 'e.type')}", "before, after"))
def _statuses(spark, sf_dir):
    return state.in_batch(_events(spark, sf_dir, "job_id"), state.status_step, "key long, event_id long, before string, after string")


# -- the display tree

_TREE = "with recursive tree(id, parent_job_id, status, depth) as (select id, parent_job_id, status, 0 as depth from f_jobs where id = 3 union all select j.id, j.parent_job_id, j.status, t.depth + 1 from f_jobs j join tree t on j.parent_job_id = t.id)"


def _jobs(spark, sf_dir):
    """Jobs and the root that the tree queries take."""
    jobs = fixtures.run(spark, sf_dir, "select id, parent_job_id, status from f_jobs")
    return jobs, fixtures.run(spark, sf_dir, "select id from f_jobs where id = 3")


@_query("join_subtree_bfs", f"{_TREE} select id, depth from tree")
def _subtree(spark, sf_dir):
    return trees.subtree(*_jobs(spark, sf_dir))


@_query("join_workflow_tree", f"{_TREE}, page as (select id, parent_job_id, depth from tree where depth > 0 order by depth, id limit 1000) select id, parent_job_id, depth, (select count(*) > 1001 from tree) as truncated from page")
def _shown(spark, sf_dir):
    return trees.shown(*_jobs(spark, sf_dir))


@_query(
    "join_parent_climb",
    "with recursive up(start_id, id, parent_job_id, hops) as (select id as start_id, id, parent_job_id, 0 as hops from f_jobs where status = 'waiting' union all select u.start_id, j.id, j.parent_job_id, u.hops + 1 from f_jobs j join up u on j.id = u.parent_job_id) select start_id, id as root, hops from up where parent_job_id is null",
)
def _climbed(spark, sf_dir):
    jobs, _ = _jobs(spark, sf_dir)
    return trees.climb(jobs, jobs.where("status = 'waiting'"))


@_query("dml_cancel_tree", f"{_TREE} select id, 'cancelled' as status from tree where status in ('pending', 'waiting', 'running')")
def _cancelled(spark, sf_dir):
    jobs, roots = _jobs(spark, sf_dir)
    live = jobs.where(F.col("status").isin("pending", "waiting", "running"))
    return live.join(trees.subtree(jobs, roots), "id", "left_semi").select("id", F.lit("cancelled").alias("status"))


@_query("dml_delete_tree", f"{_TREE} select id from f_jobs where id not in (select id from tree)")
def _deleted(spark, sf_dir):
    jobs, roots = _jobs(spark, sf_dir)
    return jobs.join(trees.subtree(jobs, roots), "id", "left_anti").select("id")


# -- reports

_sql(
    "snk_prometheus",
    "select concat('jobs_processed_total{queue=\"', queue, '\",status=\"', status, '\"} ', cast(count(*) as string)) as line from f_jobs where status in ('completed', 'failed') group by queue, status",
)
_sql(
    "snk_enqueue_tx",
    "select id, type, queue, 'job' as written from f_jobs where status = 'pending' union all select id, type, queue, 'outbox' as written from f_jobs where status = 'pending'",
)
_sql(
    "str_saturation_cooldown",
    """select queue, window_start, count(case when k > 20 then 1 end) as denied, count(case when k = 21 then 1 end) as checked from (select queue, cast(date_trunc('hour', ts) as timestamp) as window_start,
        row_number() over (partition by queue, date_trunc('hour', ts) order by ts, event_id) as k from f_events) x group by queue, window_start""",
)


@_query("udf_schedule", "select event_id, ts + interval '90' minute as next_ts from f_events")
def _custom(spark, sf_dir):
    after = schedules.custom(lambda at: at + dt.timedelta(minutes=90))
    return fixtures.view(spark, sf_dir, "f_events").select("event_id", after("ts").alias("next_ts"))
