"""Display, schedule, sink and transition queries; a pair holds the Spark text and the oracle's where they differ."""

from __future__ import annotations

_SPLIT = "concat('a  b ', chr(10), ' c', case when id % 2 = 0 then '' else '_%' end)"
_AGE = "(id * 7919) % 200000"  # seconds

_LINES = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
_RESULTS = "select fan_out_id, array_sort(collect_list(struct(fan_out_index, status, result))) as r from f_sub_jobs group by fan_out_id"
_NAMES = "select id, concat(type, repeat('x', cast(id % 300 as int))) as n from f_jobs"
# rewrites of some checkpoints, and calls that no job has made before
_INCOMING = "select job_id, call_index, call_type, result + 1 as result from f_checkpoints where call_index = 0 union all select job_id, call_index + 100 as call_index, call_type, result from f_checkpoints where call_index = 1"
_WRITES = "select job_id, call_index, call_type, result, 0 as version from f_checkpoints union all select job_id, call_index, call_type, result * 10 as result, 1 as version from f_checkpoints where call_index % 2 = 0"
_PAUSED = "select id, status as previous_status from f_jobs where status in ('pending', 'waiting') union all select id, '' as previous_status from f_jobs where status = 'paused'"

FUNCTIONS = {
    "fn_escape_like": (
        rf"select id, replace(replace(replace({_SPLIT}, '\\', '\\\\'), '%', '\\%'), '_', '\\_') as escaped from f_jobs",
        rf"select id, replace(replace(replace({_SPLIT}, '\', '\\'), '%', '\%'), '_', '\_') as escaped from f_jobs",
    ),
    "fn_one_line": (
        f"select id, coalesce(nullif(trim(regexp_replace(case when id % 5 = 0 then ' ' else {_SPLIT} end, '[ \\\\t\\\\n\\\\r]+', ' ')), ''), '-') as line from f_jobs",
        f"select id, coalesce(nullif(trim(regexp_replace(case when id % 5 = 0 then ' ' else {_SPLIT} end, '[ \\t\\n\\r]+', ' ', 'g')), ''), '-') as line from f_jobs",
    ),
    "fn_next_every": (
        "select event_id, timestamp_ntz '1970-01-01 00:00:00' + cast((floor(timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', ts) / 900) + 1) * 900 as int) * interval '1' second as next_ts from f_events",
        "select event_id, timestamp '1970-01-01 00:00:00' + cast((floor(epoch(ts) / 900) + 1) * 900 as bigint) * interval '1' second as next_ts from f_events",
    ),
    "fn_next_daily": "select event_id, cast(date_trunc('day', ts) as timestamp) + interval '9' hour + case when ts >= cast(date_trunc('day', ts) as timestamp) + interval '9' hour then 1 else 0 end * interval '1' day as next_ts from f_events",
    "fn_next_weekly": """select event_id, case when slot > ts then slot else slot + interval '7' day end as next_ts from
        (select event_id, ts, cast(date_trunc('week', ts) as timestamp) + interval '2' day + interval '9' hour as slot from f_events) x""",
    "fn_trunc_window": "select event_id, cast(date_trunc('hour', ts) as timestamp) as window_start from f_events",
    "fn_round_duration": f"""select id, case when s < 1 then '0s' when s < 60 then concat(cast(s as string), 's') when s < 3600 then concat(cast(cast(floor(s / 60.0) as bigint) as string), 'm0s')
        else concat(cast(cast(floor(s / 3600.0) as bigint) as string), 'h0m0s') end as shown from (select id, {_AGE} as s from f_jobs) x""",
    "fn_rel_time": f"""select id, case when s >= 86400 then concat(cast(cast(floor(s / 86400.0) as bigint) as string), 'd')
        when s >= 3600 then concat(cast(cast(floor(s / 3600.0) as bigint) as string), 'h', cast(cast(floor((s % 3600) / 60.0) as bigint) as string), 'm')
        when s >= 60 then concat(cast(cast(floor(s / 60.0) as bigint) as string), 'm', cast(s % 60 as string), 's')
        else concat(cast(s as string), 's') end as shown from (select id, {_AGE} as s from f_jobs) x""",
    "fn_fmt_duration": f"""select id, case when ms < 1000 then concat(cast(ms as string), 'ms') when ms < 60000 then concat(cast(cast(round(ms / 1000.0, 1) as decimal(10, 1)) as string), 's')
        else concat(cast(cast(floor(ms / 60000.0) as bigint) as string), 'm ', cast(cast(floor((ms % 60000) / 1000.0) as bigint) as string), 's') end as shown
        from (select id, {_AGE} as ms from f_jobs) x""",
    "fn_job_duration": "select id, case when coalesce(completed_at, AS_OF) > started_at then coalesce(completed_at, AS_OF) else started_at end as until_ts, started_at from f_jobs where started_at is not null",
    "fn_json_get": (
        "select id, get_json_object(metadata, '$.segment') as segment from f_jobs",
        "select id, json_extract_string(metadata, '$.segment') as segment from f_jobs",
    ),
    "fn_json_pair": (
        "select id, concat(to_json(tenant), ':', to_json(queue)) as pair from (select id, concat('\"', tenant, '\"') as a, tenant, queue from f_jobs) x".replace("to_json(tenant)", "a").replace("to_json(queue)", "concat('\"', queue, '\"')"),
        "select id, concat(to_json(tenant), ':', to_json(queue)) as pair from f_jobs",
    ),
    "fn_json_generated": (
        "select id, case when length(v) <= 255 then v end as meta_region from (select id, get_json_object(metadata, '$.region') as v from f_jobs) x",
        "select id, case when length(v) <= 255 then v end as meta_region from (select id, json_extract_string(metadata, '$.region') as v from f_jobs) x",
    ),
    "fn_uuid_parse": (
        "select id, case when u rlike '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$' then u end as parsed from (select id, lower(concat('ABCDEF01-0000-7000-8000-', lpad(cast(id as string), case when id % 9 = 0 then 11 else 12 end, '0'))) as u from f_jobs) x",
        "select id, case when regexp_matches(u, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') then u end as parsed from (select id, lower(concat('ABCDEF01-0000-7000-8000-', lpad(cast(id as varchar), case when id % 9 = 0 then 11 else 12 end, '0'))) as u from f_jobs) x",
    ),
    "fn_array_count": "select fan_out_id, count(case when status = 'completed' then 1 end) as succeeded, count(case when status <> 'completed' then 1 end) as not_succeeded, count(*) = count(case when status = 'completed' then 1 end) as all_succeeded from f_sub_jobs group by fan_out_id",
    "fn_array_values": (
        f"select fan_out_id, array_join(transform(filter(r, x -> x.status = 'completed'), x -> cast(cast(x.result as bigint) as string)), ',') as vals from ({_RESULTS})",
        "select fan_out_id, coalesce(string_agg(cast(cast(result as bigint) as varchar), ',' order by fan_out_index) filter (where status = 'completed'), '') as vals from f_sub_jobs group by fan_out_id",
    ),
    "fn_array_partition": (
        f"""select fan_out_id, array_join(transform(filter(r, x -> x.status = 'completed'), x -> cast(x.fan_out_index as string)), ',') as succeeded,
        array_join(transform(filter(r, x -> x.status <> 'completed'), x -> cast(x.fan_out_index as string)), ',') as others from ({_RESULTS})""",
        """select fan_out_id, coalesce(string_agg(cast(fan_out_index as varchar), ',' order by fan_out_index) filter (where status = 'completed'), '') as succeeded,
        coalesce(string_agg(cast(fan_out_index as varchar), ',' order by fan_out_index) filter (where status <> 'completed'), '') as others from f_sub_jobs group by fan_out_id""",
    ),
    "fn_array_all": (
        f"select fan_out_id, forall(r, x -> x.status = 'completed') as all_succeeded from ({_RESULTS})",
        "select fan_out_id, bool_and(status = 'completed') as all_succeeded from f_sub_jobs group by fan_out_id",
    ),
    "fn_collect_results": (
        """select p.id as fan_out_id, p.i as fan_out_index, s.result, case when s.fan_out_id is null then 'incomplete' when s.status = 'failed' then 'failed' else '' end as error
        from (select id, explode(sequence(0, total_count - 1)) as i from f_fan_outs where total_count > 0) p
        left join (select fan_out_id, fan_out_index, result, status from f_sub_jobs where status in ('completed', 'failed')) s on s.fan_out_id = p.id and s.fan_out_index = p.i""",
        """select p.id as fan_out_id, cast(p.i as int) as fan_out_index, case when s.status in ('completed', 'failed') then s.result end as result,
        case s.status when 'completed' then '' when 'failed' then 'failed' else 'incomplete' end as error
        from (select id, unnest(range(total_count)) as i from f_fan_outs) p left join f_sub_jobs s on s.fan_out_id = p.id and s.fan_out_index = p.i""",
    ),
    "fn_bound_limit_name": (
        f"select id, case when length(n) > 255 then concat('h:', sha256(n)) else n end as limit_name from ({_NAMES}) x",
        f"select id, if(strlen(n) <= 255, n, 'h:' || sha256(n)) as limit_name from ({_NAMES}) x",
    ),
    "fn_uuid_new": (
        "select event_id, concat(substring(h, 1, 8), '-', substring(h, 9, 4), '-7', substring(e, 1, 3), '-', substring('89ab', 1 + cast(conv(substring(e, 4, 1), 16, 10) as int) % 4, 1), substring(e, 5, 3), '-', substring(e, 8, 12)) as made"
        " from (select event_id, lower(lpad(hex(floor(timestampdiff(MICROSECOND, timestamp '1970-01-01 00:00:00', ts) / 1000)), 12, '0')) as h, md5(cast(event_id as string)) as e from f_events) x",
        """select event_id, regexp_replace(printf('%012x', epoch_us(ts) // 1000), '(.{8})(.{4})', '\\1-\\2') || '-7' || e[1:3] || '-' || printf('%x', 8 + cast('0x' || e[4:4] as int) % 4) || e[5:7] || '-' || e[8:19] as made
        from (select event_id, ts, md5(cast(event_id as varchar)) as e from f_events) x""",
    ),
}

AGGREGATES = {
    "agg_backlog_age": (
        "select queue, timestampdiff(SECOND, oldest, AS_OF) as age_s from (select queue, min(coalesce(run_at, created_at)) as oldest from f_jobs where status = 'pending' group by queue) x where oldest <= AS_OF",
        "select queue, cast(epoch(AS_OF) - epoch(oldest) as bigint) as age_s from (select queue, min(coalesce(run_at, created_at)) as oldest from f_jobs where status = 'pending' group by queue) x where oldest <= AS_OF",
    ),
    "agg_ratewindow_cardinality": "select count(*) as windows from (select distinct queue, date_trunc('minute', ts) as w from f_events) x",
    "agg_schedule_report": (
        "select name, last_fired_at + every_minutes * interval '1' minute as next_run, cast(floor(timestampdiff(SECOND, last_fired_at, AS_OF) / (60.0 * every_minutes)) as bigint) as missed, last_fired_at + every_minutes * interval '1' minute + interval '1' minute < AS_OF as overdue from f_scheduled_fires",
        "select name, last_fired_at + every_minutes * interval '1' minute as next_run, cast(floor((epoch(AS_OF) - epoch(last_fired_at)) / (60.0 * every_minutes)) as bigint) as missed, last_fired_at + every_minutes * interval '1' minute + interval '1' minute < AS_OF as overdue from f_scheduled_fires",
    ),
    "agg_stats_history": (
        """select g.queue, g.bucket, cast(coalesce(s.completed, 0) as bigint) as completed, cast(coalesce(s.failed, 0) as bigint) as failed
        from (select queue, cast(at as timestamp) as bucket from (select queue, explode(sequence((select date_trunc('hour', min(bucket_ts)) from f_job_stats), (select max(bucket_ts) from f_job_stats), interval '1' hour)) as at from (select distinct queue from f_job_stats) q) a) g
        left join (select queue, cast(date_trunc('hour', bucket_ts) as timestamp) as bucket, sum(completed) as completed, sum(failed) as failed from f_job_stats group by queue, cast(date_trunc('hour', bucket_ts) as timestamp)) s
        on s.queue = g.queue and s.bucket = g.bucket""",
        """with hours as (select unnest(generate_series(cast(date_trunc('hour', min(bucket_ts)) as timestamp), max(bucket_ts), interval '1' hour)) as bucket from f_job_stats)
        select q.queue, h.bucket, cast(coalesce(sum(s.completed), 0) as bigint) as completed, cast(coalesce(sum(s.failed), 0) as bigint) as failed from (select distinct queue from f_job_stats) q cross join hours h
        left join f_job_stats s on s.queue = q.queue and s.bucket_ts >= h.bucket and s.bucket_ts < h.bucket + interval '1' hour group by q.queue, h.bucket""",
    ),
    "src_job_detail": (
        """select j.id, j.status, coalesce(c.n, 0) as n_checkpoints, coalesce(c.steps, '') as steps from f_jobs j left join
        (select job_id, count(*) as n, array_join(transform(array_sort(collect_list(struct(call_index, call_type))), x -> concat(cast(x.call_index as string), ':', x.call_type)), ',') as steps from f_checkpoints group by job_id) c on c.job_id = j.id""",
        """select j.id, j.status, count(c.job_id) as n_checkpoints, coalesce(string_agg(c.call_index || ':' || c.call_type, ',' order by c.call_index), '') as steps
        from f_jobs j left join f_checkpoints c on c.job_id = j.id group by j.id, j.status""",
    ),
    "join_group_children": (
        """select f.parent_job_id, coalesce(s.children, '') as children, coalesce(s.n, 0) as n_children from f_fan_outs f left join
        (select fan_out_id, count(*) as n, array_join(transform(array_sort(collect_list(struct(fan_out_index, status))), x -> concat(cast(x.fan_out_index as string), ':', x.status)), ',') as children from f_sub_jobs group by fan_out_id) s on s.fan_out_id = f.id""",
        """select f.parent_job_id, coalesce(string_agg(s.fan_out_index || ':' || s.status, ',' order by s.fan_out_index), '') as children, count(s.fan_out_id) as n_children
        from f_fan_outs f left join f_sub_jobs s on s.fan_out_id = f.id group by f.id, f.parent_job_id""",
    ),
    "win_fanout_position": (
        f"select l_orderkey as fan_out_id, l_linenumber, cast(row_number() over (partition by l_orderkey order by {_LINES}) - 1 as int) as fan_out_index from lineitem",
        f"select l_orderkey as fan_out_id, l_linenumber, cast(count(*) over (partition by l_orderkey order by {_LINES} rows between unbounded preceding and 1 preceding) as int) as fan_out_index from lineitem",
    ),
    "win_latest_checkpoint": (
        f"select job_id, call_index, call_type, max_by(result, version) as result from ({_WRITES}) w group by job_id, call_index, call_type",
        f"select job_id, call_index, call_type, result from (select *, row_number() over (partition by job_id, call_index, call_type order by version desc) as k from ({_WRITES}) w) x where k = 1",
    ),
    # boundaries after the last fire; those a minute old or older are missed
    "win_missed_fires": (
        """select name, greatest(cast(floor((n - 60) / cast(d as double)) as bigint) - cast(floor(p / cast(d as double)) as bigint), 0) as missed from (select name, cast(60 * every_minutes as bigint) as d,
        timestampdiff(SECOND, timestamp '1970-01-01 00:00:00', last_fired_at) as p, timestampdiff(SECOND, timestamp '1970-01-01 00:00:00', AS_OF) as n from f_scheduled_fires) x""",
        """select name, count(t) as missed from (select name, last_fired_at, unnest(generate_series(0, cast(epoch(AS_OF) as bigint), 60 * every_minutes)) as t from f_scheduled_fires
        union all select name, null, null from f_scheduled_fires) x where t is null or (t > epoch(last_fired_at) and t <= epoch(AS_OF) - 60) group by name""",
    ),
    # a bound for a schedule of one fire in 5 s: floor(12 / 5) + 2 in any 12 s
    "inv_schedule": (
        "select count(*) as violations from (select queue, floor(timestampdiff(SECOND, timestamp '1970-01-01 00:00:00', ts) / 12.0) as w, count(*) as n from f_events group by 1, 2) x where n > 4",
        "select count(*) as violations from (select queue, time_bucket(interval '12' second, ts, timestamp '1970-01-01 00:00:00') as w, count(*) as n from f_events group by 1, 2) x where n > 4",
    ),
    "inv_timer": (
        "select expected, fired, expected = fired as ok from (select count(*) as expected, count(case when status <> 'waiting' then 1 end) as fired from f_jobs where run_at <= AS_OF) x",
        "select count(*) as expected, count(*) filter (where status <> 'waiting') as fired, bool_and(status <> 'waiting') as ok from f_jobs where run_at <= AS_OF",
    ),
    "str_prune": (
        "select queue, bucket_ts from f_job_stats where bucket_ts >= (select max(bucket_ts) from f_job_stats) - interval '31' day",
        "select queue, bucket_ts from (select *, max(bucket_ts) over () as last_ts from f_job_stats) x where last_ts - bucket_ts <= interval '31' day",
    ),
    "flt_retention": """select j.id from f_jobs j where j.status in ('completed', 'failed', 'cancelled') and j.completed_at < AS_OF - interval '30' day
        and not exists (select 1 from f_jobs c where c.parent_job_id = j.id and c.status not in ('completed', 'failed', 'cancelled'))
        and not exists (select 1 from f_fan_outs f where f.parent_job_id = j.id and f.status = 'pending')""",
}

SINKS = {
    "snk_enqueue_batch": """select id, type, queue, unique_key from (select *, row_number() over (partition by case when unique_key = '' then cast(id as string) else unique_key end order by id) as k from f_jobs where status = 'pending') x where k = 1""",
    "snk_checkpoint": (
        f"""select coalesce(n.job_id, o.job_id) as job_id, coalesce(n.call_index, o.call_index) as call_index, coalesce(n.call_type, o.call_type) as call_type, case when n.job_id is null then o.result else n.result end as result
        from f_checkpoints o full outer join ({_INCOMING}) n on n.job_id = o.job_id and n.call_index = o.call_index and n.call_type = o.call_type""",
        f"""select job_id, call_index, call_type, result from ({_INCOMING}) n union all
        select job_id, call_index, call_type, result from f_checkpoints o where (job_id, call_index, call_type) not in (select (job_id, call_index, call_type) from ({_INCOMING}) n)""",
    ),
    "snk_result": "select id, case when status = 'running' and locked_by = 'w4' then '{}' else args end as result from f_jobs",
    "snk_stats_upsert": """select queue, bucket_ts, cast(sum(completed) as bigint) as completed, cast(sum(failed) as bigint) as failed from
        (select queue, bucket_ts, completed, failed from f_job_stats union all select queue, bucket_ts, completed, failed from f_job_stats where completed > 0) x group by queue, bucket_ts""",
    "snk_stats_snapshot": "select queue, count(case when status = 'pending' then 1 end) as pending, count(case when status = 'running' then 1 end) as running from f_jobs group by queue",
    "snk_cli": "select id from f_jobs where dead_lettered_at is not null",
}

TRANSITIONS = {
    "dml_unpause": (
        f"select id, coalesce(nullif(previous_status, ''), 'pending') as status from ({_PAUSED}) x",
        f"select id, case previous_status when '' then 'pending' else previous_status end as status from ({_PAUSED}) x",
    ),
    "dml_wait_until": "select id, 'waiting' as status, AS_OF + interval '5' minute as run_at, '' as locked_by from f_jobs where status = 'running' and locked_by = 'w6'",
    "dml_cancel_sub": "select fan_out_id, fan_out_index, case when status in ('pending', 'running') then 'cancelled' else status end as status from f_sub_jobs where fan_out_id % 3 = 0",
    "dml_fanout_status": """select f.id, case when f.status = 'pending' and s.done >= f.total_count then 'completed' else f.status end as status from f_fan_outs f
        join (select fan_out_id, count(case when status in ('completed', 'failed', 'cancelled') then 1 end) as done from f_sub_jobs group by fan_out_id) s on s.fan_out_id = f.id""",
    # "not in" makes Spark broadcast all parents; jobs of these statuses have an id, a null parent leaves none of them
    "dml_retry_ui": (
        """select id, 'pending' as status, 0 as attempt, '' as last_error from f_jobs j where status in ('failed', 'cancelled')
        and not exists (select 1 from (select distinct parent_job_id from f_sub_jobs) s where s.parent_job_id = j.id) and not exists (select 1 from f_sub_jobs where parent_job_id is null)""",
        "select id, 'pending' as status, 0 as attempt, '' as last_error from f_jobs where status in ('failed', 'cancelled') and id not in (select parent_job_id from f_sub_jobs)",
    ),
    "dml_signal_send": "select id, job_id, name from f_signals union all select cast(-1 as bigint) as id, id as job_id, 'go' as name from f_jobs where status = 'waiting'",
}

ALL = {**FUNCTIONS, **AGGREGATES, **SINKS, **TRANSITIONS}
