"""Scans, filters, joins, aggregates, windows, sorts, set operations and invariants in SQL.

Every text runs unchanged in meaning on both engines, over the derived job
dataset; Catalyst plans it. Limits stand only where they are the feature (a
claim, a page, a top-k). Orders end in a unique key, so results are total.
A pair is (our text, the oracle's), the oracle's stated by another route.
"""

from __future__ import annotations

J = "id, type, queue, status, priority"

SCANS = {
    "src_jobs_scan": "select id, type, queue, tenant, status, priority, attempt, max_retries, created_at, run_at from f_jobs",
    "src_get_job": f"select {J} from f_jobs where id = 42",
    "src_by_status": f"select {J} from f_jobs where status = 'pending' order by id limit 100",
    "src_by_worker": f"select {J} from f_jobs where status = 'running' and locked_by = 'w5'",
    "src_due_jobs": f"""select {J} from f_jobs j where status = 'pending' and coalesce(run_at, created_at) <= AS_OF
        and not exists (select 1 from f_queue_states q where q.queue = j.queue and q.paused)
        order by priority desc, coalesce(run_at, created_at), id limit 50""",
    "src_checkpoints": "select job_id, call_index, call_type, result from f_checkpoints where job_id = 7 order by call_index",
    "src_fan_outs_by_parent": "select id, parent_job_id, total_count, strategy, status from f_fan_outs where parent_job_id in (1, 2, 3, 33)",
    "src_sub_jobs": "select fan_out_id, fan_out_index, status, result from f_sub_jobs where fan_out_id in (1, 2, 3) order by fan_out_id, fan_out_index",
    "src_sub_job_results": "select fan_out_id, fan_out_index, status, result from f_sub_jobs where fan_out_id = 3 and status in ('completed', 'failed')",
    "src_paused_jobs": f"select {J} from f_jobs where status = 'paused' and queue = 'ASIA' order by created_at, id",
    "src_paused_queues": "select queue from f_queue_states where paused",
    "src_fire_times": "select name, last_fired_at from f_scheduled_fires where last_fired_at is not null",
    "src_peek_signal": "select job_id, name, min(id) as oldest_id, min(created_at) as oldest_at from f_signals where consumed_at is null group by job_id, name",
    "src_stats_history": "select queue, bucket_ts, completed, failed, retried from f_job_stats where queue = 'q1' order by bucket_ts",
    "src_load_status": "select id, status, status in ('completed', 'failed', 'cancelled') as terminal from f_jobs",
    "src_load_result": """select id, case status when 'completed' then 'value' when 'failed' then 'error' when 'cancelled' then 'cancelled' else 'not finished' end as outcome,
        case when status = 'failed' then last_error end as error from f_jobs""",
    "src_raw_insert": """select id, type, queue, coalesce(tenant, '') as tenant, 'pending' as status, coalesce(priority, 0) as priority, 0 as attempt,
        3 as max_retries, args from f_jobs""",
}

FILTERS = {
    "flt_equality": f"select {J} from f_jobs where status = 'failed' and queue = 'EUROPE' and type = 'job.machinery' and tenant = 't3'",
    "flt_time_range": f"select {J} from f_jobs where created_at >= timestamp '1995-01-01 00:00:00' and created_at <= timestamp '1995-06-30 23:59:59'",
    "flt_metadata": """select id, queue from f_jobs where metadata like '%"region":"ASIA"%' and metadata like '%"segment":"BUILDING"%'""",
    "flt_search": """select id, args from f_jobs where args like '%order":12%' escape '!' or args like '%100!%%' escape '!'""",
    "flt_claimable": f"""select {J} from f_jobs j where queue in ('ASIA', 'AFRICA', 'AMERICA') and status = 'pending'
        and coalesce(run_at, created_at) <= AS_OF and (locked_until is null or locked_until < AS_OF)
        and not exists (select 1 from f_queue_states q where q.queue = j.queue and q.paused)""",
    "flt_due": f"select {J} from f_jobs where status = 'pending' and coalesce(run_at, created_at) <= AS_OF",
    "flt_exists_claimable": "select count(*) > 0 as claimable from f_jobs where status = 'pending' and coalesce(run_at, created_at) <= AS_OF",
    "flt_ready_promote": f"select {J} from f_jobs where status = 'pending' and run_at is not null and run_at <= AS_OF order by id limit 100",
    "flt_stale": f"""select {J} from f_jobs where status = 'running' and coalesce(last_heartbeat_at, started_at, locked_until) < AS_OF - interval '45' minute
        order by coalesce(last_heartbeat_at, started_at, locked_until), id limit 100""",
    "flt_orphaned": """select id from f_jobs where status not in ('waiting', 'paused')
        and (locked_by is null or locked_by <> 'w1' or status in ('completed', 'failed', 'cancelled'))
        and (status not in ('completed', 'failed', 'cancelled') or locked_by <> '')""",
    "flt_owned": f"select {J} from f_jobs where locked_by = 'w5' and status = 'running'",
    "flt_consumed_signals": "select id from f_signals where consumed_at is not null and consumed_at < AS_OF - interval '7' day order by consumed_at, id",
    "flt_expired_locks": "select scope_hash, job_id from f_unique_locks where expires_at <= AS_OF",
    "flt_expired_slots": "select slot_name, job_id from f_slots where expires_at < AS_OF and job_id <> -1",
    "flt_dead_letter": "select id, queue, last_error from f_jobs where dead_lettered_at is not null and queue = 'ASIA' and last_error like '%boom 1%'",
    "flt_purge_status": "select id from f_jobs where status in ('pending', 'completed', 'failed', 'cancelled', 'paused')",
    "flt_status_list": f"select {J} from f_jobs where status in ('running', 'waiting', 'paused')",
    "flt_event_queues": "select e.event_id, coalesce(j.queue, e.queue) as queue from f_events e left join f_jobs j on j.id = e.job_id where coalesce(j.queue, e.queue) in ('ASIA', 'q1')",
    "prj_id_only": "select id from f_jobs where status = 'waiting'",
    "prj_display_status": "select id, case when dead_lettered_at is not null then 'dead-lettered' else status end as display_status from f_jobs",
    "prj_dead_letter_reason": """select id, case when attempt >= max_retries then concat('max retries exhausted after ', cast(attempt as string), ' attempts') else 'non-retryable failure' end as reason
        from f_jobs where dead_lettered_at is not null""",
    "prj_fill_defaults": "select id, coalesce(status, 'pending') as status, coalesce(nullif(queue, ''), 'default') as queue, coalesce(run_at, created_at) <= AS_OF as dq_ready from f_jobs",
    "prj_wire_event": """select event_id, queue, case type when 'job.started' then 1 when 'job.completed' then 2 when 'job.failed' then 3 when 'job.retrying' then 4 when 'job.paused' then 5 end as tag
        from f_events where type in ('job.started', 'job.completed', 'job.failed', 'job.retrying', 'job.paused')""",
}

COUNTS = """c as (select fan_out_id, count(*) as n, count(case when status = 'completed' then 1 end) as done,
  count(case when status = 'failed' then 1 end) as failed, count(case when status = 'cancelled' then 1 end) as cancelled from f_sub_jobs group by fan_out_id)"""

JOINS = {
    "src_fan_out": f"""with {COUNTS} select f.id, f.total_count, coalesce(done, 0) as completed, coalesce(failed, 0) as failed, coalesce(cancelled, 0) as cancelled
        from f_fan_outs f left join c on c.fan_out_id = f.id""",
    "join_resumable_parents": """select distinct j.id from f_jobs j join f_fan_outs f on f.parent_job_id = j.id where j.status = 'waiting' and f.status in ('completed', 'failed')
        and not exists (select 1 from f_fan_outs p where p.parent_job_id = j.id and p.status = 'pending')""",
    "join_stalled_parents": f"""with {COUNTS} select j.id from f_jobs j join f_fan_outs f on f.parent_job_id = j.id left join c on c.fan_out_id = f.id
        where j.status = 'waiting' and f.status = 'pending' and f.created_at < AS_OF - interval '5' minute and coalesce(c.n, 0) < f.total_count""",
    "join_completable_fanouts": f"""with {COUNTS} select f.id from f_fan_outs f join f_jobs j on j.id = f.parent_job_id left join c on c.fan_out_id = f.id
        where j.status = 'waiting' and f.status = 'pending'
        and (coalesce(done, 0) + coalesce(failed, 0) + coalesce(cancelled, 0) >= f.total_count or coalesce(failed, 0) + coalesce(cancelled, 0) > 0)""",
    "join_abandoned_fanouts": """select f.id from f_fan_outs f join f_jobs j on j.id = f.parent_job_id where f.status = 'pending'
        and j.status in ('completed', 'failed', 'cancelled') and not exists (select 1 from f_sub_jobs s where s.fan_out_id = f.id)""",
    "join_signal_waiters": """select j.id from f_jobs j where j.status = 'waiting'
        and (exists (select 1 from f_signals s where s.job_id = j.id and s.consumed_at is null) or j.run_at <= AS_OF)
        and not exists (select 1 from f_fan_outs f where f.parent_job_id = j.id and f.status = 'pending')""",
    "join_workflow_roots": f"select {J} from f_jobs where parent_job_id is null and id in (select parent_job_id from f_jobs where parent_job_id is not null)",
    "join_paused_exclusion": "select j.id, j.queue from f_jobs j where not exists (select 1 from f_queue_states q where q.paused and q.queue = j.queue)",
    "join_purgeable": """select j.id from f_jobs j where j.status = 'completed' and not exists (select 1 from f_fan_outs f where f.parent_job_id = j.id and f.status = 'pending')
        and not exists (select 1 from f_jobs c where c.parent_job_id = j.id and c.status not in ('completed', 'failed', 'cancelled'))""",
    "join_retention_guards": """select j.id from f_jobs j where j.status = 'completed' and j.completed_at < AS_OF - interval '30' day
        and not exists (select 1 from f_jobs c where c.parent_job_id = j.id and c.status not in ('completed', 'failed', 'cancelled'))
        and not exists (select 1 from f_fan_outs f where f.parent_job_id = j.id and f.status = 'pending')
        and not exists (select 1 from f_jobs p where p.id = j.parent_job_id and p.status not in ('completed', 'failed', 'cancelled'))""",
    "join_delete_guard": """select s.fan_out_id, count(*) as n from f_sub_jobs s join f_fan_outs f on f.id = s.fan_out_id join f_jobs j on j.id = f.parent_job_id
        where j.status not in ('completed', 'failed', 'cancelled') group by s.fan_out_id""",
    "join_batch_complete": """with items as (select id, concat('w', cast(id % 8 as string)) as worker from f_jobs where id % 4 = 1)
        select j.id, 'completed' as status from f_jobs j join items i on i.id = j.id and i.worker = j.locked_by where j.status = 'running'""",
    "join_fanout_overlay": f"""with {COUNTS} select f.id, f.status, coalesce(c.n, 0) as live, f.total_count - coalesce(c.n, 0) as missing from f_fan_outs f left join c on c.fan_out_id = f.id""",
    "join_queue_report": (
        """with p as (select queue, count(*) as pending from f_jobs where status = 'pending' group by queue),
        d as (select queue, count(*) as dlq from f_jobs where dead_lettered_at is not null group by queue),
        o as (select queue, min(created_at) as oldest_pending from f_jobs where status = 'pending' group by queue)
        select queue, coalesce(pending, 0) as pending, coalesce(dlq, 0) as dlq, oldest_pending, greatest(timestampdiff(SECOND, oldest_pending, AS_OF), 0) as backlog_age_s
        from p full outer join d using (queue) full outer join o using (queue)""",
        """select queue, count(case when status = 'pending' then 1 end) as pending, count(dead_lettered_at) as dlq, min(case when status = 'pending' then created_at end) as oldest_pending,
        cast(greatest(epoch(AS_OF) - epoch(min(case when status = 'pending' then created_at end)), 0) as bigint) as backlog_age_s
        from f_jobs group by queue having count(case when status = 'pending' or dead_lettered_at is not null then 1 end) > 0""",
    ),
    "join_history_merge": """with a as (select bucket_ts, sum(completed) as n from f_job_stats where queue = 'q1' and completed > 0 group by bucket_ts),
        b as (select bucket_ts, sum(failed) as n from f_job_stats where queue = 'q1' and failed > 0 group by bucket_ts)
        select coalesce(a.bucket_ts, b.bucket_ts) as bucket_ts, cast(coalesce(a.n, 0) as bigint) as completed, cast(coalesce(b.n, 0) as bigint) as failed
        from a full outer join b on a.bucket_ts = b.bucket_ts""",
    "join_marker_checkpoint": "select j.id from f_jobs j where exists (select 1 from f_checkpoints c where c.job_id = j.id and substring(c.call_type, 6, 1) = lower(substring(j.queue, 1, 1)))",
}
AGGREGATES = {
    "agg_queue_depth": """select j.queue, count(case when status = 'pending' then 1 end) as pending, count(case when status = 'running' then 1 end) as running,
        count(case when status = 'completed' then 1 end) as completed, count(case when status = 'failed' then 1 end) as failed,
        count(case when status = 'waiting' then 1 end) as waiting, count(case when status = 'paused' then 1 end) as paused,
        count(case when status = 'cancelled' then 1 end) as cancelled, count(case when status = 'retrying' then 1 end) as retrying,
        min(case when status = 'pending' then created_at end) as oldest_pending, coalesce(bool_or(q.paused), false) as is_paused
        from f_jobs j left join f_queue_states q on q.queue = j.queue group by j.queue""",
    "agg_totals": "select count(*) as total, count(case when status = 'pending' then 1 end) as pending, count(distinct case when status = 'running' then nullif(locked_by, '') end) as active_workers from f_jobs",
    "agg_active_workers": "select count(distinct locked_by) as workers from f_jobs where status = 'running' and locked_by <> ''",
    "agg_pending_counts": "select queue, count(*) as n from f_jobs where status = 'pending' group by queue",
    "agg_running_counts": "select queue, count(*) as n from f_jobs where status = 'running' group by queue",
    "agg_dlq_counts": "select queue, count(*) as n from f_jobs where dead_lettered_at is not null group by queue",
    "agg_dlq_total": "select count(*) as n from f_jobs where dead_lettered_at is not null and queue = 'ASIA'",
    "agg_oldest_pending": "select queue, min(created_at) as oldest from f_jobs where status = 'pending' group by queue",
    "agg_slot_cardinality": "select count(*) as n from f_slots where job_id = -1",
    "agg_live_slots": "select slot_name, count(*) as n from f_slots where job_id <> -1 and expires_at >= AS_OF group by slot_name",
    "agg_fanout_counts": "select fan_out_id, count(case when status = 'completed' then 1 end) as completed, count(case when status = 'failed' then 1 end) as failed, count(case when status = 'cancelled' then 1 end) as cancelled from f_sub_jobs group by fan_out_id",
    "agg_fanout_terminal": f"""with {COUNTS}, d as (select f.id, f.strategy, f.total_count as total, coalesce(done, 0) as done, coalesce(failed, 0) + coalesce(cancelled, 0) as bad,
          least(f.total_count, greatest(cast(ceil(f.total_count * f.threshold) as bigint), 0)) as required from f_fan_outs f left join c on c.fan_out_id = f.id)
        select id, case when strategy = 'fail_fast' and bad > 0 then 'failed' when strategy = 'fail_fast' and done >= total then 'completed'
          when strategy = 'collect_all' and done + bad >= total then 'completed'
          when strategy = 'threshold' and done + (total - done - bad) < required then 'failed'
          when strategy = 'threshold' and done + bad >= total then 'completed' else 'open' end as decision from d""",
    "agg_search_total": "select count(*) as total from f_jobs where status = 'pending' and queue = 'ASIA'",
    "agg_workflow_summary": """select parent_job_id as root, count(*) as total, count(case when status = 'completed' then 1 end) as completed, count(case when status = 'failed' then 1 end) as failed,
        greatest(count(*) - count(case when status in ('completed', 'failed', 'cancelled') then 1 end), 0) as running from f_jobs where parent_job_id is not null group by parent_job_id""",
    "agg_workflow_strategy": "select parent_job_id % 100 as grp, case when count(distinct strategy) = 1 then max(strategy) else 'mixed' end as strategy from f_fan_outs group by parent_job_id % 100",
    "agg_stats_minute": """select queue, cast(date_trunc('minute', ts) as timestamp) as bucket_ts, count(case when type = 'job.completed' then 1 end) as completed,
        count(case when type = 'job.failed' then 1 end) as failed from f_events group by queue, cast(date_trunc('minute', ts) as timestamp)""",
    "agg_failure_rate": "select queue, round(100e0 * count(case when status = 'failed' then 1 end) / count(case when status in ('completed', 'failed', 'cancelled') then 1 end), 6) as rate from f_jobs group by queue",
    "agg_backlog_total": "select count(*) as backlog from f_jobs where status in ('pending', 'running', 'paused', 'retrying', 'waiting')",
    "agg_throughput_min": "select queue, round(cast(sum(completed + failed) as double) / 1440, 6) as per_minute from f_job_stats group by queue",
    "agg_queue_totals": "select cast(sum(completed) as bigint) as completed, cast(sum(failed) as bigint) as failed, cast(sum(retried) as bigint) as retried from f_job_stats",
    "agg_workflow_progress": f"""with {COUNTS} select f.id, cast(least(100, floor(100.0 * coalesce(done, 0) / f.total_count + 0.5)) as bigint) as percent
        from f_fan_outs f left join c on c.fan_out_id = f.id where f.total_count > 0""",
    "agg_outcome_counters": "select queue, type, count(*) as n from f_events group by queue, type",
    "agg_run_hist": """select queue, case when duration_s < 0 then 'skew' when duration_s < 10 then '<10' when duration_s < 50 then '<50' when duration_s < 100 then '<100' else '>=100' end as bucket,
        count(*) as n from f_events where type in ('job.completed', 'job.failed') group by 1, 2""",
    "agg_wait_hist": """select queue, case when started_at < created_at then 'skew' when started_at <= created_at + interval '1' minute then '<=1m'
        when started_at <= created_at + interval '5' minute then '<=5m' else '>5m' end as bucket, count(*) as n from f_jobs where started_at is not null group by 1, 2""",
    "agg_reclaim_counts": "select case when last_heartbeat_at is null then 'never_beat' else 'stale' end as reason, count(*) as n from f_jobs where status = 'running' group by 1",
    "agg_saturation": "select slot_name, round(cast(count(case when job_id <> -1 and expires_at >= AS_OF then 1 end) as double) / 4, 6) as ratio from f_slots group by slot_name",
    # a sketch bounds where the ranks lie (its error is 1/1000, the bounds 4/1000 off), so only the values there are sorted
    "agg_percentile_nr": (
        """with parts as (select queue, n, p, get(q, at) as lo, get(q, at + 1) as hi from (select queue, n, q, explode(map(50, 0, 95, 2)) as (p, at) from
        (select queue, count(*) as n, percentile_approx(duration_s, array(0.496, 0.504, 0.946, 0.954), 1000) as q from f_events where duration_s is not null group by queue) x) y),
        g as (select e.queue, p, n, case when duration_s >= lo then duration_s end as v, count(*) as k from f_events e join parts b on b.queue = e.queue where duration_s <= hi group by 1, 2, 3, 4),
        r as (select queue, p, v, sum(k) over (partition by queue, p order by v nulls first) >= floor((n * p + 99) / 100) as there from g)
        select queue, min(case when p = 50 and there then v end) as p50, min(case when p = 95 and there then v end) as p95 from r group by queue""",
        """with r as (select queue, duration_s, row_number() over (partition by queue order by duration_s, event_id) as k, count(*) over (partition by queue) as n from f_events where duration_s is not null)
        select queue, max(case when k = floor((n * 50 + 99) / 100) then duration_s end) as p50, max(case when k = floor((n * 95 + 99) / 100) then duration_s end) as p95 from r group by queue""",
    ),
    "agg_time_domain": "select queue, min(started_at) as first_start, max(completed_at) as last_end from f_jobs group by queue",
    "agg_dup_groups": "select unique_key, count(*) as n from f_jobs where unique_key <> '' and status in ('pending', 'running') group by unique_key having count(*) > 1",
    "agg_sum_coalesce": "select cast(coalesce(sum(attempt), 0) as bigint) as attempts from f_jobs where queue = 'none'",
    "agg_partial_final": "select queue, cast(sum(completed) as bigint) as completed, cast(sum(failed) as bigint) as failed from f_job_stats group by queue",
}

ORDER = "priority desc, coalesce(run_at, created_at), id"
WINDOWS = {
    "win_per_queue_topk": f"select id, queue from (select id, queue, row_number() over (partition by queue order by {ORDER}) as k from f_jobs where status = 'pending' and coalesce(run_at, created_at) <= AS_OF) where k <= 25",
    "win_fair_budgets": """select id, queue, cast(k as bigint) as k from (select id, queue, k, row_number() over (order by k, queue) as slot from
        (select id, queue, row_number() over (partition by queue order by priority desc, created_at, id) as k from f_jobs where status = 'pending') where k <= 12) where slot <= 12""",
    "win_rate_admission": """select event_id from (select event_id, row_number() over (partition by queue, cast(date_trunc('minute', ts) as timestamp) order by ts, event_id) as k from f_events) where k <= 2""",
    "win_fifo_signals": "select id, job_id, name, cast(row_number() over (partition by job_id, name order by created_at, id) as bigint) as position from f_signals where consumed_at is null",
    "win_inbatch_dedup": "select id, unique_key, first_value(id) over (partition by unique_key order by id) as kept_id from f_jobs where unique_key <> ''",
    # a queue is cut by the hour, with what the hours before carry over, so a hot one isn't one window
    "win_consecutive_orphans": (
        """with e as (select queue, event_id, ts, date_trunc('hour', ts) as h, type = 'job.failed' as failed from f_events),
        b as (select queue, h, coalesce(sum(k) over (partition by queue order by h rows between unbounded preceding and 1 preceding), 0) as carried from (select queue, h, count_if(not failed) as k from e group by queue, h) x),
        i as (select e.queue, event_id, failed, carried + count_if(not failed) over (partition by e.queue, e.h order by ts, event_id) as island from e join b on b.queue = e.queue and b.h = e.h)
        select queue, min(event_id) as first_event, count(*) as run from i where failed group by queue, island having count(*) >= 3""",
        """with e as (select queue, event_id, ts, type, row_number() over (partition by queue order by ts, event_id) - row_number() over (partition by queue, type order by ts, event_id) as island from f_events)
        select queue, min(event_id) as first_event, count(*) as run from e where type = 'job.failed' group by queue, island having count(*) >= 3""",
    ),
    "win_status_transitions": (
        """with e as (select event_id, queue, type, ts, date_trunc('hour', ts) as h from f_events),
        b as (select queue, h, lag(ended) over (partition by queue order by h) as carried from (select queue, h, max_by(type, struct(ts, event_id)) as ended from e group by queue, h) x)
        select event_id, e.queue, type, coalesce(lag(type) over (partition by e.queue, e.h order by ts, event_id), carried) as before from e join b on b.queue = e.queue and b.h = e.h""",
        "select event_id, queue, type, lag(type) over (partition by queue order by ts, event_id) as before from f_events",
    ),
}

SORTS = {
    "srt_dequeue": f"select {J} from f_jobs where status = 'pending' order by {ORDER} limit 1",
    "srt_dequeue_batch": f"select {J} from f_jobs where status = 'pending' and coalesce(run_at, created_at) <= AS_OF order by {ORDER} limit 50",
    "srt_search": f"select {J} from f_jobs where queue = 'ASIA' order by priority asc, created_at desc, id desc limit 50",
    "srt_page": f"select {J} from f_jobs order by created_at desc, id desc limit 50 offset 100",
    "srt_page_rpc": f"select {J} from f_jobs order by created_at desc, id desc limit 50 offset 50",
    "srt_page_bounds": "select cast(ceil(count(*) / 50.0) as bigint) as pages, least(count(*), 50) as last_row from f_jobs",
    "srt_dlq": "select id, queue, dead_lettered_at from f_jobs where dead_lettered_at is not null order by dead_lettered_at desc, id desc limit 50",
    "srt_keyset": f"select {J} from f_jobs where status = 'waiting' and id > 1000 order by id limit 100",
    "srt_retention": "select id, completed_at from f_jobs where status = 'completed' and completed_at < AS_OF - interval '30' day order by completed_at, id",
    "srt_stale": "select id from f_jobs where status = 'running' order by coalesce(last_heartbeat_at, started_at, locked_until), id limit 100",
    "srt_top_queues": "select queue, count(case when status = 'pending' then 1 end) as backlog, count(case when status = 'failed' then 1 end) as failed from f_jobs group by queue order by 2 desc, 3 desc, 1 limit 5",
    "srt_workflows": "select parent_job_id, count(case when status = 'failed' then 1 end) as failed from f_jobs where parent_job_id is not null group by parent_job_id order by 2 desc, 1 limit 50",
    "srt_schedules": "select name, every_minutes, last_fired_at from f_scheduled_fires order by last_fired_at asc nulls last, name limit 25",
}

SETS = {
    "set_union_all": "select id, 'a' as part from f_jobs where id % 10 = 1 union all select id, 'b' as part from f_jobs where id % 10 in (1, 2)",
    "set_union_status": (
        f"select {J} from f_jobs where status in ('pending', 'running')",
        f"select {J} from f_jobs where status = 'pending' union all select {J} from f_jobs where status = 'running'",
    ),
    "set_union_keys": "select queue from f_jobs union select queue from f_events",
    "set_difference_committed": "select id from f_jobs where status = 'running' except select id from f_jobs where status = 'running' and locked_by = 'w1'",
    "set_distinct": "select distinct parent_job_id from f_jobs where parent_job_id is not null",
    "dedup_active_unique": """select n.id, n.unique_key from f_jobs n where n.status = 'completed' and n.unique_key <> ''
        and not exists (select 1 from f_jobs a where a.unique_key = n.unique_key and a.status in ('pending', 'running'))""",
    "dedup_batch": """with active as (select unique_key, min(id) as id from f_jobs where unique_key <> '' and status in ('pending', 'running') group by unique_key),
        batch as (select id, unique_key, min(id) over (partition by unique_key) as first_id from f_jobs where unique_key <> '' and status = 'completed')
        select b.id, coalesce(a.id, b.first_id) as kept_id from batch b left join active a on a.unique_key = b.unique_key""",
    "dedup_windowed": """select l.scope_hash, case when l.expires_at > AS_OF and coalesce(j.status, 'missing') not in ('failed', 'cancelled', 'missing') then l.job_id else -1 end as holder
        from f_unique_locks l left join f_jobs j on j.id = l.job_id""",
    "dedup_scheduled_fire": "select name, max(last_fired_at) as cursor_at from f_scheduled_fires group by name having max(last_fired_at) < AS_OF",
    "dedup_fanout_key": "select concat('fanout-', cast(fan_out_id as string), '-', cast(fan_out_index as string)) as unique_key from f_sub_jobs",
}

INVARIANTS = {
    "inv_exactly_once": "select count(*) as violations from (select job_id, call_index, call_type from f_checkpoints group by job_id, call_index, call_type having count(*) > 1)",
    "inv_at_least_once": "select count(*) as n from f_checkpoints where call_type like 'step.r%'",
    "inv_no_wedge": "select count(case when status = 'waiting' then 1 end) as waiting, count(case when status = 'running' then 1 end) as running from f_jobs",
    "inv_ready": "select count(*) as violations from f_jobs where status = 'pending' and coalesce(run_at, created_at) > AS_OF",
    "inv_fanout_counts": f"with {COUNTS} select count(*) as violations from f_fan_outs f left join c on c.fan_out_id = f.id where coalesce(done, 0) + coalesce(failed, 0) + coalesce(cancelled, 0) <> f.total_count",
    "inv_unique": "select count(*) as violations from (select unique_key from f_jobs where unique_key <> '' and status in ('pending', 'running') group by unique_key having count(*) <> 1)",
    "inv_unique_windowed": "select count(*) as violations from (select scope_hash from f_unique_locks group by scope_hash having count(*) <> 1)",
    "inv_signal": "select count(*) as sent, count(consumed_at) as consumed from f_signals",
    "inv_slots": "select count(*) as violations from f_slots where job_id <> -1 and expires_at >= AS_OF",
    "inv_rate": "select count(*) as violations from f_job_stats where completed < 0 or failed < 0 or retried < 0",
    "inv_checks": "select count(*) as violations from f_jobs where status not in ('pending', 'running', 'completed', 'failed', 'waiting', 'paused', 'cancelled', 'retrying') or attempt < 0 or max_retries < 0",
    "inv_fk": "select count(*) as violations from f_checkpoints c where not exists (select 1 from f_jobs j where j.id = c.job_id)",
    "inv_drained": "select count(*) as n from f_jobs where status in ('pending', 'running', 'waiting')",
}

FUNCTIONS = {
    "fn_valid_name": "select id, type, regexp_extract(type, '^[a-zA-Z][a-zA-Z0-9_.-]*$', 0) <> '' and length(type) <= 255 as valid from f_jobs",
    "fn_unique_key_ok": "select id, length(unique_key) <= 255 as ok from f_jobs",
    "fn_trunc_minute": "select event_id, cast(date_trunc('minute', ts) as timestamp) as minute from f_events",
    "fn_clamp": "select id, least(greatest(attempt * 60 - 30, 0), 100) as retries, greatest(attempt - 1, 0) as floored from f_jobs",
    "fn_backoff": "select id, greatest(0, least(0.5 * power(cast(3 as double), attempt), 60) * (1 + 0.1 * (2 * ((id * 7919 % 1000) / cast(1000 as double)) - 1))) as delay_s from f_jobs",
    "fn_rate_ceiling": "select name, cast(ceil(every_minutes / 60.0 * 7) as bigint) as ceiling from f_scheduled_fires",
    "fn_rate_window": "select name, case when every_minutes > 60 then cast(ceil(every_minutes / 60.0) as bigint) else cast(1 as bigint) end as window_s from f_scheduled_fires",
    "fn_slot_ttl": "select name, greatest(every_minutes, 3 * 20) as ttl from f_scheduled_fires",
    "fn_age_heat": "select event_id, case when duration_s >= 600 then 'danger' when duration_s >= 120 then 'warn' else 'ok' end as heat from f_events",
    "fn_aggregate_reason": "select id, case when status = 'running' then 'job is running' when status in ('completed', 'cancelled') then 'not retryable' else 'ok' end as reason from f_jobs",
}

BAD = "('failed', 'cancelled')"
TRANSITIONS = {
    "dml_claim": f"select id, 'running' as status, attempt + 1 as attempt, 'me' as locked_by, AS_OF + interval '45' minute as locked_until from (select * from f_jobs where status = 'pending' and coalesce(run_at, created_at) <= AS_OF order by {ORDER} limit 50)",
    "dml_complete": "select id, 'completed' as status, '' as locked_by, AS_OF as completed_at from f_jobs where status = 'running' and locked_by = 'w1'",
    "dml_batch_complete": "select j.id, 'completed' as status from f_jobs j where j.status = 'running' and j.locked_by = 'w5' and not exists (select 1 from f_sub_jobs s where s.parent_job_id = j.id)",
    "dml_retry": "select id, 'pending' as status, AS_OF + cast(least(power(2.0, attempt), 60.0) as int) * interval '1' second as run_at from f_jobs where status = 'running' and attempt < max_retries",
    "dml_fail": "select id, 'failed' as status, AS_OF as dead_lettered_at, case when attempt >= max_retries then 'max retries exhausted' else 'non-retryable failure' end as dead_letter_reason from f_jobs where status = 'running' and locked_by = 'w6'",
    "dml_release": "select id, 'pending' as status, greatest(attempt - 1, 0) as attempt from f_jobs where status = 'running' and locked_by = 'w2'",
    "dml_heartbeat": "select id, AS_OF as last_heartbeat_at, AS_OF + interval '45' minute as locked_until from f_jobs where status = 'running' and locked_by = 'w5'",
    "dml_reap": "select id, 'pending' as status, attempt from f_jobs where status = 'running' and coalesce(last_heartbeat_at, started_at, locked_until) < AS_OF - interval '45' minute",
    "dml_wait": "select id, 'waiting' as status, AS_OF + interval '1' hour as run_at from f_jobs where status = 'running' and locked_by = 'w6'",
    "dml_resume": "select id, 'pending' as status, greatest(attempt - 1, 0) as attempt from f_jobs where status in ('waiting', 'paused')",
    "dml_resume_signal": "select j.id, 'pending' as status from f_jobs j where j.status = 'waiting' and exists (select 1 from f_signals s where s.job_id = j.id and s.consumed_at is null)",
    "dml_pause_graceful": "select id, 'paused' as status, status as previous_status from f_jobs where status in ('pending', 'waiting')",
    "dml_pause_aggressive": "select id, case when status = 'running' then 'cancelled' else 'paused' end as status, status as previous_status from f_jobs where status in ('pending', 'waiting', 'running')",
    "dml_cancel_subs": "select fan_out_id, fan_out_index, 'cancelled' as status from f_sub_jobs where status in ('pending', 'running')",
    "dml_fanout_reconcile": f"with {COUNTS} select f.id, coalesce(done, 0) as completed_count, coalesce(failed, 0) as failed_count, coalesce(cancelled, 0) as cancelled_count from f_fan_outs f left join c on c.fan_out_id = f.id",
    "dml_requeue": f"select id, 'pending' as status, 0 as attempt, '' as last_error from f_jobs where status in {BAD}",
    "dml_bulk_requeue": "select id, 'pending' as status, 0 as attempt from f_jobs where dead_lettered_at is not null and queue = 'ASIA'",
    "dml_bulk_retry": f"select i.id, case when j.id is null then 'not found' when j.status not in {BAD} then 'not retryable' else 'retried' end as outcome from (select o_orderkey * 2 as id from orders where o_orderkey % 50 = 0) i left join f_jobs j on j.id = i.id",
    "dml_bulk_delete": "select i.id, case when j.id is null then 'not found' when j.status = 'running' then 'running' else 'deleted' end as outcome from (select o_orderkey * 2 as id from orders where o_orderkey % 50 = 0) i left join f_jobs j on j.id = i.id",
    "dml_delete": "select id from f_jobs where id <> 42",
    "dml_purge": "select id from f_jobs where status <> 'completed'",
    "dml_retention": """select c.job_id, c.call_index from f_checkpoints c where not exists
        (select 1 from f_jobs j where j.id = c.job_id and j.status = 'completed' and j.completed_at < AS_OF - interval '30' day)""",
    "dml_queue_pause": "select queue, paused or queue = 'EUROPE' as paused from f_queue_states",
    "dml_queue_unpause": "select queue, paused and queue <> 'ASIA' as paused from f_queue_states",
    "dml_promote": "select id, true as dq_ready from f_jobs where status = 'pending' and run_at <= AS_OF",
    "dml_signal_consume": "select id, AS_OF as consumed_at from (select id, row_number() over (partition by job_id, name order by created_at, id) as k from f_signals where consumed_at is null) where k = 1",
    "dml_signal_drain": "select id, AS_OF as consumed_at from f_signals where consumed_at is null and name = 'user'",
}

ALL = {**SCANS, **FILTERS, **JOINS, **AGGREGATES, **WINDOWS, **SORTS, **SETS, **INVARIANTS, **FUNCTIONS, **TRANSITIONS}
