"""The derived job dataset: views over the test tables, one SQL text for both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "timestamp '2000-01-01 00:00:00'"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "f_jobs": """
        select b.*,
          case when status in ('running','completed','failed','cancelled') then created_at + cast(id % 600 as int) * interval '1' second end as started_at,
          case when status in ('completed','failed','cancelled') then created_at + cast(id % 600 + id % 3600 as int) * interval '1' second end as completed_at,
          case when status = 'running' then concat('w', cast(id % 8 as string)) else '' end as locked_by,
          case when status = 'running' then created_at + cast(id % 600 + 2700 as int) * interval '1' second end as locked_until,
          case when status = 'running' and id % 2 = 0 then created_at + cast(id % 600 + 120 as int) * interval '1' second end as last_heartbeat_at,
          case when status = 'failed' then created_at + cast(id % 600 + id % 3600 as int) * interval '1' second end as dead_lettered_at,
          case when status = 'failed' then concat('boom ', cast(id % 11 as string)) else '' end as last_error,
          case when id % 50 = 0 then concat('k', cast(id % 400 as string)) else '' end as unique_key,
          case when id >= 10 then cast(floor(id / 10.0) as bigint) end as parent_job_id
        from (
          select o.o_orderkey as id, concat('job.', lower(c.c_mktsegment)) as type, r.r_name as queue,
            concat('t', cast(o.o_custkey % 17 as string)) as tenant,
            concat('{"region":"', r.r_name, '","segment":"', c.c_mktsegment, '"}') as metadata,
            concat('{"order":', cast(o.o_orderkey as string), '}') as args,
            6 - cast(substring(o.o_orderpriority, 1, 1) as int) as priority,
            case when o.o_orderkey % 20 < 5 then 'pending' when o.o_orderkey % 20 < 7 then 'running'
                 when o.o_orderkey % 20 < 13 then 'completed' when o.o_orderkey % 20 < 16 then 'failed'
                 when o.o_orderkey % 20 = 16 then 'waiting' when o.o_orderkey % 20 = 17 then 'paused'
                 when o.o_orderkey % 20 = 18 then 'cancelled' else 'retrying' end as status,
            cast(o.o_orderkey % 4 as int) as attempt, 3 as max_retries,
            o.o_orderdate + cast(o.o_orderkey % 86400 as int) * interval '1' second as created_at,
            case when o.o_orderkey % 3 = 0 then o.o_orderdate + interval '7' day end as run_at
          from orders o join customer c on c.c_custkey = o.o_custkey
          join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey) b
    """,
    "f_sub_jobs": """
        select l_orderkey as fan_out_id, l_orderkey as parent_job_id,
          cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as int) as fan_out_index,
          case when l_returnflag = 'A' then 'completed' when l_returnflag = 'R' and l_linestatus = 'F' then 'failed'
               when l_returnflag = 'R' then 'cancelled' when l_linestatus = 'O' then 'pending' else 'running' end as status,
          l_quantity as result, l_shipdate as created_at
        from lineitem
    """,
    "f_fan_outs": """
        select o.o_orderkey as id, o.o_orderkey as parent_job_id,
          cast(coalesce(x.n, 0) + case when o.o_orderkey % 6 = 0 then 1 else 0 end as int) as total_count,
          case when o.o_orderkey % 3 = 0 then 'fail_fast' when o.o_orderkey % 3 = 1 then 'collect_all' else 'threshold' end as strategy,
          cast(0.25 * (1 + o.o_orderkey % 4) as double) as threshold,
          case when o.o_orderkey % 20 in (5, 6) or o.o_orderkey % 40 = 16 or o.o_orderkey % 7 = 0 then 'pending' when o.o_orderkey % 11 = 0 then 'failed' else 'completed' end as status,
          o.o_orderdate as created_at
        from orders o left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) x on x.l_orderkey = o.o_orderkey
    """,
    "f_checkpoints": """
        select l_orderkey as job_id,
          cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as int) as call_index,
          concat('step.', lower(l_returnflag)) as call_type, l_quantity as result, l_shipdate as created_at
        from lineitem
    """,
    "f_signals": """
        select conv_id * 100000 + turn as id, conv_id as job_id, role as name, text as payload,
          timestamp '1999-12-01 00:00:00' + cast(turn as int) * interval '1' minute as created_at,
          case when turn % 2 = 0 then timestamp '1999-12-15 00:00:00' + cast(turn as int) * interval '1' minute end as consumed_at
        from conversations
    """,
    "f_queue_states": """
        select r_name as queue, r_regionkey = 2 as paused from region
    """,
    "f_events": """
        select event_id, ts, concat('q', cast(user_id % 5 as string)) as queue, user_id as job_id,
          case event_type when 'click' then 'job.started' when 'purchase' then 'job.completed' when 'error' then 'job.failed'
               when 'view' then 'job.retrying' else 'job.paused' end as type, value as duration_s, props as metadata
        from events
    """,
    "f_job_stats": """
        select queue, cast(date_trunc('minute', ts) as timestamp) as bucket_ts,
          cast(sum(case when type = 'job.completed' then 1 else 0 end) as bigint) as completed,
          cast(sum(case when type = 'job.failed' then 1 else 0 end) as bigint) as failed,
          cast(sum(case when type = 'job.retrying' then 1 else 0 end) as bigint) as retried
        from f_events where type in ('job.completed', 'job.failed', 'job.retrying') group by queue, date_trunc('minute', ts)
    """,
    "f_slots": """
        select concat('cap:', cast(s_nationkey as string)) as slot_name, s_suppkey as job_id,
          timestamp '2000-01-01 00:00:00' + cast(s_suppkey % 7 - 3 as int) * interval '1' minute as expires_at from supplier
        union all
        select distinct concat('cap:', cast(s_nationkey as string)), cast(-1 as bigint), timestamp '1970-01-01 00:00:00' from supplier
    """,
    "f_unique_locks": """
        select c_name as scope_hash, c_custkey as job_id,
          timestamp '2000-01-01 00:00:00' + cast(c_custkey % 9 - 4 as int) * interval '1' hour as expires_at from customer
    """,
    "f_scheduled_fires": """
        select n_name as name, 30 + 15 * n_regionkey as every_minutes,
          timestamp '2000-01-01 00:00:00' - n_nationkey * 37 * interval '1' minute as last_fired_at from nation
    """,
}


def expand(sql: str) -> str:
    """``sql`` with the views that it names, and those that they name, as leading CTEs; AS_OF stands for the clock."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(sql)
    ctes = [f"{name} as ({VIEWS[name].strip()})" for name in needed]
    body = sql.strip()
    recursive = body.lower().startswith("with recursive ")
    if body.lower().startswith("with "):
        ctes.append(body[15 if recursive else 5 :])
        text = ("with recursive " if recursive else "with ") + ", ".join(ctes)
    else:
        text = f"with {', '.join(ctes)} {body}" if ctes else body
    return text.replace("AS_OF", AS_OF)


def _zoneless(sql: str) -> str:
    return sql.replace("timestamp '", "timestamp_ntz '").replace("as timestamp)", "as timestamp_ntz)")


def spark_text(sql: str, sf_dir: str) -> str:
    """The same text for Spark: timestamps without zone, tables read from ``sf_dir``."""
    text = _zoneless(expand(sql))
    text = re.sub(r"\bsha256\((\w+)\)", r"sha2(\1, 256)", text)
    names = "|".join(TABLES)
    return re.sub(rf"\b(from|join) ({names})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", text)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(spark_text(sql, sf_dir))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a DataFrame."""
    return run(spark, sf_dir, f"select * from {name}")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table of one base table as a stream over that table's files."""
    text = _zoneless(VIEWS[name])
    (table,) = set(re.findall(r"\bfrom (\w+)", text))
    # a pattern, as a stream's plain path must be a folder
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).parquet(f"{sf_dir}/{table}.parque[t]")
    return spark.sql(re.sub(rf"\bfrom {table}\b", "from {rows}", text), rows=rows)
