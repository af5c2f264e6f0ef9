"""All registered queries with their oracle SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from taskloom.functions import redaction
from taskloom.operators import extended, live, relational, surface
from taskloom.plans.registry import ENTRIES, register
from taskloom.sources import fixtures
from taskloom.streaming import events


def _run(sql: str, spark, sf_dir: str):
    return fixtures.run(spark, sf_dir, sql)


for _name, _sql in {**relational.ALL, **extended.ALL}.items():
    if _name in live.ALL:
        continue
    _ours, _theirs = (_sql, _sql) if isinstance(_sql, str) else _sql
    register(_name, partial(_run, _ours), fixtures.expand(_theirs))


def _payloads(spark, sf_dir: str):
    return fixtures.run(spark, sf_dir, "select id, payload from f_signals")


def _minutes(spark, sf_dir: str):
    return events.minute_counters(fixtures.view(spark, sf_dir, "f_events"))


def _queue_events(spark, sf_dir: str):
    return events.in_queues(fixtures.view(spark, sf_dir, "f_events"), ["q1", "q3"]).select("event_id", "queue", "type")


# callbacks per match can't be stated in SQL; tests use plain Python
register("fn_redact_secrets", lambda spark, sf_dir: _payloads(spark, sf_dir).select("id", redaction.redact(F.col("payload")).alias("redacted")))
register("fn_sanitize_error", lambda spark, sf_dir: _payloads(spark, sf_dir).select("id", redaction.sanitize(F.col("payload")).alias("error")))
register("str_tumbling_minute", _minutes, fixtures.expand("select queue, bucket_ts, completed, failed, retried from f_job_stats"))
register("str_filter_out", _queue_events, fixtures.expand("select event_id, queue, type from f_events where queue in ('q1', 'q3')"))

for _name, (_ours, _theirs) in {**surface.ALL, **live.ALL}.items():
    register(_name, _ours, _theirs)


def queries() -> dict:
    return {name: entry.run for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql}
