"""Results that must cover every row, on tables larger than any batch or cap."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from taskloom.operators import trees
from taskloom.plans import catalog
from taskloom.sources import fixtures


@pytest.fixture(scope="module")
def large_dir(spark, sf_dir, tmp_path_factory):
    """The small tables with the orders eight times and the conversations forty times, under new keys."""
    out = tmp_path_factory.mktemp("large")
    for name, key, times in (("orders", "o_orderkey", 8), ("conversations", "conv_id", 40), ("customer", None, 1), ("nation", None, 1), ("region", None, 1)):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if key:
            rows = rows.crossJoin(spark.range(times).select(F.col("id").alias("_copy"))).withColumn(key, F.col(key) + 300_000 * F.col("_copy")).drop("_copy")
        rows.coalesce(2).write.parquet(f"{out}/{name}.parquet")
    return str(out)


@pytest.mark.parametrize(
    ("name", "qualifies"),
    [
        ("srt_retention", "from f_jobs where status = 'completed' and completed_at < AS_OF - interval '30' day"),
        ("flt_consumed_signals", "from f_signals where consumed_at < AS_OF - interval '7' day"),
    ],
)
def test_retention_takes_every_row(spark, large_dir, name, qualifies):
    want = {r.id for r in fixtures.run(spark, large_dir, f"select id {qualifies}").collect()}
    got = [r.id for r in catalog.queries()[name](spark, large_dir).collect()]
    assert len(want) > 1000 and len(got) == len(want) and set(got) == want


def test_queue_report_joins_three_counts(spark, large_dir):
    jobs = fixtures.run(spark, large_dir, "select queue, status, created_at, dead_lettered_at from f_jobs").collect()
    pending, dlq = Counter(r.queue for r in jobs if r.status == "pending"), Counter(r.queue for r in jobs if r.dead_lettered_at is not None)
    oldest = {q: min(r.created_at for r in jobs if r.queue == q and r.status == "pending") for q in pending}
    got = {r.queue: (r.pending, r.dlq, r.oldest_pending) for r in catalog.queries()["join_queue_report"](spark, large_dir).collect()}
    assert sum(dlq.values()) > 1000 and got == {q: (pending[q], dlq[q], oldest.get(q)) for q in pending | dlq}


def test_bounces_count_a_queue_whole(spark, large_dir):
    jobs, states = (fixtures.run(spark, large_dir, x).collect() for x in ("select queue from f_jobs where status = 'pending'", "select queue, paused from f_queue_states"))
    pending, paused = Counter(r.queue for r in jobs), {r.queue for r in states if r.paused}
    want = {"paused": sum(n for q, n in pending.items() if q in paused), "queue_cap": sum(max(n - 50, 0) for q, n in pending.items() if q not in paused)}
    assert {r.reason: r.n for r in catalog.queries()["agg_bounce_counts"](spark, large_dir).collect()} == want


def test_retry_takes_no_parents_to_the_driver(spark, sf_dir):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = catalog.queries()["dml_retry_ui"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert "LeftAnti" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("parents", ["none", "repeated", "null"])
def test_retry_is_not_in_for_any_parents(spark, sf_dir, tmp_path, parents):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    odd = {
        "none": lines.limit(0),
        "repeated": lines.where("l_orderkey % 4 > 0").crossJoin(spark.range(3).drop("id")),
        "null": lines.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 4 > 0, F.col("l_orderkey"))),
    }
    # an order without a key beside the others
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders = orders.union(orders.limit(1).withColumn("o_orderkey", F.lit(None).cast("long")))
    duck = duckdb.connect()
    for name in ("orders", "lineitem", "customer", "nation", "region"):
        rows = {"orders": orders, "lineitem": odd[parents]}.get(name)
        (spark.read.parquet(f"{sf_dir}/{name}.parquet") if rows is None else rows).write.parquet(f"{tmp_path}/{name}.parquet")
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(duck.execute(catalog.oracle_sql()["dml_retry_ui"]).fetchall())
    assert bool(want) == (parents != "null")
    assert sorted(map(tuple, catalog.queries()["dml_retry_ui"](spark, str(tmp_path)).collect())) == want


def test_a_tree_is_walked_whole_or_not_at_all(spark, monkeypatch):
    monkeypatch.setattr(trees, "LEVELS_A_PLAN", 2, raising=False)
    jobs = spark.createDataFrame([(k, k - 1 if k else None) for k in range(8)], "id long, parent_job_id long")
    root = spark.createDataFrame([(0,)], "id long")
    assert {r.id: r.depth for r in trees.subtree(jobs, root).collect()} == {k: k for k in range(8)}
    assert trees.subtree(jobs, root, 7).count() == 8
    with pytest.raises(ValueError, match="3 levels"):
        trees.subtree(jobs, root, 3)
