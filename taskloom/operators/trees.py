"""Walks over job trees as loops of joins, cut by reliable checkpoints.

A recursive CTE is bound in rows and levels, doesn't end on a cycle, and loses
all levels with an executor. Here the driver sees one bit a level: whether the
frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskloom.sources import sinks

# fixed values: bounds of the walks
MAX_HOPS, MAX_SHOWN = 100, 1000
# levels after which the rows seen so far are cut off from their plan
LEVELS_A_PLAN = 32


def checkpointed(rows: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(sinks.shared_folder(spark))
    return rows.checkpoint(eager=True)


def subtree(jobs: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, depth) of ``roots`` and all jobs below them, each at its least depth; cycles end where they close.

    Goes as deep as the tree; over ``max_depth``, if given, it raises rather than leave jobs out.
    """
    # exploded, as a checkpoint keeps its plan's constraints under stale names, on which the union fails
    bare = lambda rows: rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_r")).select("_r.*")
    # two columns, so a level doesn't run the plan of ``jobs`` again
    links = checkpointed(bare(jobs.select(F.col("id"), F.col("parent_job_id").alias("_up")).where(F.col("_up").isNotNull())))
    frontier = checkpointed(bare(roots.select("id").distinct()))
    seen, depth = frontier.withColumn("depth", F.lit(0)), 0
    while True:
        depth += 1
        below = links.join(frontier.select(F.col("id").alias("_up")), "_up").select("id").distinct()
        frontier = checkpointed(bare(below.join(seen, "id", "left_anti")))
        if frontier.isEmpty():
            return seen
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"jobs lie more than {max_depth} levels below the roots")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % LEVELS_A_PLAN == 0:
            seen = checkpointed(bare(seen))


def shown(jobs: DataFrame, roots: DataFrame, limit: int = MAX_SHOWN) -> DataFrame:
    """(id, parent_job_id, depth, truncated): the first ``limit`` jobs below the roots by depth and id, for display."""
    page = subtree(jobs, roots).where("depth > 0").orderBy("depth", "id").limit(limit + 1)
    page = checkpointed(page.join(jobs.select("id", "parent_job_id"), "id"))
    return page.orderBy("depth", "id").limit(limit).withColumn("truncated", F.lit(page.count() > limit))


def climb(jobs: DataFrame, starts: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(start_id, root, hops) of each start: its topmost job.

    Pointers double each round, so a chain of n jobs takes log2(n) joins. A
    start on a cycle, below a missing parent or over ``max_hops`` deep has no row.
    """
    up = checkpointed(jobs.select("id", F.col("parent_job_id").alias("up"), F.lit(1).alias("hops")).withColumn("hops", F.when(F.col("up").isNull(), 0).otherwise(1)))
    reached = 1
    while reached <= max_hops:
        ahead = up.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"))
        # a pointer whose target is a root stays on it: the target's own pointer is null
        step = up.join(ahead, "up", "left").select(
            "id",
            F.coalesce("_up", "up").alias("up"),
            (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.col("_up").isNotNull().alias("moved"),
        )
        step = checkpointed(step)
        moved = not step.where("moved").isEmpty()
        up, reached = step.drop("moved"), 2 * reached
        if not moved:
            break
    roots = jobs.where(F.col("parent_job_id").isNull()).select(F.col("id").alias("root"))
    ends = up.select(F.col("id").alias("start_id"), F.coalesce("up", "id").alias("root"), "hops").where(F.col("hops") <= max_hops)
    return ends.join(starts.select(F.col("id").alias("start_id")), "start_id").join(roots, "root", "left_semi").select("start_id", "root", "hops")
