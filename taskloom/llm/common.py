"""Shared helpers of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contracts state it: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Catalyst may copy a projected expression into each place that uses it; a
    lambda variable can't be copied.
    """
    return F.transform(F.array(value), body)[0]


def once(value: Column) -> Column:
    """``value`` as it is, but not copied by Catalyst into the expressions and filters that use it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)  # always true


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII texts take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def alnum_words(text: Column) -> Column:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after ascii_lower; null has none."""
    split = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    # a separator at an end leaves an empty piece there, and nowhere else
    return F.array_remove(split, "")


def _folder(spark: SparkSession) -> str:
    """The shared folder that the session names; only where it names none (tests) one of our own, below its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``, whatever its columns are called, in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_folder(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Intermediate tables, written as Parquet in the shared folder and read again.

    They outlive executors, are compressed, and reading prunes their columns.
    ``drop`` removes those that a step is done with; tables that a returned
    frame reads stay.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.paths = spark, f"{_folder(spark)}/scratch-{uuid.uuid4().hex}", {}

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths[id(df)][0])
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has ``most`` rows or fewer."""
    return df.limit(most + 1).count() <= most


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) -> (id, root), root the least id.

    Alternating large-star and small-star rounds: every round aggregates on a
    node and never gathers a component, so a hub or a component of any size
    stays spread. Each round is a written table, removed after the next; it ends
    when the edge set, held as a star forest, stops changing. Isolated nodes
    aren't in the result. Empty edges give an empty result.
    """
    edges, mark = _marked(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), scratch)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        # large-star: neighbours above a node go to the least neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small-star: neighbours below a node, and the node itself, go to the least of them
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, last = edges, mark
        edges, mark = _marked(small.where("a <> b").distinct(), scratch)
        scratch.drop(before)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    )


def _marked(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """``edges`` written, with a mark that tells equal sets; it is taken while writing."""
    seen = Observation()
    mark = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s"), F.sum(F.xxhash64("b", "a") % 998244353).alias("x")]
    out = scratch.table(edges.observe(seen, *mark))
    return out, tuple(seen.get[k] or 0 for k in ("n", "s", "x"))
