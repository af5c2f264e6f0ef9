"""Sinks: one atomic commit a batch, safe to retry; upserts are appended and merged when read.

A table is a folder of numbered batches. A keyed write appends its rows as a
batch, and a reader takes the newest row of a key, or adds the rows up: both
combine before the shuffle, and no write reads or rewrites what is there.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# fixed values: bounds of completion batches
MAX_BATCH, MIN_DELAY_MS, MAX_DELAY_MS = 4096, 1, 5000


def append_once(rows: DataFrame, path: str, batch: int) -> None:
    """Writes ``rows`` as the batch of that number; a retry replaces what an earlier try left."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def completion_bounds(size: int, delay_ms: int) -> tuple[int, int]:
    return max(1, min(size, MAX_BATCH)), max(MIN_DELAY_MS, min(delay_ms, MAX_DELAY_MS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; below the warehouse where that's unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def new_table(spark: SparkSession, name: str) -> str:
    """The path of a new table of batches in the shared folder."""
    return f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"


def batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of a table, with the number of their batch."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).withColumn("batch", F.col("batch").cast("int"))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from the newest batch that has the key; a batch has a key once."""
    kept = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*kept), "batch").alias("_r")).select(*keys, "_r.*")


def added(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key added up over the batches."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "batch")])


def write_stream(rows: DataFrame, path: str, checkpoint: str, delay_ms: int | None = None, mode: str = "append", write: Callable = append_once) -> StreamingQuery:
    """Starts a query that writes each micro-batch once; every ``delay_ms``, or what there is and then ends."""
    trigger = {"availableNow": True} if delay_ms is None else {"processingTime": f"{completion_bounds(1, delay_ms)[1]} milliseconds"}
    return rows.writeStream.foreachBatch(lambda df, n: write(df, path, n)).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def drained(stream: DataFrame, name: str, mode: str = "append", write: Callable = append_once, tries: int = 1) -> DataFrame:
    """Runs a stream over what its source has and returns all it wrote, with the number of its batch.

    A run that fails starts again from its checkpoint, ``tries`` runs at most.
    """
    spark = stream.sparkSession
    path = new_table(spark, name)
    for k in range(tries):
        query = write_stream(stream, path, path + "-state", mode=mode, write=write)
        try:
            query.awaitTermination()
            break
        except Exception:
            if k + 1 == tries:
                raise
    return batches(spark, path, stream.schema)


class HotCache:
    """Small aggregates kept for a short time by key; callers at one time share one load, and errors aren't kept."""

    def __init__(self, seconds: float = 2.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self._kept, self._loading, self._lock = seconds, clock, {}, {}, threading.Lock()

    def get(self, key, load: Callable[[], object]):
        with self._lock:
            if key in self._kept and self.clock() < self._kept[key][0]:
                return self._kept[key][1]
            flight = self._loading.get(key)
            mine = flight is None
            if mine:
                flight = self._loading[key] = {"done": threading.Event()}
        if not mine:
            flight["done"].wait()
            if "error" in flight:
                raise flight["error"]
            return flight["value"]
        try:
            flight["value"] = load()
        except BaseException as error:
            flight["error"] = error
            raise
        finally:
            with self._lock:
                self._loading.pop(key)
                self._kept = {k: v for k, v in self._kept.items() if v[0] > self.clock()}
                if "value" in flight:
                    self._kept[key] = (self.clock() + self.seconds, flight["value"])
            flight["done"].set()
        return flight["value"]
