"""User functions over job payloads: handlers, typed handles, memoised calls and fan-out."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RESULT = 1 << 20  # bytes


class NoRetry(Exception):
    """Raised by a handler for an error that a retry can't mend."""


def outcome(handler: Callable, takes_args: bool = True):
    """A column function of a JSON payload: (result JSON, error, kind), kind one of '', 'retry', 'no_retry'.

    A null or empty payload is ``no_retry`` for a handler that takes arguments;
    a payload that is no JSON, or an exception, is ``retry``; NoRetry and a
    result over MAX_RESULT bytes are ``no_retry``. A handler that returns None
    has a null result.
    """

    def one(payload):
        try:
            if takes_args and not payload:
                raise NoRetry("failed to unmarshal args: unexpected end of JSON input")
            value = handler(json.loads(payload)) if takes_args else handler()
            result = None if value is None else json.dumps(value, separators=(",", ":"))
            if result is not None and len(result.encode()) > MAX_RESULT:
                raise NoRetry(f"handler result is {len(result.encode())} bytes, limit is {MAX_RESULT}")
            return result, "", ""
        except NoRetry as error:
            return None, str(error), "no_retry"
        except Exception as error:
            return None, str(error), "retry"

    @F.pandas_udf("result string, error string, kind string")
    def run(payload: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) for x in payload], columns=["result", "error", "kind"], dtype="object")

    return run


@dataclass(frozen=True)
class Typed:
    """A job type with the DDL of its arguments and result."""

    name: str
    args: str
    result: str

    def enqueue(self, rows: DataFrame) -> DataFrame:
        """(type, args JSON) of rows that have the argument columns."""
        fields = [f.name for f in rows.sparkSession.createDataFrame([], self.args).schema]
        return rows.select(F.lit(self.name).alias("type"), F.to_json(F.struct(*fields)).alias("args"))

    def load(self, result: Column) -> Column:
        """A stored result as a struct."""
        return F.from_json(result, self.result)


def call(jobs: DataFrame, checkpoints: DataFrame, index: int, name: str, value: Column) -> DataFrame:
    """(id, value, replayed, conflict) of a call: the checkpoint at ``index`` if there is one, else ``value``.

    A checkpoint of another type at that index is a conflict and has no value.
    """
    found = checkpoints.where(F.col("call_index") == index).select(F.col("job_id").alias("id"), "call_type", "result")
    conflict = F.col("call_type").isNotNull() & (F.col("call_type") != name)
    return jobs.join(found, "id", "left").select(
        "id",
        F.when(conflict, F.lit(None)).when(F.col("call_type").isNotNull(), F.col("result")).otherwise(value).alias("value"),
        F.coalesce(F.col("call_type") == name, F.lit(False)).alias("replayed"),
        conflict.alias("conflict"),
    )


def fan_out(parents: DataFrame, count: Column, kind: str) -> DataFrame:
    """(fan_out_id, fan_out_index, type): ``count`` children of each parent, none for null or zero."""
    spread = F.when(count > 0, F.sequence(F.lit(0), count.cast("int") - 1))
    return parents.select(F.col("id").alias("fan_out_id"), F.explode(spread).alias("fan_out_index")).withColumn("type", F.lit(kind))


def fan_in(children: DataFrame) -> DataFrame:
    """(fan_out_id, results): the results of each fan-out by position; a group is one fan-out's children."""
    rows = F.array_sort(F.collect_list(F.struct("fan_out_index", "result")))
    return children.groupBy("fan_out_id").agg(rows.alias("r")).select("fan_out_id", F.col("r.result").alias("results"))
