"""Name -> (Spark callable, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


ENTRIES: dict[str, Entry] = {}


def register(name: str, run, sql: str | None = None) -> None:
    if name in ENTRIES:
        raise ValueError(f"query {name} is registered twice")
    ENTRIES[name] = Entry(run, sql)
