"""What a user plugs in: retry policies, failure predicates, partition keys, middleware and hooks, as column and frame functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Policy = Callable[[Column, Column], Column]  # of attempt and error
Next = Callable[[DataFrame], DataFrame]
Around = Callable[[DataFrame, Next], DataFrame]

# fixed values: which event calls which hook
HOOKS = {"start": "job.started", "complete": "job.completed", "fail": "job.failed", "retry": "job.retrying", "waiting": "job.waiting", "reclaimed": "job.reclaimed"}


def exponential(first: float = 1, cap: float = 60) -> Policy:
    return lambda attempt, _: F.least(F.lit(float(cap)), first * F.pow(F.lit(2.0), attempt))


def retry_delay(attempt: Column, error: Column, policy: Policy | None = None) -> Column:
    """Seconds to the next try by the user's policy, else exponential; less than 0 or null is 0."""
    return F.greatest(F.lit(0.0), F.coalesce((policy or exponential())(attempt, error).cast("double"), F.lit(0.0)))


def is_failure(error: Column, panicked: Column, predicate: Callable[[Column], Column] | None = None) -> Column:
    """Whether a finished run counts as a failure: a panic always, no error never, else as the predicate says (null: it does)."""
    failed = F.coalesce(error != "", F.lit(False))
    told = F.lit(True) if predicate is None else F.coalesce(predicate(error), F.lit(True))
    return F.coalesce(panicked, F.lit(False)) | (failed & told)


def partition_key(prefix: str, parts: list[Column], only: Column | None = None) -> Column:
    """The name of a cap or limit for a row, '' where it has none."""
    named = F.concat_ws(":", F.lit(prefix), *parts)
    return named if only is None else F.when(only, named).otherwise("")


def chain(rows: DataFrame, around: list[Around], last: Next) -> DataFrame:
    """Runs ``last`` inside the middleware, the first of which is outermost. One that doesn't call its next vetoes the rest."""
    return reduce(lambda inner, one: partial(lambda one, inner, df: one(df, inner), one, inner), reversed(around), last)(rows)


class Hooks:
    """Listeners by the name of a hook; each gets the rows of a micro-batch that concern it."""

    def __init__(self) -> None:
        self.listeners: list[tuple[str, Callable[[DataFrame, int], None]]] = []

    def on(self, hook: str, listener: Callable[[DataFrame, int], None]) -> Hooks:
        if hook not in HOOKS:
            raise ValueError(f"unknown hook {hook!r}")
        self.listeners.append((hook, listener))
        return self

    def write(self, rows: DataFrame, _path: str, batch: int) -> None:
        """For ``foreachBatch``; a listener may see a batch again after a failure, under the same number."""
        for hook, listener in self.listeners:
            listener(rows.where(F.col("type") == HOOKS[hook]), batch)
