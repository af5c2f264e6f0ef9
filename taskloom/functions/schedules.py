"""Five-field cron in UTC: next fire, catch-up cursor and prose."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the fields with their bounds, the names that two of them take, and the catch-up bound
FIELDS = [("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6)]
NAMES = {
    "month": dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13))),
    "weekday": dict(zip("sun mon tue wed thu fri sat".split(), range(7))),
}
DAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
MAX_CATCH_UP, YEARS_AHEAD = 100_000, 5
MINUTE, DAY = 60_000_000, 86_400_000_000  # microseconds


def _values(text: str, name: str, low: int, high: int) -> tuple[set[int], bool]:
    """The values of one field, and whether it's a bare star."""
    found, star = set(), False
    for part in text.split(","):
        if not (m := re.fullmatch(r"(\*|\?|\w+)(?:-(\w+))?(?:/(\d+))?", part)):
            raise ValueError(f"cron: bad {name} {part!r}")
        first, last, step = m[1], m[2], int(m[3] or 1)
        number = lambda x: NAMES.get(name, {}).get(x.lower()) if not x.isdigit() else int(x)
        if first in "*?":
            if last:
                raise ValueError(f"cron: bad {name} {part!r}")
            a, b = low, high
            star |= step == 1
        else:
            a = number(first)
            b = number(last) if last else (high if m[3] else a)
        if a is None or b is None or step < 1 or a < low or b > high or a > b:
            raise ValueError(f"cron: bad {name} {part!r}")
        found |= set(range(a, b + 1, step))
    return found, star


@dataclass(frozen=True)
class Cron:
    """Fires as ranks: the fires of a span of days are counted, so next, last and how many are due are look-ups."""

    minutes: tuple[int, ...]  # of a day
    day: frozenset[int]
    month: frozenset[int]
    weekday: frozenset[int]
    both: bool  # day and weekday must both hold; else one of them

    @classmethod
    def parse(cls, text: str) -> Cron:
        parts = text.split()
        if len(parts) != len(FIELDS):
            raise ValueError(f"cron: {len(FIELDS)} fields expected, got {len(parts)}")
        (minute, _), (hour, _), (day, any_day), (month, _), (weekday, any_weekday) = (_values(p, *f) for p, f in zip(parts, FIELDS))
        return cls(tuple(sorted(60 * h + m for h in hour for m in minute)), frozenset(day), frozenset(month), frozenset(weekday), any_day or any_weekday)

    def _days(self, first: int, last: int) -> np.ndarray:
        """Matching days since the epoch in [first, last]."""
        n = np.arange(first, last + 1)
        date = n.astype("datetime64[D]")
        month = date.astype("datetime64[M]")
        a = np.isin((date - month).astype(int) + 1, list(self.day))
        b = np.isin((n + 4) % 7, list(self.weekday))
        return n[np.isin(month.astype(int) % 12 + 1, list(self.month)) & ((a & b) if self.both else (a | b))]

    def _rank(self, days: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many fires of ``days`` are at or before each time."""
        day = at // DAY
        k = np.searchsorted(days, day)
        same = (k < len(days)) & (days[np.minimum(k, len(days) - 1)] == day) if len(days) else np.zeros(len(at), bool)
        return k * len(self.minutes) + same * np.searchsorted(self.minutes, at % DAY // MINUTE, side="right")

    def _fire(self, days: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return days[rank // len(self.minutes)] * DAY + np.asarray(self.minutes)[rank % len(self.minutes)] * MINUTE

    def next(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first fire after each time (epoch microseconds), and whether there is one up to five calendar years on."""
        if not len(at):
            return at, np.zeros(0, bool)
        days = self._days(int(at.min() // DAY), int(at.max() // DAY) + 366 * (YEARS_AHEAD + 1))
        rank = self._rank(days, at)
        there = rank < len(days) * len(self.minutes)
        fire = np.zeros_like(at)
        fire[there] = self._fire(days, rank[there])
        year = lambda x: x.astype("datetime64[us]").astype("datetime64[Y]").astype(int)
        return fire, there & (year(fire) <= year(at) + YEARS_AHEAD)

    def seed(self, persisted: np.ndarray, now: np.ndarray) -> np.ndarray:
        """The cursor that leaves one due fire, the newest; ``now`` where over MAX_CATCH_UP are due."""
        if not len(now):
            return now
        first = int(min(persisted.min(), now.min()) // DAY)
        days = self._days(first, int(now.max() // DAY) + 1)
        rank = self._rank(days, now)
        due = rank - self._rank(days, persisted)
        out = persisted.copy()
        many = due >= 2
        out[many] = self._fire(days, rank[many] - 2)
        return np.where(due > MAX_CATCH_UP, now, out)


def _micros(x: pd.Series) -> np.ndarray:
    return x.astype("datetime64[us]").astype("int64").to_numpy()


def next_cron(expression: str):
    """A column function: the first fire after a timestamp without zone (UTC); null for null or none within five years."""
    cron = Cron.parse(expression)

    @F.pandas_udf("timestamp_ntz")
    def after(at: pd.Series) -> pd.Series:
        out = pd.Series(pd.NaT, index=at.index, dtype="datetime64[us]")
        known = at.notna()
        fire, there = cron.next(_micros(at[known]))
        out[known] = np.where(there, fire.astype("datetime64[us]"), np.datetime64("NaT", "us"))
        return out

    return after


def seed_last_run(expression: str):
    """A column function of (persisted, now): the catch-up cursor of a cron schedule; null if either is null."""
    cron = Cron.parse(expression)

    @F.pandas_udf("timestamp_ntz")
    def cursor(persisted: pd.Series, now: pd.Series) -> pd.Series:
        out = pd.Series(pd.NaT, index=now.index, dtype="datetime64[us]")
        known = persisted.notna() & now.notna()
        out[known] = cron.seed(_micros(persisted[known]), _micros(now[known])).astype("datetime64[us]")
        return out

    return cursor


def custom(after):
    """A column function from a Python function of one datetime to the next fire, or None; null stays null."""

    @F.pandas_udf("timestamp_ntz")
    def each(at: pd.Series) -> pd.Series:
        return pd.Series([None if x is pd.NaT else after(x.to_pydatetime()) for x in at], dtype="datetime64[us]")

    return each


# fixed values: the shapes of expressions that have words, and the words; "clock" is a minute and an hour, in bounds and as numbers
CLOCK = r"0*([0-5]?\d) 0*(1?\d|2[0-3])"
SHAPES = [
    (r"\*/0*(\d+) \* \* \* \*", "every {1 minute}"),
    (r"0+ \*/0*(\d+) \* \* \*", "every {1 hour}"),
    (r"0*(\d+) \*/0*(\d+) \* \* \*", "every {2 hour} at minute {1}"),
    (r"0 \* \* \* \*", "every hour"),
    (CLOCK + r" \* \* \*", "every day at {clock}"),
    (CLOCK + r" \* \* ([0-7])", "every {3 day} at {clock}"),
    (CLOCK + r" 0*(\d+) \* \*", "every month on day {3} at {clock}"),
]
HOURS = [f"{(h + 11) % 12 + 1}{{}} {'AM' if h < 12 else 'PM'}" for h in range(24)]


def prose(expression: Column) -> Column:
    """A cron expression in words; expressions without such words come back trimmed."""
    raw = F.btrim(expression, F.lit(" \t\n\r\f\x0b"))
    spaced = F.regexp_replace(raw, r"\s+", " ")

    def filled(shape: str, slot: str) -> Column:
        """What stands for a slot of a wording."""
        part = lambda k: F.regexp_extract(spaced, f"^{shape}$", int(k))
        if slot == "clock":
            minute, hour = F.lpad(part(1), 2, "0"), part(2).try_cast("int")
            shown = F.replace(F.get(F.array(*map(F.lit, HOURS)), hour), F.lit("{}"), F.when(minute == "00", "").otherwise(F.concat(F.lit(":"), minute)))
            return F.when((hour == 0) & (minute == "00"), "midnight").when((hour == 12) & (minute == "00"), "noon").otherwise(shown)
        k, *unit = slot.split()
        if unit == ["day"]:
            return F.get(F.array(*map(F.lit, DAYS)), part(k).try_cast("int"))
        return F.concat(part(k), F.lit(f" {unit[0]}"), F.when(part(k) == "1", "").otherwise("s")) if unit else part(k)

    words = F.when(raw.isNull(), raw)
    for shape, wording in SHAPES:
        # odd pieces are slots
        pieces = re.split(r"[{}]", wording)
        words = words.when(spaced.rlike(f"^{shape}$"), F.concat(*[filled(shape, x) if k % 2 else F.lit(x) for k, x in enumerate(pieces) if x]))
    return words.otherwise(raw)
