"""Spans of pattern matches as native expressions.

A span is struct<kind: string, start: int, stop: int, s: string>, in code
points, stop exclusive. Spark gives matches without positions; the pieces
between matches, from split() with the same pattern, give them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taskloom.llm.common import let

BLOCK = 256
SPAN = "array<struct<kind:string,start:int,stop:int,s:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def blocks(values: Column) -> Column:
    """``values`` in pieces of BLOCK; a fold that appends in each piece, and once a piece, is next to linear."""
    last = F.ceil(F.size(values) / BLOCK).cast("int")
    return F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda k: F.slice(values, k * BLOCK + 1, BLOCK))).otherwise(F.array(values))


def find(text: Column, pattern: str, kind: str, when: Column) -> Column:
    """Leftmost non-overlapping matches of ``pattern``; rows where ``when`` fails have none.

    ``when`` is a cheap test that holds wherever the pattern can match.
    """

    def placed(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            stop = start + F.length(x["hit"])
            one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop"), x["hit"].alias("s"))
            return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        def walk(acc: Column, block: Column) -> Column:
            done = F.aggregate(block, F.struct(acc["at"].alias("at"), none().alias("out")), step)
            return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        pairs = F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda a, b: F.struct(a.alias("hit"), b.alias("gap")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(let(pairs, blocks), zero, walk, lambda acc: F.flatten(acc["out"]))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.transform(F.array(hits), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none()))[0]
    return F.when(when, body).otherwise(none())


def ordered(spans: Column, kinds: list[str]) -> Column:
    """Sorted by start, then kind in the order of ``kinds``, then stop."""
    def key(x: Column) -> Column:
        rank = F.lit(len(kinds))
        for i, k in reversed(list(enumerate(kinds))):
            rank = F.when(x["kind"] == k, F.lit(i)).otherwise(rank)
        return F.struct(x["start"].alias("start"), rank.alias("rank"), x["stop"].alias("stop"), x["kind"].alias("kind"), x["s"].alias("s"))

    return F.transform(
        F.sort_array(F.transform(spans, key)),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["s"].alias("s")),
    )


def joined(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def chosen(proposals: Column, base: Column) -> Column:
    """Of scored ``proposals`` (array<struct<p, x: span>>) those that overlap no span of ``base`` and no better one.

    One sweep by start: of two that overlap the one with the greater p stays,
    the first on a tie; base spans win over all. Linear in the spans.
    """
    one = lambda p, x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), p.cast("double").alias("p"), x.alias("x"))
    every = F.concat(F.transform(proposals, lambda e: one(e["p"], e["x"])), F.transform(base, lambda x: one(F.lit(2.0), x)))
    item = "struct<start:int,stop:int,p:double,x:struct<kind:string,start:int,stop:int,s:string>>"

    def kept(acc: Column) -> Column:
        last = acc["last"]
        return F.when(last.isNotNull() & (last["p"] < 2), F.concat(acc["out"], F.array(last["x"]))).otherwise(acc["out"])

    def step(acc: Column, e: Column) -> Column:
        last = acc["last"]
        over = F.coalesce(e["start"] < last["stop"], F.lit(False))
        better = F.when((e["p"] >= 2) & (last["p"] >= 2), e["stop"] > last["stop"]).otherwise(e["p"] > last["p"])
        return F.struct(F.when(over & ~better, last).otherwise(e).alias("last"), F.when(over, acc["out"]).otherwise(kept(acc)).alias("out"))

    def walk(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["last"].alias("last"), none().alias("out")), step)
        return let(done, lambda d: F.struct(d["last"].alias("last"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    zero = F.struct(F.lit(None).cast(item).alias("last"), F.array().cast(f"array<{SPAN}>").alias("out"))
    swept = F.aggregate(let(F.sort_array(every), blocks), zero, walk, lambda acc: kept(F.struct(acc["last"].alias("last"), F.flatten(acc["out"]).alias("out"))))
    return F.when(F.size(proposals) > 0, swept).otherwise(none())


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with the union of ``spans`` (sorted by start) replaced by [KIND]."""

    def step(acc: Column, x: Column) -> Column:
        head = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        mark = F.when(x["start"] >= acc["at"], F.concat(head, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
