"""Substring deduplication by line hashing.

A unit is a sentence of a line: a line is cut after each ``.``, ``!`` or ``?``,
as passages often stand inside lines, and a line without one is a unit. Units
are normalised (A-Z lowered, words joined by one space), digested to 128 bits
and grouped over the whole corpus. Single units repeat by chance; a passage is a
run of neighbouring repeated units that has MIN_WORDS words or more. Of a
repeated unit the occurrence that comes first by (doc_id, text key, start) is
kept, and every other one inside a passage goes. All occurrences inside passages
are reported with their offsets in the original text (code points, end
exclusive) and the place of the kept one.

A unit takes the characters up to the next unit's first word, so what goes
leaves no empty lines. Digests are counted with map-side aggregation, so a line
that a third of all documents hold is one row a task; only digests that repeat
are joined back. A hot digest (of which there are fewer than HOT) comes by
broadcast, so its units stay where they are. Runs are found by windows over the
repeated units of one text.

Null and empty texts have no units. Rows are told apart by doc_id and text:
equal rows count as one, rows that share only the id are apart. Rows without a
doc_id are left out. No rows, no result.
"""

from __future__ import annotations

import hashlib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import Scratch, let, table

# workers get this module's functions by value; they needn't have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Least words of a passage: of one of over 50 words, so many are left in whole sentences when both ends cut one.
MIN_WORDS = 35
#: Units in an Arrow batch, so a text of many lines needs little more memory than itself.
BATCH = 65_536
#: A digest of more than one unit in HOT is joined by broadcast, not by a shuffle on it.
HOT = 500
#: A sentence with what follows it up to the next word, or a rest without an end; on UTF-8, whose other bytes are all of words.
UNIT = re.compile(rb"[^.!?\n]*[.!?\n][\x00-\x2F\x3A-\x60\x7B-\x7F]*|[^.!?\n]+")
_WORD_BYTES = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))
UNITS = "doc_id long, key long, unit int, start int, stop int, n_words int, digest binary"


def text_key(text: Column) -> Column:
    """60 bits of the text's MD5, to tell rows of one id apart."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _units_of(text: bytes):
    """(unit, start, stop, n_words, digest) of the units of a text with a word."""
    low, at = text.lower(), 0  # of bytes, so only A-Z change
    plain, ascii_only = low.translate(_WORD_BYTES), low.isascii()
    for k, m in enumerate(UNIT.finditer(low)):
        size = m.end() - m.start() if ascii_only else len(m[0].decode())
        words = plain[m.start() : m.end()].split()
        if words:
            yield k, at, at + size, len(words), hashlib.md5(b" ".join(words)).digest()
        at += size


def _units(batches):
    def batch(rows):
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in UNITS.split(", ")])

    for docs in batches:
        rows = []
        for doc, text in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist(), strict=True):
            key = int(hashlib.md5(text).hexdigest()[:15], 16)
            for unit in _units_of(text):
                rows.append((doc, key, *unit))
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, key, unit, start, stop, n_words, digest) of every unit with a word; units of a text count from 0."""
    rows = docs.where("doc_id is not null and text is not null")
    return rows.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_units, UNITS)


def occurrences(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every repeated unit inside a passage, the kept ones too.

    (doc_id, key, unit, start, stop, n_words, kept, kept_doc_id, kept_start,
    passage_start): ``kept`` marks the occurrence that stays, which is at
    (kept_doc_id, kept_start); passage_start is where the unit's run begins.
    """
    scratch = Scratch(docs.sparkSession)
    every = scratch.table(units(docs))
    place = F.struct("doc_id", "key", "start")
    counted = every.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first <> last")
    first = scratch.table(counted.select("digest", "first", "n"))
    # fewer than HOT digests can hold more than that share of the units
    hot = F.col("n") > every.count() / HOT
    found = every.join(F.broadcast(first.where(hot)), "digest")
    rest = every.join(F.broadcast(first.where(hot).select("digest")), "digest", "left_anti")
    found = found.unionByName(rest.join(first.where(~hot), "digest"))
    # one deal by text serves the repeated rows and both windows
    found = found.drop("digest", "n").repartition("doc_id", "key").dropDuplicates(["doc_id", "key", "unit"])
    run = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("unit"))
    whole = Window.partitionBy("doc_id", "key", "_run")
    passages = found.withColumn("_run", run).withColumns({"_words": F.sum("n_words").over(whole), "passage_start": F.min("start").over(whole)})
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("start") == F.col("first.start"))
    return passages.where(F.col("_words") >= min_words).select(
        "doc_id", "key", "unit", "start", "stop", "n_words", kept.alias("kept"), F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), "passage_start",
    )


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the removed units in ``text``; a last column ``removed`` has their (start, stop) in the original, neighbours as one.

    A column of that name in ``docs`` is replaced. Other columns keep their names and values.
    """
    gone = occurrences(docs.select("doc_id", "text"), min_words).where("not kept").select("doc_id", "key", F.struct("start", "stop").alias("s"))
    gone = gone.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("s")).alias("_gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), text_key(F.col("text")).alias("key"))
    rows = rows.join(gone, ["doc_id", "key"], "left")

    def rest(spans: Column) -> Column:
        # the pieces between the spans; each begins where the span before it ends
        starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["stop"]))
        stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length("_row.text")))
        return F.array_join(F.zip_with(starts, stops, lambda a, b: F.substring(F.col("_row.text"), a + 1, b - a)), "")

    def merged(spans: Column) -> Column:
        """Spans that touch as one."""
        heads = F.filter(spans, lambda s, i: (F.get(spans, i - 1)["stop"] != s["start"]) | (i == 0))
        tails = F.filter(spans, lambda s, i: (F.get(spans, i + 1)["start"] != s["stop"]) | (i == F.size(spans) - 1))
        return F.zip_with(heads, tails, lambda a, b: F.struct(a["start"].alias("start"), b["stop"].alias("stop")))

    rows = rows.withColumn("_gone", F.when(F.col("_gone").isNotNull(), let(F.col("_gone"), merged)))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(let(F.col("_gone"), rest))
    return rows.select(
        *[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c != "removed"],
        F.coalesce("_gone", F.array().cast("array<struct<start:int,stop:int>>")).alias("removed"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key", "unit")


ORACLE = r"""
with t as (select doc_id, text, ('0x' || substring(md5(text), 1, 15))::bigint as key from (select distinct doc_id, text from documents where doc_id is not null and text is not null)),
p as (
  select doc_id, key, unnest(range(1, len(p) + 1)) as unit, unnest(p) as p
  from (select doc_id, key, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^.!?\n]*[.!?\n][\x00-\x2F\x3A-\x60\x7B-\x7F]*|[^.!?\n]+') as p from t)),
o as (select *, cast(sum(length(p)) over (partition by doc_id, key order by unit) as integer) as stop from p),
u as (
  select doc_id, key, unit, cast(stop - length(p) as integer) as start, stop,
    list_filter(regexp_split_to_array(p, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from o),
k as (select doc_id, key, unit, start, stop, cast(len(w) as integer) as n_words, array_to_string(w, ' ') as s from u where len(w) > 0),
f as (
  select *, first_value(doc_id) over e as kept_doc_id, first_value(key) over e as kept_key, first_value(start) over e as kept_start, count(*) over (partition by s) as n
  from k window e as (partition by s order by doc_id, key, start)),
r as (select *, unit - row_number() over (partition by doc_id, key order by unit) as run from f where n > 1),
g as (select *, sum(n_words) over (partition by doc_id, key, run) as words, min(start) over (partition by doc_id, key, run) as passage_start from r)
select doc_id, start, stop, n_words, doc_id = kept_doc_id and key = kept_key and start = kept_start as kept, kept_doc_id, kept_start, passage_start
from g where words >= 35
"""
