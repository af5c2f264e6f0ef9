"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded digest, ranked within their source, ordered over
all sources by fractional rank (rank - 1/2) / source size, and cut into equal
runs, so each shard holds the same share of every source. Law: ``rows``.

Native. No window runs over a whole source or over all rows: both ranks are
taken inside small digest or fraction buckets and added to bucket offsets, so
a source with a third of all rows is spread like the others. The offset tables
have one row per bucket; they are joined, and broadcast only if Spark's own
size threshold allows. Texts are read once, for size and checksum, and aren't
shuffled, however long.

A null text has size 1 and the checksum of the empty text; a null source is a
source of its own. Repeated rows each get a slot. No rows, no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taskloom.llm.common import table

SEED = "interleave-1"
SHARDS = 8
ROWS_PER_BUCKET = 1024


def _order_buckets(total: int) -> int:
    """Hex digits of the digest that make buckets of about ROWS_PER_BUCKET rows."""
    digits = 1
    while 16**digits * ROWS_PER_BUCKET < total and digits < 8:
        digits += 1
    return digits


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32) of ``docs`` with shard, slot and position."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source"), F.lit("\u0000")).alias("_s"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_d"),
    )
    total = docs.count()
    digits, cuts = _order_buckets(total), max(1, total // ROWS_PER_BUCKET)
    rows = rows.withColumn("_b", F.substring("_d", 1, digits))

    # rank in the source: rows of earlier buckets, then the place in the bucket
    per = rows.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    whole = per.groupBy("_s").agg(F.sum("_n").alias("_ns"))
    # in two levels, by the leading half of the bucket's digits, so a hot source's buckets aren't one window
    per = per.withColumn("_g", F.substring("_b", 1, (digits + 1) // 2))
    outer = per.groupBy("_s", "_g").agg(F.sum("_n").alias("_gn"))
    outer = outer.select("_s", "_g", _before("_gn", ["_s"], "_g").alias("_go"))
    per = per.withColumn("_io", _before("_n", ["_s", "_g"], "_b")).join(outer, ["_s", "_g"]).join(whole, "_s")
    per = per.select("_s", "_b", "_ns", (F.col("_go") + F.col("_io")).alias("_off"))
    inside = Window.partitionBy("_s", "_b").orderBy("_d", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("_rn", F.row_number().over(inside)).join(per, ["_s", "_b"])
    ranked = ranked.withColumn("_f", (2 * (F.col("_off") + F.col("_rn")) - 1) / (2 * F.col("_ns")))

    # the same again over all rows, by fraction
    ranked = ranked.withColumn("_c", F.least(F.floor(F.col("_f") * cuts), F.lit(cuts - 1)))
    sizes = ranked.groupBy("_c").agg(F.count("*").alias("_m"))
    at = _prefix_sums(sizes, cuts)
    place = Window.partitionBy("_c").orderBy("_f", "_d", "_s", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("_p", F.row_number().over(place)).join(at, "_c")
    n = F.lit(total)
    position = F.col("_base") + F.col("_p") - 1
    # shard k starts at ceil(k * n / shards)
    shard = F.floor(position * shards / n).cast("int")
    start = F.ceil(F.col("shard") * n / shards)
    return (
        placed.withColumn("position", position)
        .withColumn("shard", shard)
        .withColumn("slot", (F.col("position") - start).cast("long"))
        .select("doc_id", F.nullif(F.col("_s"), F.lit("\u0000")).alias("source"), "size", "text_crc32", "shard", "slot", "position")
    )


def _before(n: str, keys: list[str], by: str) -> Column:
    """The sum of ``n`` over the rows before each one, within ``keys`` in the order of ``by``."""
    return F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _prefix_sums(sizes: DataFrame, cuts: int) -> DataFrame:
    """Exclusive prefix sums over buckets in two levels, no window wider than sqrt(cuts) * 2."""
    width = max(1, int(cuts**0.5))
    sizes = sizes.withColumn("_g", F.floor(F.col("_c") / width))
    outer = sizes.groupBy("_g").agg(F.sum("_m").alias("_gm"))
    outer = outer.withColumn("_go", _before("_gm", [], "_g"))
    return (
        sizes.withColumn("_io", _before("_m", ["_g"], "_c"))
        .join(outer, "_g")
        .select("_c", (F.col("_go") + F.col("_io")).alias("_base"))
    )


def op3_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interleave(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: (doc_id, source, size, text_crc32, shard, slot)."""
    return interleave(docs).drop("position")
