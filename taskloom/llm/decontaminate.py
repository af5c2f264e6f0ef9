"""Benchmark decontamination by winnowing.

A text's fingerprints are the least K-word-gram hash of every run of W
neighbouring grams. Any shared span of K + W - 1 words or more has such a run
in both texts, so it shares a fingerprint. With K = 5 and W = 6 that holds for
every 10-word window. Fingerprints of documents and items are joined; every hit
gives an alignment (item, offset), which is extended word by word over the
whole item, and only runs as long as a window count.

Of equal least hashes in a run a document takes the one whose position modulo 8
is least, so periodic text has three fingerprints in eight words, not one a word. An
item takes all of them, so that the true alignment is always among the found.
Items of fewer than 10 words are one window: for each such length m (nine at
most) the fingerprints are all m-word grams.

Native. The documents are read once for the words' number and the fingerprints
of all lengths, and the texts with a hit once more; no text is shuffled while
the benchmark's fingerprints and the hits fit their bounds for a broadcast.
Words are compared by 64-bit hashes, grams by 61 bits and then word by word. A
null text has no words. Repeated rows get equal results, each its row; rows
that share a doc_id but not the text are apart. Empty tables give no hits. Items
without an id or a text are left out; items that repeat an id are apart, and
count as one. Long texts are walked in time linear in their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import Scratch, alnum_words, fits, let, once, table

WINDOW, K = 10, 5
#: The benchmark side is broadcast up to this many fingerprints (24 bytes each, its words about as much), and shuffled beyond.
BROADCAST_ROWS = 200_000
#: So are the alignments found (32 bytes each).
BROADCAST_HITS = 500_000
MARKS = "array<struct<n:int,pos:int,fp:bigint>>"


def _hashed(text: Column) -> Column:
    return F.transform(alnum_words(text), lambda w: F.xxhash64(w))


def _grams(h: Column, k: int) -> Column:
    """61-bit hashes of the k-word grams, with the position modulo 8 in the last three bits."""
    gram = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + d) for d in range(1, k)]).bitwiseAND(-8).bitwiseOR(i.bitwiseAND(7).cast("long")))
    return F.slice(gram, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))


def _mark(n: int, pos: Column, fp: Column) -> Column:
    return F.struct(F.lit(n).alias("n"), pos.cast("int").alias("pos"), fp.alias("fp"))


def _whole(g: Column, n: int) -> Column:
    """Every gram of n words."""
    return F.transform(g, lambda x, i: _mark(n, i, x.bitwiseAND(-8)))


def _runs(g: Column, w: int) -> Column:
    """The least gram of each run of w."""
    least = F.transform(g, lambda x, i: F.least(x, *[F.get(g, i + d) for d in range(1, w)]))
    return F.slice(least, 1, F.greatest(F.size(g) - (w - 1), F.lit(0)))


def _winnowed(g: Column, w: int) -> Column:
    """The grams that runs of w choose, once for neighbouring runs of one choice."""

    def chosen(c: Column) -> Column:
        pos = lambda x, i: i + F.pmod(x.bitwiseAND(7).cast("int") - i, F.lit(8))
        one = lambda x, i: F.when((i == 0) | (x != F.get(c, i - 1)), _mark(WINDOW, pos(x, i), x.bitwiseAND(-8)))
        return F.array_compact(F.transform(c, one))

    return let(_runs(g, w), chosen)


def _winnowed_with_ties(g: Column, w: int) -> Column:
    """Every gram whose hash is the least of some run of w."""
    runs = F.transform(g, lambda x, i: F.array_min(F.transform(F.slice(g, i + 1, w), lambda y: y.bitwiseAND(-8))))
    runs = F.slice(runs, 1, F.greatest(F.size(g) - (w - 1), F.lit(0)))

    def kept(r: Column) -> Column:
        near = lambda x, i: F.exists(F.slice(r, F.greatest(i - w + 2, F.lit(1)), F.least(i + 1, F.lit(w))), lambda m: m == x.bitwiseAND(-8))
        return F.array_compact(F.transform(g, lambda x, i: F.when(near(x, i), _mark(WINDOW, i, x.bitwiseAND(-8)))))

    return let(runs, kept)


def _marks(h: Column, short: list[int], long: bool, ties: bool = False) -> Column:
    """The fingerprints of hashed words: those of windows if ``long``, and all grams of the ``short`` lengths."""
    out = [F.array().cast(MARKS)]
    if long:
        out.append(let(_grams(h, K), lambda g: (_winnowed_with_ties if ties else _winnowed)(g, WINDOW - K + 1)))
    return F.concat(*out, *[_whole(_grams(h, n), n) for n in short])


def _id(doc_id: Column) -> Column:
    """Null ids as 0: rows of one id and text hash have one result, whichever id it was."""
    return F.coalesce(doc_id.cast("long"), F.lit(0))


class Hits:
    """What ``docs`` (doc_id, text) share with ``items`` (item_id, text).

    ``rows``: (doc_id, _d, _th, n_words) of each row of docs; _th is the 64-bit
    hash of the text, _d the id or 0. ``found``: (_d, _th, item_id, positions)
    of documents' words inside an item's windows, sorted 0-based word positions.
    """

    def __init__(self, docs: DataFrame, items: DataFrame) -> None:
        scratch = Scratch(docs.sparkSession)
        sized = items.where("text is not null and item_id is not null").select("item_id", _hashed(F.col("text")).alias("_iw")).distinct()
        sized = sized.withColumn("_n", F.size("_iw")).where("_n > 0").withColumn("_item", F.xxhash64("item_id", "_iw"))
        sized = scratch.table(sized)
        lengths = {r[0] for r in sized.select(F.least("_n", F.lit(WINDOW))).distinct().collect()}  # ten at most
        short, long = sorted(lengths - {WINDOW}), WINDOW in lengths
        own = F.when(F.col("_n") >= WINDOW, _marks(F.col("_iw"), [], long, ties=True))
        for n in short:
            own = own.when(F.col("_n") == n, _marks(F.col("_iw"), [n], False))
        marks = scratch.table(sized.select("_item", F.explode(own).alias("_m")).select("_item", "_m.n", F.col("_m.pos").alias("_ipos"), "_m.fp").distinct())
        small = fits(marks, BROADCAST_ROWS)

        keyed = docs.select("doc_id", _id(F.col("doc_id")).alias("_d"), F.xxhash64("text").alias("_th"), once(_hashed(F.col("text"))).alias("_h"))
        head = F.array(F.struct(F.lit(0).alias("n"), F.size("_h").alias("pos"), F.lit(None).cast("long").alias("fp")))
        # the first mark of a row is its number of words
        every = keyed.select("doc_id", "_d", "_th", F.explode(F.concat(head, _marks(F.col("_h"), short, long))).alias("_m")).select("doc_id", "_d", "_th", "_m.*")
        if small:
            # a fingerprint that many documents share meets at most the items that share it
            met = every.join(F.broadcast(marks), ["n", "fp"], "left").where("n = 0 or _item is not null")
        else:
            met = every.where("n > 0").join(marks, ["n", "fp"]).unionByName(every.where("n = 0").withColumns({"_item": F.lit(None).cast("long"), "_ipos": F.lit(None).cast("int")}))
        met = scratch.table(met.select("doc_id", "_d", "_th", "n", "pos", "_item", (F.col("pos") - F.col("_ipos")).alias("_at")))
        self.rows = met.where("n = 0").select("doc_id", "_d", "_th", F.col("pos").cast("long").alias("n_words"))
        aligned = scratch.table(met.where("n > 0").select("_d", "_th", "_item", "_at").distinct())

        # extension: the texts with a hit, against the item at each alignment
        texts = docs.select(_id(F.col("doc_id")).alias("_d"), F.xxhash64("text").alias("_th"), "text")
        ids = aligned.select("_d", "_th").distinct()
        few = small and fits(aligned, BROADCAST_HITS)
        # words once a text, before its alignments
        words = texts.join(F.broadcast(ids) if few else ids, ["_d", "_th"], "left_semi").select("_d", "_th", once(_hashed(F.col("text"))).alias("_dw"))
        if few:
            both = words.join(F.broadcast(aligned), ["_d", "_th"]).join(F.broadcast(sized), "_item")
        else:
            both = aligned.join(words.dropDuplicates(["_d", "_th"]), ["_d", "_th"]).join(sized, "_item")
        # from here an alignment carries the words under the item only
        low = F.greatest(F.col("_at"), F.lit(0))
        under = F.slice("_dw", low + 1, F.greatest(F.col("_at") + F.col("_n") - low, F.lit(0)))
        both = both.select("_d", "_th", "item_id", "_iw", "_n", "_at", low.alias("_low"), once(under).alias("_dw"))
        at = F.col("_at") - F.col("_low")
        same = F.transform("_iw", lambda x, j: (F.get("_dw", at + j) == x).eqNullSafe(True) & (at + j >= 0))
        span = F.least(F.col("_n"), F.lit(WINDOW))

        def inside(m: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.col("_n") - span), lambda s: F.forall(F.slice(m, s + 1, span), lambda x: x))
            return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s + F.col("_at"), s + F.col("_at") + span - 1))))

        runs = both.select("_d", "_th", "item_id", once(let(same, inside)).alias("_p")).where(F.size("_p") > 0)
        self.found = scratch.table(
            runs.select("_d", "_th", "item_id", F.explode("_p").alias("_x")).groupBy("_d", "_th", "item_id").agg(F.sort_array(F.collect_set("_x")).alias("positions"))
        )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as doc_id, n_words, n_hit and the items' ids, sorted as strings."""
    hits = Hits(docs, items)
    per_doc = hits.found.groupBy("_d", "_th").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).cast("long").alias("n_hit"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )
    per_doc = F.broadcast(per_doc) if fits(hits.found, BROADCAST_ROWS) else per_doc
    return hits.rows.join(per_doc, ["_d", "_th"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a word inside an item's window go. Columns of any name are kept as they are."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    bad = Scratch(spark).table(Hits(docs.select("doc_id", "text"), items).found.select("_d", "_th").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _id(F.col("doc_id")).alias("_d"), F.xxhash64("text").alias("_th"))
    return rows.join(F.broadcast(bad) if fits(bad, BROADCAST_HITS) else bad, ["_d", "_th"], "left_anti").select("_row.*")


ORACLE = r"""
with d as (
  select doc_id, row_number() over () as rid,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as k
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
dw as (
  select rid, n, i, array_to_string(w[i:i + n - 1], ' ') as k
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
h as (select rid, item_id, dw.n, i from dw join bw on dw.k = bw.k and dw.n = bw.n),
p as (select rid, count(distinct i + j) as n_hit from (select rid, i, unnest(range(0, n)) as j from h) group by rid),
q as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from h group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p using (rid) left join q using (rid)
"""
