"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of 5-word shingles; two link if the Jaccard similarity is
0.8 or more. The result has one row for each document: its class (the least
doc_id of the connected component), the representative of its exact copies and
its numbers of links.

1. One pass gives each document a 64-bit hash of its words (exact copies share
   it) and HASHES MinHash values of 16 bits. Copies collapse to one node.
2. Bands of BAND values make buckets; of buckets with the same members one
   stays. Pairs of a bucket are compared incrementally: after every STEP values
   a pair is dropped once the posterior P(similarity >= 0.8 | matches), under a
   uniform prior, is below TOLERANCE. Large buckets are dealt out as pairs of
   blocks. A block pair returns a spanning forest of its surviving pairs, whose
   connected components are the candidate clusters. No bucket is cut.
3. In each cluster the pairs are pruned in the same way and the survivors
   verified exactly on whole shingle sets, again by pairs of blocks, which are
   bounded in members and in bytes. A block pair returns link counts and a root
   for each linked member, never its pairs, so large groups stay spread and small.

Banding misses a pair at 0.8 with probability (1 - 0.8^6)^40, about 5e-6.

Null texts and texts without a word link to nothing. Texts of fewer than five
words are one shingle. Rows are told apart by doc_id and text: equal rows count
as one document, rows that share only the id are apart (and of one class if
their least ids are equal). Rows without a doc_id are left out. No rows, no
result.
"""

from __future__ import annotations

import math
import sys
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import Scratch, alnum_words, components, fits, once, table

# workers get this module's functions by value; they needn't have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, THRESHOLD = 5, 0.8
HASHES, BAND, STEP = 240, 6, 24
TOLERANCE = 1e-6
#: Members of a block of a bucket; members of a block of a cluster, and bytes of their shingle sets.
BUCKET_BLOCK, BLOCK, BLOCK_BYTES = 1024, 512, 4 << 20
#: Buckets (16 bytes each) and clustered documents (40 bytes each) are broadcast up to this many, and shuffled beyond.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(11)
_A = (_RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)[:, None]


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least matches that keep a pair) after each step.

    With a uniform prior the posterior of similarity >= t after m matches in n
    values is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        for m in range(n + 1):  # noqa: B007
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append((n, m))
    return out


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of hashed ``words``."""
    w = words.view(np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for d in range(min(SHINGLE, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[d : d + n]
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def minhash(grams: np.ndarray) -> np.ndarray:
    low = grams.astype(np.uint32)[None, :]
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, low.shape[1], 2048):  # bounded memory for long texts
        out = np.minimum(out, (low[:, i : i + 2048] * _A + _B).min(axis=1))
    return out


def _each(batch: pa.RecordBatch):
    """The hashed words of each row of a batch, whose last column they are."""
    lists = batch.column(batch.num_columns - 1)
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for k in range(len(lists)):
        yield np.ascontiguousarray(values[at[k] : at[k + 1]])


def _signed(batches):
    for batch in batches:
        sizes, sigs = [], []
        for words in _each(batch):
            grams = shingles(words) if len(words) else words
            sizes.append(len(grams))
            sigs.append(minhash(grams).astype(np.uint16).tobytes() if len(words) else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "text_hash", "node", "n", "sig"])


def _shingled(batches):
    for batch in batches:
        grams, sigs = [], []
        for words in _each(batch):
            g = shingles(words)
            grams.append(g.tobytes())
            sigs.append(minhash(g).astype(np.uint16).tobytes())
        names = ["id", "cluster", "nb", "size"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sigs, pa.binary()), pa.array(grams, pa.binary())], [*names, "sig", "grams"])


def _words(text) -> Column:
    return F.transform(alnum_words(text), lambda w: F.xxhash64(w))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, n, sig) of rows with a doc_id; node is the hash of the words, n counts shingles; 0 without a word."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), once(_words(F.col("text"))).alias("w"))
    rows = rows.select("doc_id", "text_hash", F.xxhash64("w").alias("node"), "w")
    return rows.mapInArrow(_signed, "doc_id long, text_hash long, node long, n int, sig binary")


def candidate_edges(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): surviving pairs that connect every cluster of candidates; reps: node, sig."""
    width = 2 * BAND
    hashed = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * width + 1, F.lit(width))))
    bands = reps.select("node", F.explode(hashed).alias("bucket"))
    full = bands.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x")).where("m > 1")
    # buckets of equal members have equal pairs; 64 bits and the number tell them
    full = scratch.table(full.groupBy("m", "x").agg(F.min("bucket").alias("bucket")).select("bucket", F.ceil(F.col("m") / BUCKET_BLOCK).cast("int").alias("nb")))
    if fits(full, BROADCAST_ROWS):
        members = reps.select(F.col("node").alias("id"), "sig", F.explode(hashed).alias("bucket")).join(F.broadcast(full), "bucket")
    else:
        members = bands.join(full, "bucket").join(reps.select("node", "sig"), "node").withColumnRenamed("node", "id")
    return _block_pairs(members, "bucket").groupBy("bucket", "i", "j").applyInArrow(_bridges, "a long, b long")


def _block_pairs(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (id, nb, ...) dealt to every pair of the nb blocks of their group that they belong to."""
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("id"), "nb").cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    i, j = F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j")
    rest = [c for c in rows.columns if c != group]
    return dealt.select(group, i, j, *rest, F.col("own").alias("side"), (F.col("own") != F.col("k")).alias("cross"))


def _allowed(table: pa.Table) -> np.ndarray:
    """Pairs that this block pair has to look at: all within a block, or all across two."""
    side = table.column("side").to_numpy()
    if table.column("cross")[0].as_py():
        return side[:, None] != side[None, :]
    return ~np.eye(len(side), dtype=bool)


_BOUNDS = least_matches()


def _signature_rows(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)


def _survivors(sig: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (x, y) of rows of ``sig`` that incremental comparison keeps."""
    out = []
    for lo in range(0, len(x), 16384):  # bounded memory
        a, b = x[lo : lo + 16384], y[lo : lo + 16384]
        matches, seen = np.zeros(len(a), np.int32), 0
        for n, least in _BOUNDS:
            matches += (sig[a, seen:n] == sig[b, seen:n]).sum(axis=1, dtype=np.int32)
            live = matches >= least
            a, b, matches, seen = a[live], b[live], matches[live], n
        out.append((a, b))
    if not out:
        return x, y
    return np.concatenate([p[0] for p in out]), np.concatenate([p[1] for p in out])


def _bridges(table: pa.Table) -> pa.Table:
    """One block pair of a bucket: a spanning forest of the surviving pairs."""
    ids = table.column("id").to_numpy()
    sig, pairs, root = _signature_rows(table), np.triu(_allowed(table), 1), np.arange(len(ids))
    for lo in range(0, len(ids), 128):  # bounded memory: of the survivors so far only the forest is kept
        x, y = np.nonzero(pairs[lo : lo + 128])
        x, y = _survivors(sig, x + lo, y)
        tied = np.flatnonzero(root != np.arange(len(ids)))
        root = _roots(len(ids), np.concatenate([x, tied]), np.concatenate([y, root[tied]]))
    away = root != np.arange(len(ids))
    return pa.table([pa.array(ids[away]), pa.array(ids[root[away]])], ["a", "b"])


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least index of each node's component in the graph of the pairs (x, y)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
        root = root[root]
        if (before == root).all():
            return root


def _intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted distinct arrays x[k] and y[k], by bit rows over the shared values."""
    out = np.zeros(len(x), np.int64)
    if not len(x):
        return out
    used = np.unique(np.concatenate([x, y]))
    owner = np.repeat(used, [len(sets[k]) for k in used])
    _, column, times = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    total, width = int(column[-1]) + 1 if len(column) else 0, 16384
    for lo in range(0, total, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), min(width, -(-(total - lo) // 64) * 64)), bool)
        part[owner[a:b], column[a:b] - lo] = True
        bits = np.packbits(part, axis=1).view(np.uint64)
        for at in range(0, len(x), 4096):  # bounded memory
            s = slice(at, at + 4096)
            out[s] += np.bitwise_count(bits[x[s]] & bits[y[s]]).sum(axis=1, dtype=np.int64)
    return out


def _verified(table: pa.Table) -> pa.Table:
    """One block pair: for each member with links their counts and a root, the least linked member here."""
    _, once = np.unique(table.column("id").to_numpy(), return_index=True)  # repeated rows
    table = table.take(pa.array(once))
    ids, weight = table.column("id").to_numpy(), table.column("size").to_numpy()
    x, y = _survivors(_signature_rows(table), *np.nonzero(np.triu(_allowed(table), 1)))
    sets = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    both = _intersections(sets, x, y)
    up, down = Fraction(str(THRESHOLD)).as_integer_ratio()  # exact at the threshold itself
    link = both * down >= up * (sizes[x] + sizes[y] - both)
    x, y = x[link], y[link]
    n_text = np.bincount(np.concatenate([x, y]), minlength=len(ids))
    n_docs = np.bincount(np.concatenate([x, y]), np.concatenate([weight[y], weight[x]]).astype(float), len(ids)).astype(np.int64)
    root, some = _roots(len(ids), x, y), n_text > 0
    columns = [ids[some], table.column("nb").to_numpy()[some], ids[root[some]], n_text[some], n_docs[some]]
    return pa.table([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], ["id", "nb", "root", "n_text", "n_docs"])


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, class_id, copy_of, n_links, n_text_links, first) of every document with an id.

    class_id and copy_of are the least doc_id of the class and of the exact
    copies. n_links counts linked documents, copies included; n_text_links
    counts linked texts other than the document's own. ``first`` marks the one
    document of its class that comes first by id and hash of the text.
    """
    scratch = Scratch(docs.sparkSession)
    signed = scratch.table(signatures(docs))
    worded = signed.where("n > 0")
    of_node = worded.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))  # n and sig are equal in a node
    reps = scratch.table(of_node.select("node", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash"), "n", "sig"))
    members = worded.select("node", "doc_id", "text_hash").distinct()
    sizes = members.select("node", "doc_id").distinct().groupBy("node").agg(F.count("*").alias("size"))

    edges = scratch.table(candidate_edges(reps.select("node", "sig"), scratch))
    clusters = scratch.table(components(edges, scratch))
    of = clusters.withColumnsRenamed({"id": "node", "root": "cluster"}).join(reps.select("node", F.col("id").alias("doc_id"), "n"), "node")
    of = scratch.table(of.join(sizes, "node"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.col("n").cast("long")) * 8 / BLOCK_BYTES)).cast("int")
    wanted = scratch.table(of.join(of.groupBy("cluster").agg(blocks.alias("nb")), "cluster").select("node", "doc_id", "cluster", "nb", "size"))
    near = F.broadcast(wanted) if fits(wanted, BROADCAST_ROWS) else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(near, "doc_id").select("node", "cluster", "nb", "size", once(_words(F.col("text"))).alias("w"))
    texts = texts.where(F.xxhash64("w") == F.col("node"))  # the id's other texts
    grams = texts.mapInArrow(_shingled, "id long, cluster long, nb int, size long, sig binary, grams binary")
    checked = _block_pairs(grams, "cluster").groupBy("cluster", "i", "j").applyInArrow(_verified, "id long, nb int, root long, n_text long, n_docs long")
    checked = scratch.table(checked)
    scratch.drop(edges, clusters, of)

    # only clusters of several blocks have more than one root for a member
    linked = checked.groupBy("id").agg(F.sum("n_text").alias("n_text"), F.sum("n_docs").alias("n_docs"), F.min("root").alias("root"))
    over = checked.where("nb > 1").select(F.col("id").alias("a"), F.col("root").alias("b"))
    if not over.isEmpty():
        # a member that is a root everywhere is in the forest by its other edges
        roots = components(over, scratch)
        linked = linked.join(roots.withColumnRenamed("root", "far"), "id", "left").withColumn("root", F.coalesce("far", "root")).drop("far")
    linked = linked.withColumnRenamed("id", "node").join(reps.select("node", "id", "hash"), "node")
    heads = linked.groupBy("root").agg(F.min(F.struct("id", "hash", "node")).alias("head"))
    linked = linked.join(heads, "root").select("node", "n_text", "n_docs", "head")

    named = reps.select("node", "id", "hash").join(sizes, "node").join(linked, "node", "left")
    head = F.coalesce("head", F.struct("id", "hash", "node"))
    named = named.select("node", "id", "size", "n_text", "n_docs", head.alias("head"))
    zero = F.lit(0).cast("long")
    rows = members.join(named, "node").select(
        "doc_id", "text_hash", F.col("head.id").alias("class_id"), F.col("id").alias("copy_of"),
        (F.coalesce("n_docs", zero) + F.col("size") - 1).alias("n_links"), F.coalesce("n_text", zero).alias("n_text_links"),
        ((F.col("doc_id") == F.col("head.id")) & (F.col("text_hash") == F.col("head.hash"))).alias("first"),
    )
    blank = signed.where("n = 0").select("doc_id", "text_hash").distinct()
    return rows.unionByName(blank.select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), zero.alias("n_links"), zero.alias("n_text_links"), F.lit(True).alias("first")))


def op9_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash", "first")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the first document stays, once.

    Rows without a doc_id can't be told apart and stay. Columns of any name are
    kept as they are.
    """
    scratch = Scratch(spark)
    drop = scratch.table(jaccard_classes(docs.select("doc_id", "text")).where("not first").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_h"))
    kept = rows.join(F.broadcast(drop) if fits(drop, BROADCAST_ROWS) else drop, ["_d", "_h"], "left_anti")
    again = rows.where("_d is not null").groupBy("_d", "_h").agg(F.count("*").alias("n")).where("n > 1").select("_d", "_h")
    again = scratch.table(again)
    if not again.isEmpty():
        # only the repeated rows are dealt out
        near = F.broadcast(again) if fits(again, BROADCAST_ROWS) else again
        kept = kept.join(near, ["_d", "_h"], "left_anti").unionByName(kept.join(near, ["_d", "_h"], "left_semi").dropDuplicates(["_d", "_h"]))
    return kept.select("_row.*")
