"""Language identification by hierarchical discrimination.

First a linear one-versus-rest machine on hashed character n-grams picks the
language family; then one-versus-one linear support vector machines separate
the languages inside that family by votes. The margins give the score.

Learned from texts with a known language: SAMPLE rows for each language at
most, chosen by a seeded hash of the id (a bounded sample; the bound is the
parameter). Executors turn texts into vectors, so the driver gets
SAMPLE * languages vectors of DIM floats, never texts. Prediction reads every
whole text in pieces of PIECE code points.

A text that is null or has no letter is ``und`` with score 0. Without training
rows all are. A language outside FAMILIES is a family of its own. Repeated rows
are judged row by row; extra columns aren't read.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import table

# workers get this module's functions by value; they needn't have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE, DIM, PIECE = 600, 2048, 1 << 20
EPOCHS, LAMBDA, SEED = 12, 1e-4, 7

# fixed values: families of close languages
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}


def vector(text: str | None) -> np.ndarray | None:
    """Square-rooted, unit-length counts of hashed 1- to 3-grams of the lower-cased letters; None without a letter."""
    counts = np.zeros(DIM)
    some = False
    for at in range(0, len(text or ""), PIECE):
        piece = text[at : at + PIECE].lower()
        letters = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        if letters.max(initial=0) < 128:
            is_letter = (letters >= 97) & (letters <= 122)
        else:
            values, inverse = np.unique(letters, return_inverse=True)
            is_letter = np.array([chr(v).isalpha() for v in values])[inverse]
        some = some or bool(is_letter.any())
        c = np.where(is_letter, letters, 32)
        # runs of anything else count as one space
        c = c[is_letter | np.concatenate(([True], is_letter[:-1]))].astype(np.uint32)
        for n in (1, 2, 3):
            if len(c) < n:
                break
            h = np.zeros(len(c) - n + 1, np.uint32)
            for d in range(n):
                h = (h ^ c[d : len(c) - n + 1 + d]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            counts += np.bincount((h * np.uint32(0x85EBCA6B) + np.uint32(n)) % np.uint32(DIM), minlength=DIM)
    if not some:
        return None
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def _vectors(batches):
    for batch in batches:
        got = [(lang, vector(text)) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        got = [(lang, v.astype(np.float32).tobytes()) for lang, v in got if v is not None]
        yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], ["lang", "v"])


def svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear machine (hinge loss, last weight the bias) by averaged subgradient steps; y is -1 or 1."""
    rng = np.random.default_rng(SEED)
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w, mean, t, kept = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    for epoch in range(EPOCHS):
        for k in np.array_split(rng.permutation(len(y)), max(1, len(y) // 16)):
            t += 1
            bad = k[y[k] * (x[k] @ w) < 1]
            w *= 1 - 1 / (t + 100)
            w += ((share[bad] * y[bad]) @ x[bad]) / (len(k) * LAMBDA * (t + 100))
            if epoch >= EPOCHS // 2:
                mean, kept = mean + w, kept + 1
    return mean / max(kept, 1)


def _scaled(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``w`` scaled so that its margins have a standard deviation of 1.5 within the classes."""
    m = x @ w[:-1] + w[-1]
    spread = np.sqrt(np.mean([m[y == s].var() for s in (-1, 1) if (y == s).any()]) + 1e-9)
    return w * (1.5 / spread)


def train(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """labelled: (doc_id, text, lang), lang not null."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return {"families": {}, "first": {}, "pairs": {}}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")), F.lit(1_000_000)) < share * 1_000_000)
    rows = drawn.select("lang", "text").mapInArrow(_vectors, "lang string, v binary").collect()
    lang = np.array([r["lang"] for r in rows])
    x = np.array([np.frombuffer(r["v"], np.float32) for r in rows], dtype=float).reshape(len(rows), DIM)
    order = np.lexsort((x[:, 0], lang)) if len(rows) else np.arange(0)
    lang, x = lang[order], x[order]
    family = np.array([FAMILIES.get(v, v) for v in lang])
    groups = {f: sorted(set(lang[family == f])) for f in sorted(set(family))}
    first, pairs = {}, {}
    for f in groups:
        y = np.where(family == f, 1, -1)
        first[f] = _scaled(svm(x, y), x, y) if len(groups) > 1 else None
    for langs in groups.values():
        for i, a in enumerate(langs):
            for b in langs[i + 1 :]:
                at = (lang == a) | (lang == b)
                y = np.where(lang[at] == a, 1, -1)
                pairs[a, b] = _scaled(svm(x[at], y), x[at], y)
    return {"families": groups, "first": first, "pairs": pairs}


def _sure(m: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(m, -30, 30))))


def predict(model: dict, text: str | None) -> tuple[str, float]:
    v = vector(text)
    groups = model["families"]
    if v is None or not groups:
        return "und", 0.0
    p = {f: 1.0 if w is None else _sure(v @ w[:-1] + w[-1]) for f, w in model["first"].items()}
    family = max(sorted(p), key=p.get)
    total = sum(p.values()) or 1.0
    langs = groups[family]
    votes, sure = dict.fromkeys(langs, 0), dict.fromkeys(langs, 1.0)
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            w = model["pairs"][a, b]
            q = _sure(v @ w[:-1] + w[-1])
            votes[a if q >= 0.5 else b] += 1
            sure[a], sure[b] = min(sure[a], q), min(sure[b], 1 - q)
    best = max(langs, key=lambda k: (votes[k], sure[k]))
    return best, float(min(1.0, max(0.0, p[family] / total * sure[best])))


def predicted(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            got = [predict(model, text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5) == 0
    model = train(docs.where(~held & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
