"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE code points; every passage of the
whole text is encoded. Only documents have labels. A tanh layer embeds each
passage, gated attention (tanh times sigmoid) weighs the embeddings, and a
logistic unit scores the weighted sum. All weights are learned together.

Learned from SAMPLE labelled rows for each class at most, chosen by a seeded
hash of the id (a bounded sample; the bound is the parameter). Executors turn
texts into passage features, all of them for a training bag too; the driver
gets those (260 bytes a passage), never texts.

A null or blank text has score 0. Without labelled rows of both classes every
other text has the share of label 1 (0.5 without any). Repeated rows are scored
row by row.
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

PASSAGE, PIECE = 400, 1 << 20
SAMPLE = 2000
HASHED, HIDDEN, GATE = 48, 24, 12
EPOCHS, BATCH, STEP, DECAY, SEED = 40, 64, 4e-3, 1e-4, 3
CUT = 0.7

_SYMBOLS = "#*$%&|<>!?@=_~^{}[]\\/+"
_CLASSES = 12


def _class_table() -> np.ndarray:
    t = np.zeros(0x250, np.int64)
    for v in range(0x250):
        c = chr(v)
        t[v] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == " " else 5 if c == "\n" else 6 if c in ".,;:" else 7
        if c in _SYMBOLS:
            t[v] = 8 if c == "|" else 9 if c in "!?" else 10
    return t


_TABLE = _class_table()


def encode(text: str | None) -> np.ndarray:
    """Features of every passage of ``text``, one row each; no rows for a blank text."""
    if not text or text.isspace():
        return np.zeros((0, _CLASSES + 5 + HASHED), np.float32)
    out = []
    for at in range(0, len(text), PIECE):  # bounded memory for very long texts
        out.append(_encode(np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)))
    return np.concatenate(out)


def _encode(c: np.ndarray) -> np.ndarray:
    n = -(-len(c) // PASSAGE)
    if n > 1 and len(c) - (n - 1) * PASSAGE < PASSAGE // 2:
        n -= 1  # a short tail joins the passage before
    owner = np.minimum(np.arange(len(c)) // PASSAGE, n - 1)
    size = np.bincount(owner, minlength=n).astype(float)
    kind = np.where(c < 0x250, _TABLE[np.minimum(c, 0x24F)], 11)
    share = np.bincount(owner * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) / size[:, None]

    space = (kind == 4) | (kind == 5)
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    words = np.bincount(owner[starts], minlength=n)
    upper = np.bincount(owner[starts], weights=kind[starts] == 2, minlength=n)
    mean = (size - np.bincount(owner, weights=space, minlength=n)) / np.maximum(words, 1)
    # words and lines seen before in the text, by a rolling hash of what follows each word start
    h = np.zeros(len(c), np.uint64)
    for d in range(min(24, len(c))):
        h[: len(c) - d] = (h[: len(c) - d] + c[d:]) * np.uint64(0x9E3779B97F4A7C15)
        if d == 5:
            short = h.copy()
    if len(c) < 6:
        short = h
    _, first, back = np.unique(h[starts], return_index=True, return_inverse=True)
    seen = first[back] < np.arange(len(starts))
    repeat = np.bincount(owner[starts], weights=seen, minlength=n) / np.maximum(words, 1)
    distinct = np.unique(owner[starts].astype(np.uint64) << np.uint64(48) | (short[starts] >> np.uint64(16)))
    variety = np.bincount((distinct >> np.uint64(48)).astype(np.int64), minlength=n) / np.maximum(words, 1)

    low = np.where((c >= 65) & (c <= 90), c + 32, c)
    pair = ((low[:-1] * np.uint32(0x9E3779B1) ^ low[1:]) * np.uint32(0x85EBCA6B)) >> np.uint32(20)
    hashed = np.bincount(owner[:-1] * HASHED + pair % np.uint32(HASHED), minlength=n * HASHED).reshape(n, HASHED) / size[:, None]
    other = np.stack([np.minimum(mean / 10, 3), upper / np.maximum(words, 1), repeat, variety, np.minimum(size / PASSAGE, 2)], axis=1)
    return np.hstack([share * 4, other, hashed * 4]).astype(np.float32)


def _bags(batches):
    for batch in batches:
        ys, xs = [], []
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = encode(text)
            if len(x):
                ys.append(y)
                xs.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(xs, pa.binary())], ["y", "x"])


def _forward(p: dict, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
    h = np.tanh(x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * s) @ p["a"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, bag, e)
    e = np.exp(e - top[bag])
    weight = e / np.bincount(bag, e, n)[bag]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, bag, weight[:, None] * h)
    return {"h": h, "t": t, "s": s, "weight": weight, "z": z, "logit": z @ p["c"] + p["d"][0]}


def _gradient(p: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray, f: dict) -> dict:
    g = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
    dz = g[:, None] * p["c"]
    out = {"c": f["z"].T @ g, "d": np.array([g.sum()])}
    dh = f["weight"][:, None] * dz[bag]
    dw = (dz[bag] * f["h"]).sum(axis=1)
    de = f["weight"] * (dw - np.bincount(bag, f["weight"] * dw, len(y))[bag])
    out["a"] = (f["t"] * f["s"]).T @ de
    dt = de[:, None] * p["a"] * f["s"] * (1 - f["t"] ** 2)
    ds = de[:, None] * p["a"] * f["t"] * f["s"] * (1 - f["s"])
    out["v"], out["u"] = f["h"].T @ dt, f["h"].T @ ds
    dh = (dh + dt @ p["v"].T + ds @ p["u"].T) * (1 - f["h"] ** 2)
    out["w"], out["b"] = x.T @ dh, dh.sum(axis=0)
    return out


def fit(bags: list[np.ndarray], y: np.ndarray, share: float) -> dict:
    """Weights from bags with balanced classes; the bias is then moved to ``share`` of label 1."""
    rng = np.random.default_rng(SEED)
    all_x = np.concatenate(bags)
    mean, spread = all_x.mean(axis=0), all_x.std(axis=0) + 1e-3
    size = all_x.shape[1]
    p = {
        "w": rng.normal(0, size**-0.5, (size, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
    }
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    one, zero = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    for _ in range(EPOCHS):
        for _ in range(max(1, len(y) // BATCH)):
            pick = np.concatenate([rng.choice(one, BATCH // 2), rng.choice(zero, BATCH // 2)])
            bag = np.repeat(np.arange(len(pick)), [len(bags[k]) for k in pick])
            x = np.clip((np.concatenate([bags[k] for k in pick]) - mean) / spread, -8, 8)
            g = _gradient(p, x, bag, y[pick], _forward(p, x, bag, len(pick)))
            t += 1
            for k in p:
                d = g[k] + DECAY * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - STEP * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    p["d"] = p["d"] + np.log(share / (1 - share))
    return p | {"mean": mean, "spread": spread}


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """docs: (doc_id, text); labels: (doc_id, quality). Only the texts of drawn labels are read out."""
    labels = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return {"share": counts.get(1, 0) / total if total else 0.5}
    share = F.when(F.col("quality") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
    drawn = labels.where(F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")), F.lit(1_000_000)) < share * 1_000_000)
    # 2 * sample rows are expected and 4 * sample the bound, so the labels can be broadcast
    drawn = F.broadcast(drawn.limit(4 * sample))
    rows = docs.join(drawn, "doc_id").select("quality", "text").mapInArrow(_bags, "y int, x binary").collect()
    rows = sorted((r["y"], bytes(r["x"])) for r in rows)
    y = np.array([r[0] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        return {"share": counts[1] / total}
    width = _CLASSES + 5 + HASHED
    bags = [np.frombuffer(r[1], np.float32).reshape(-1, width).astype(float) for r in rows]
    return fit(bags, y, min(max(counts[1] / total, 0.01), 0.99))


def score(model: dict, texts: list) -> np.ndarray:
    bags = [encode(t) for t in texts]
    out = np.zeros(len(texts))
    some = [k for k, b in enumerate(bags) if len(b)]
    if "share" in model:
        out[some] = model["share"]
        return out
    if some:
        bag = np.repeat(np.arange(len(some)), [len(bags[k]) for k in some])
        x = np.clip((np.concatenate([bags[k] for k in some]) - model["mean"]) / model["spread"], -8, 8)
        out[some] = 1 / (1 + np.exp(-np.clip(_forward(model, x, bag, len(some))["logit"], -30, 30)))
    return out


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            texts, got = batch.column(1), []
            for at in range(0, len(texts), 64):  # bounded memory
                got.append(score(model, texts.slice(at, 64).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else [], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op10_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    model = train(docs, labels.where(~held))
    return scored(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
