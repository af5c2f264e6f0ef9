"""Personal data by candidate gradient boosting.

Four fixed patterns give the base spans. High-recall generators propose more,
possibly overlapping, spans: spelled-out or bracketed mail addresses, phone
numbers without a plus sign, card numbers with other separators, defanged
addresses. Boosted regression trees score every proposal by its format (digits,
groups, separators, Luhn sum, octets) and context (words before it, characters
beside it). Scores are calibrated with a logistic fit on held-out rows, and
each kind has the least threshold that reaches PRECISION there. Of overlapping
proposals the best stays. Base spans always stay.

The trees are trained on the driver on generated rows (TRAIN_ROWS, seeded) and
half as many hits of the generators in seeded sentences, as look-alikes: a
bounded set that doesn't depend on the corpus. They are compiled into one CASE
expression, so scoring is native: one projection, no shuffle, no Python.

A null text counts as empty. Repeated rows are judged row by row. On a tie the
proposal that starts first stays. Time is linear in a text, however many its
matches. No rows, no result. Columns of any name are kept, but for the two made.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import spans as sp
from taskloom.llm.common import let, table

KINDS = ["email", "ip", "card", "phone"]
TRAIN_ROWS, TREES, DEPTH, RATE, SEED = 6000, 24, 3, 0.4, 20
PRECISION = 0.99

# fixed patterns; \G or the look-behind only skips starts that can't match
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: kind, pattern, cheap test: the generators beside the base patterns.
GENERATORS: list[tuple[str, str, str]] = [
    (
        "email",
        r"[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
        r"(?:[(\[{]at[)\]}]|\x20at\x20\x20?[A-Za-z0-9-]++\x20?(?:\.[A-Za-z0-9]|[(\[{]dot|\x20dot\x20)|@)",
    ),
    (
        "phone",
        r"(?<![0-9A-Za-z.,+-])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])(?:[0-9]{2,4}[\x20.-]){1,3}[0-9]{2,4}(?![0-9A-Za-z-])",
        r"[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-]",
    ),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{2,6}){2,4}(?![0-9])", r"[0-9]{4}[\x20._/-]{1,3}[0-9]{2,6}[\x20._/-]"),
    ("ip", r"(?<![0-9])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}){3}(?![0-9])", r"[0-9]\x20?[\[(](?:\.|dot)[\])]"),
]

# fixed values: words that announce a kind of personal data
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|reach|write)",
    "ip": r"(?i)(?:\bip\b|address|host|server|addr)",
    "card": r"(?i)(?:card|visa|mastercard|amex|pay|cc\b)",
    "phone": r"(?i)(?:phone|call|tel|fax|mobile|cell|dial|sms)",
}
ANTI = r"(?i)(?:isbn|order|invoice|version|\bv\b|serial|part|ref|page|vol|date|no\.|#)"
CONTEXT = 24
#: Spelled-out or bracketed separators, and a bare dot beside a blank, as at a sentence's end.
MARKS, OPEN_DOT = r"[(\[{](?:at|dot|\.)[)\]}]|\x20dot\x20", r"\x20\.|\.\x20"
FEATURES = ["kind", "digits", "groups", "longest", "shortest", "luhn", "octets", "cue", "anti", "seps", "paren", "first", "length", "word_after", "marks", "open_dot"]


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column, most: int = 19) -> Column:
    """Whether the Luhn sum of ``digits`` (``most`` or fewer) is a multiple of ten."""

    def total(d: Column) -> Column:
        out = F.lit(0)
        for k in range(1, most + 1):  # k-th digit from the right; leading zeros add nothing
            x = F.ascii(F.substring(d, most - k + 1, 1)) - 48
            out = out + (x if k % 2 else 2 * x - F.when(x > 4, 9).otherwise(0))
        return out % 10 == 0

    return let(F.lpad(digits, most, "0"), total)


def _small(p: Column) -> Column:
    """The number ``p``, or 999 if it has more than three digits after leading zeros."""
    bare = F.ltrim(p, F.lit("0"))
    return F.when(F.length(bare) > 3, F.lit(999)).otherwise(F.coalesce(bare.try_cast("int"), F.lit(0)))


def base(text: Column) -> Column:
    """email, ip, card and phone spans of ``text`` as the contract states them."""
    email = sp.find(text, EMAIL, "email", F.contains(text, F.lit("@")))
    ip = sp.find(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"))
    ip = F.filter(ip, lambda x: F.forall(F.split(x["s"], r"\."), lambda p: _small(p) <= 255))
    card = sp.find(text, CARD, "card", text.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"))
    card = F.filter(
        card,
        lambda x: let(digits_of(x["s"]), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))),
    )
    phone = sp.find(text, PHONE, "phone", text.rlike(r"\+[0-9]"))
    phone = F.filter(phone, lambda x: F.length(digits_of(x["s"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def features(text: Column, x: Column) -> dict[str, Column]:
    """The features of proposal ``x`` in ``text``, in the order of FEATURES."""
    s = x["s"]
    before = F.substring(text, F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(F.lit(CONTEXT), x["start"]))
    after = F.substring(text, x["stop"] + 1, F.lit(1))
    groups = F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))
    digits = digits_of(s)
    cue, kind = F.lit(False), F.lit(0)
    for i, k in enumerate(KINDS):
        cue = F.when(x["kind"] == k, before.rlike(CUES[k])).otherwise(cue)
        kind = F.when(x["kind"] == k, F.lit(i)).otherwise(kind)
    sizes = F.transform(groups, lambda g: F.length(g))
    return {
        "kind": kind,
        "digits": F.length(digits),
        "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "luhn": F.when(F.length(digits).between(12, 19), luhn(digits).cast("int")).otherwise(0),
        "octets": F.forall(groups, lambda p: _small(p) <= 255).cast("int"),
        "cue": cue.cast("int"),
        "anti": before.rlike(ANTI).cast("int"),
        "seps": F.length(F.regexp_replace(s, "[A-Za-z0-9]", "")),
        "paren": s.rlike(r"[(\[{]").cast("int"),
        "first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)),
        "length": F.length(s),
        "word_after": after.rlike(r"[A-Za-z0-9]").cast("int"),
        "marks": F.size(F.regexp_extract_all(s, F.lit(MARKS), F.lit(0))),
        "open_dot": s.rlike(OPEN_DOT).cast("int"),
    }


def features_of(kind: str, s: str, before: str, after: str) -> list[float]:
    """The same features of one generated row, for training."""
    groups = re.findall("[0-9]+", s)
    sizes, d = [len(g) for g in groups], "".join(groups)
    total = sum(int(c) if k % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for k, c in enumerate(reversed(d)))
    before = before[-CONTEXT:]
    return [
        KINDS.index(kind),
        len(d),
        len(groups),
        max(sizes, default=0),
        min(sizes, default=0),
        float(12 <= len(d) <= 19 and total % 10 == 0),
        float(all(int(g) <= 255 for g in groups)),
        float(bool(re.search(CUES[kind], before))),
        float(bool(re.search(ANTI, before))),
        len(re.sub("[A-Za-z0-9]", "", s)),
        float(bool(re.search(r"[(\[{]", s))),
        sizes[0] if sizes else 0,
        len(s),
        float(bool(re.match("[A-Za-z0-9]", after))),
        len(re.findall(MARKS, s)),
        float(bool(re.search(OPEN_DOT, s))),
    ]


def _luhn_complete(head: str) -> str:
    total = sum(2 * int(c) - 9 * (int(c) > 4) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(head)))
    return head + str(-total % 10)


def generated_rows(n: int = TRAIN_ROWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Seeded proposals with labels: personal data in the generators' formats, and look-alikes."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8)))
    filler = lambda: " ".join(word() for _ in range(4)) + " "
    cues = {
        "email": ["email: ", "mail me at ", "contact ", "reach us: "],
        "ip": ["host ", "server at ", "ip: ", "address "],
        "card": ["card: ", "visa ", "paid with card ", "cc "],
        "phone": ["phone: ", "call ", "tel. ", "fax: ", "mobile "],
    }
    antis = ["order ", "isbn ", "invoice no. ", "version ", "serial ", "part ", "date: ", "ref "]

    def one(kind: str, good: bool) -> tuple[str, str]:
        cue = r.choice(cues[kind]) if r.random() < (0.6 if good else 0.1) else filler()
        if not good and r.random() < 0.6:
            cue = r.choice(antis)
        if kind == "email":
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), ("{at}", "{dot}"), ("[at]", ".")])
            if good:
                return f"{word()}{r.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}", cue
            return r.choice([f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{num(2)}", f"{word()}@ {word()}.{word()}"]), filler()
        if kind == "ip":
            dot = r.choice(["[.]", "(.)", "[dot]"])
            top = 255 if good else 999
            parts = [str(r.randint(0, 255) if good else r.randint(200, top)) for _ in range(4)]
            return dot.join(parts), cue
        if kind == "card":
            d = _luhn_complete(r.choice("3456") + num(14)) if good else num(16)
            sep = r.choice([" ", "-", ".", "/", "_", " - "])
            return sep.join(d[i : i + 4] for i in range(0, 16, 4)), cue
        if good:
            a, b, c = num(3), num(3), num(4)
            return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"0{a}-{b}-{c}"]), cue
        return (
            r.choice(
                [
                    f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(4)} {num(4)} {num(4)}", f"{num(2)}.{num(3)}.{num(3)}",
                    f"{num(4)}-{num(4)}-{num(3)}", f"{num(3)} {num(2)} {num(4)}", f"{num(2)}-{num(2)}-{num(2)}", f"{num(4)} {num(2)} {num(2)} {num(2)}",
                    f"{num(3)}-{num(2)}-{num(2)}-{num(2)}",
                ]
            ),
            cue,
        )

    rows, labels = [], []
    for kind, hit, before, after in _prose_hits(r, n // 2):
        rows.append(features_of(kind, hit, before, after))
        labels.append(0.0)
    for i in range(n):
        kind, good = KINDS[i % 4], r.random() < 0.5
        s, before = one(kind, good)
        rows.append(features_of(kind, s, before, r.choice([" ", ".", ",", " ", "\n", "x" if not good else " "])))
        labels.append(float(good))
    return np.array(rows, dtype=float), np.array(labels)


def _prose_hits(r: random.Random, n: int):
    """Up to ``n`` hits of the generators in seeded sentences without personal data: hard look-alikes."""
    found = []
    for _ in range(20 * n):
        words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(1, 9))) for _ in range(12)]
        for at in r.sample(range(12), 3):
            words[at] = r.choice(["at", "at", "dot", str(r.randint(0, 9999)), str(r.randint(0, 99)), words[at].capitalize()])
        for at in r.sample(range(11), 4):
            words[at] += r.choice([".", ".", ",", "?", "-", "\n"])
        text = " ".join(words)
        # one with both separators spelled out is a mail address for all that can be seen
        found += [(kind, m[0], text[: m.start()], text[m.end() :]) for kind, pattern, _ in GENERATORS for m in re.finditer(pattern, text) if not (" at " in m[0] and " dot " in m[0])]
        if len(found) >= n:
            break
    return found[:n]


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, cut, left, right), or a leaf's value."""
    leaf = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 20:
        return leaf
    best, split = 1e-6, None
    base_gain = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1][:40]:
            left = x[:, f] <= cut
            gl, hl = g[left].sum(), h[left].sum()
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - base_gain
            if gain > best:
                best, split = gain, (f, float(cut), left)
    if split is None:
        return leaf
    f, cut, left = split
    return (f, cut, _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _value(left, x), _value(right, x))


@functools.cache
def model() -> dict:
    """Trees, calibration (a, b) and a threshold for each kind."""
    x, y = generated_rows()
    fit = np.arange(len(y)) % 3 != 0
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x[fit], (p - y)[fit], (p * (1 - p))[fit], DEPTH)
        trees.append(tree)
        score += RATE * _value(tree, x)
    a, b = 1.0, 0.0
    held, label = score[~fit], y[~fit]
    for _ in range(300):  # logistic calibration by gradient steps
        p = 1 / (1 + np.exp(-(a * held + b)))
        a -= 0.1 * ((p - label) * held).mean()
        b -= 0.1 * (p - label).mean()
    prob = 1 / (1 + np.exp(-(a * held + b)))
    cuts = {}
    for i, kind in enumerate(KINDS):
        mine = x[~fit][:, 0] == i
        cuts[kind] = 0.99
        for t in np.arange(0.5, 0.99, 0.01):
            chosen = mine & (prob >= t)
            if chosen.any() and label[chosen].mean() >= PRECISION:
                cuts[kind] = float(round(t, 2))
                break
    return {"trees": trees, "a": float(a), "b": float(b), "cuts": cuts}


def _compiled(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    k, cut, left, right = tree
    return F.when(f[FEATURES[k]] <= cut, _compiled(left, f)).otherwise(_compiled(right, f))


def probability(f: Column) -> Column:
    """Calibrated probability of the feature struct ``f``, the trees as CASE expressions."""
    m = model()
    total = F.lit(0.0)
    for tree in m["trees"]:
        total = total + RATE * _compiled(tree, f)
    return 1 / (1 + F.exp(-(m["a"] * total + m["b"])))


def proposals(text: Column) -> Column:
    found = [sp.find(text, pattern, kind, text.rlike(test)) for kind, pattern, test in GENERATORS]
    return F.concat(*found)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_spans`` (base and added), sorted by start and kind; columns of those names are replaced."""
    cuts = model()["cuts"]
    # the row is packed, so columns of any name stay apart from those made here
    step = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # without a digit, an @ or a bracketed or spelled-out "at" nothing can match
    some = F.col("_t").rlike(r"[0-9@]|[(\[{]at[)\]}]|\x20at\x20[^\n]{1,40}?\x20dot\x20")
    step = step.withColumn("_b", F.when(some, base(F.col("_t"))).otherwise(sp.none()))

    def scored(x: Column) -> Column:
        f = F.struct(*[v.cast("double").alias(k) for k, v in features(F.col("_t"), x).items()])
        return let(f, lambda f: F.struct(probability(f).alias("p"), x.alias("x")))

    def enough(e: Column) -> Column:
        cut = F.lit(1.0)
        for kind, least in cuts.items():
            cut = F.when(e["x"]["kind"] == kind, F.lit(least)).otherwise(cut)
        return e["p"] >= cut

    better = let(F.filter(F.transform(proposals(F.col("_t")), scored), enough), lambda f: sp.chosen(f, F.col("_b")))
    step = step.withColumn("_m", F.when(some, better).otherwise(sp.none()))
    return step.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("_base", "_spans")],
        sp.ordered(F.col("_b"), KINDS).alias("_base"),
        sp.ordered(F.concat("_b", "_m"), KINDS).alias("_spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_redacted``: the text with every span replaced by its kind."""
    found = detect(docs, text)
    return found.withColumn("_redacted", sp.redacted(F.coalesce(F.col(text), F.lit("")), F.col("_spans")))


def op1_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[sp.count(F.col("_base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(sp.joined(F.col("_base")), 256).alias("base_sha256"),
        sp.joined(F.col("_spans")).alias("spans"),
    )
