"""Soft-membership mixing to target weights.

A classifier learned from the labelled table (documents in ``labels``, with
their language as domain) gives every document, labelled or not, posterior
probabilities over the domains. Document rates r >= 0 are then fitted so that
the expected domain totals sum_i r_i * n_i * p_i match the targets, n_i being a
document's words: projected gradient on the least squares of the totals, in the
metric that weighs a document's change by its words and with the Gram matrix of
the documents off the bound as preconditioner. A rate is a fold over the few directions so far, so an
iteration is one aggregation and its state is a handful of numbers.

The classifier is multinomial naive Bayes on counts of letter groups; its
statistics are sums over all labelled rows. The groups are learned too: single
letters and pairs that are much more frequent in one domain than in the others,
found on a bounded sample, about SAMPLE labelled texts a domain by a seeded
hash of the id, so no language or script is built in. The default total is the least one
that cuts no domain ("cover"), so documents are repeated rather than lost;
``total`` may fix it instead. Whole copies come from a seeded hash of the id.

Native: the driver only solves systems as large as the number of domains. Null
and blank texts weigh 0 words and keep the base rate. A domain without a target
keeps its share; a target without a labelled row is dropped; without labelled
rows every rate is 1. Repeated rows each get the same rate.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm.common import BLANKS, checkpointed, once, table

TARGETS = {"en": 0.50, "de": 0.20, "fr": 0.18, "es": 0.12}
# letter groups: how many at least and for each domain, the sampled texts a domain, and the least share of a domain's groups
GROUPS, GROUPS_A_DOMAIN, SAMPLE, RARE = 20, 2, 200, 1e-3
MAX_DOMAINS, ITERATIONS, TOLERANCE = 64, 16, 1e-6
TEMPER, SEED = 0.2, 17


def _uniform(seed: int) -> Column:
    """A number in [0, 1) from the id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.where("domain is not null").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")


def groups(docs: DataFrame, labels: DataFrame) -> list[str]:
    """The letter groups to count, learned from ``docs`` (doc_id, domain, text) that are in ``labels``; none without any.

    What comes to the driver is bounded: 1 / RARE groups a domain can have a share of RARE.
    """
    known = _labelled(docs.select("doc_id", "domain"), labels)
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not sizes:
        return []
    share = F.lit(0.0)
    for domain, n in sorted(sizes.items()):
        share = F.when(F.col("domain") == domain, min(1.0, SAMPLE / n)).otherwise(share)
    # about SAMPLE ids for each of MAX_DOMAINS domains at most; texts stay where they are
    picked = F.broadcast(known.where(_uniform(SEED + 1) < share).select("doc_id").distinct())
    letters = F.split(F.lower("text"), "")
    sampled = docs.where("domain is not null").join(picked, "doc_id", "left_semi").select("domain", once(letters).alias("_l"))
    pairs = F.transform("_l", lambda x, i: F.concat(x, F.coalesce(F.get(F.col("_l"), i + 1), F.lit(""))))
    seen = sampled.select("domain", F.explode(F.concat("_l", pairs)).alias("g")).where(F.col("g").rlike(r"^\p{L}+$"))
    counts = checkpointed(seen.groupBy("domain", "g").agg(F.count("*").alias("n")))
    whole = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    least = F.lit(None).cast("double")
    for domain, n in sorted(whole.items()):
        least = F.when(F.col("domain") == domain, RARE * n).otherwise(least)
    p: dict[str, dict[str, float]] = {domain: {} for domain in whole}
    for r in counts.where(F.col("n") >= least).collect():
        p[r["domain"]][r["g"]] = r["n"] / whole[r["domain"]]

    def gain(domain: str, g: str) -> float:
        rest = [q.get(g, 0.0) for other, q in p.items() if other != domain]
        return p[domain][g] * math.log(p[domain][g] / max(RARE / 4, sum(rest) / max(1, len(rest))))

    ranked = {domain: sorted(q, key=lambda g: (-gain(domain, g), g)) for domain, q in p.items()}
    chosen: list[str] = []
    for k in range(max(map(len, ranked.values()), default=0)):
        for domain in sorted(ranked):
            if len(chosen) >= max(GROUPS, GROUPS_A_DOMAIN * len(ranked)):
                return chosen
            # no group inside another, or the same letters would be counted twice
            if k < len(ranked[domain]) and not any(ranked[domain][k] in g or g in ranked[domain][k] for g in chosen):
                chosen.append(ranked[domain][k])
    return chosen


def _counts(low: Column, found: list[str]) -> Column:
    """Occurrences of each group in lower-cased text, each in what the groups before it left, and the letters left over.

    Taking the groups out in turn reads a shorter text each time, and no letter counts twice.
    """
    start = F.struct(low.alias("t"), F.array().cast("array<int>").alias("n"))
    size = lambda left: F.concat(left["n"], F.array(F.octet_length(left["t"])))

    def close(left: Column) -> Column:
        n = [left["n"][k] for k in range(len(found))] + [F.octet_length(left["t"])]
        hits = [F.floor((a - b) / len(g.encode())).cast("int") for a, b, g in zip(n, n[1:], found, strict=False)]
        return F.array(*hits, F.length(left["t"]))

    take = lambda left, g: F.struct(F.replace(left["t"], g, F.lit("")).alias("t"), size(left).alias("n"))
    return F.aggregate(F.array(*map(F.lit, found)).cast("array<string>"), start, take, close)


def _words(text: Column) -> Column:
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def features(docs: DataFrame, keep: list[str], found: list[str]) -> DataFrame:
    """``keep`` of every row with ``_n`` (words) and ``_c`` (counts); narrow, so what follows needs no texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = once(F.lower(text))
    lowered = docs.select(*[F.col(f"`{c}`") for c in keep], _words(text).alias("_n"), low.alias("_low"))
    return lowered.select(*[F.col(f"`{c}`") for c in keep], "_n", once(_counts(F.col("_low"), found)).alias("_c"))


def learn(labelled: DataFrame) -> dict | None:
    """Naive Bayes of (domain, _c) rows, or None without any."""
    sums = labelled.where("domain is not null")
    # the counts are as long in every row
    first = sums.select(F.size("_c")).first()
    width = first[0] if first else 0
    rows = sums.groupBy("domain").agg(F.count("*").alias("n"), *[F.sum(F.col("_c")[i]).alias(f"c{i}") for i in range(width)])
    rows = sorted(rows.limit(MAX_DOMAINS + 1).collect(), key=lambda r: r["domain"])
    if len(rows) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    if not rows:
        return None
    c = np.array([[r[f"c{i}"] for i in range(width)] for r in rows], dtype=float) + 1
    n = np.array([r["n"] for r in rows], dtype=float)
    return {"domains": [r["domain"] for r in rows], "prior": np.log(n / n.sum()), "log": np.log(c / c.sum(axis=1, keepdims=True))}


def posterior(model: dict, counts: Column) -> Column:
    """Array of domain probabilities. TEMPER times the log likelihood: letters of a text aren't independent."""
    raw = [F.lit(float(a)) + TEMPER * sum((float(w) * counts[i] for i, w in enumerate(row)), F.lit(0.0)) for a, row in zip(model["prior"], model["log"], strict=True)]

    def soft(s: Column) -> Column:
        e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        return F.transform(F.array(e), lambda v: F.transform(v, lambda x: x / F.aggregate(v, F.lit(0.0), lambda a, b: a + b)))[0]

    return F.transform(F.array(F.array(*raw)), soft)[0]


def rate(directions: list[np.ndarray], start: float, p: Column) -> Column:
    """The rate after the projected steps so far, each max(0, r + p . w)."""
    r = F.lit(float(start))
    for w in directions:
        r = F.greatest(F.lit(0.0), r + sum((float(x) * p[i] for i, x in enumerate(w)), F.lit(0.0)))
    return r


def fit(weighted: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None) -> dict:
    """Directions and start rate for ``weighted`` (_n, _p), whose rows are read once for each iteration."""
    d = len(domains)

    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def measure(directions: list[np.ndarray], start: float) -> tuple[np.ndarray, np.ndarray]:
        """Totals at the rates so far, and the Gram matrix of the rows whose rate isn't 0: those that a step can move freely."""
        rows = weighted.select("_n", "_p", once(rate(directions, start, F.col("_p"))).alias("_r"))
        free = F.when(F.col("_r") > 0, F.col("_n"))
        sums = [F.sum(F.col("_n") * F.col("_r") * F.col("_p")[i]) for i in range(d)]
        sums += [F.sum(free * F.col("_p")[i] * F.col("_p")[j]) for i, j in pairs]
        row = [x or 0.0 for x in rows.agg(*[x.alias(f"x{k}") for k, x in enumerate(sums)]).first()]
        gram = np.zeros((d, d))
        for (i, j), x in zip(pairs, row[d:], strict=True):
            gram[i, j] = gram[j, i] = x
        return np.array(row[:d]), gram

    now, gram = measure([], 1.0)
    if now.sum() <= 0:
        return {"start": 1.0, "directions": [], "wanted": now, "reached": now}
    share = now / now.sum()
    aim = np.array([targets.get(x, -1.0) for x in domains])
    free = share[aim < 0].sum()
    given = aim[aim >= 0].sum()
    aim = np.where(aim < 0, share, aim * ((1 - free) / given if given > 0 else 0))
    if total is None:  # the least total at which no domain shrinks
        total = max(now[i] / aim[i] for i in range(d) if aim[i] > 0)
    wanted, start, directions = aim * total, float(total / now.sum()), []
    reached = now * start
    for _ in range(ITERATIONS):
        if np.abs(reached - wanted).max() <= TOLERANCE * total:
            break
        directions.append(np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ (wanted - reached))
        reached, gram = measure(directions, start)
    return {"start": start, "directions": directions, "wanted": wanted, "reached": reached}


def mix(feats: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None):
    """Fit rates and return a function that gives rows with doc_id, _n and _c their _p, _domain, _rate and _copies.

    feats: doc_id, domain (known for labelled rows), _n, _c; labels: doc_id of the labelled rows.
    """
    model = learn(_labelled(feats, labels))
    if model is None:
        one = {"_p": F.array().cast("array<double>"), "_domain": F.lit(None).cast("string"), "_rate": F.lit(1.0), "_copies": F.lit(1)}
        return lambda rows: rows.withColumns(one)
    # read once for each iteration
    found = fit(checkpointed(feats.select("_n", posterior(model, F.col("_c")).alias("_p"))), model["domains"], TARGETS if targets is None else targets, total)
    names = F.array(*[F.lit(x) for x in model["domains"]])

    def apply(rows: DataFrame) -> DataFrame:
        r = F.when(F.col("_n") > 0, rate(found["directions"], found["start"], F.col("_p"))).otherwise(F.lit(found["start"]))
        out = rows.withColumn("_p", once(posterior(model, F.col("_c")))).withColumn("_rate", once(r))
        out = out.withColumn("_domain", F.get(names, F.array_position("_p", F.array_max("_p")).cast("int") - 1))
        # a rate just below a whole number counts as that number, so "cover" drops nothing
        whole = F.floor(F.col("_rate") + 1e-3)
        return out.withColumn("_copies", once((whole + (_uniform(SEED) < F.col("_rate") - whole).cast("int")).cast("int")))

    return apply


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels")


def op5_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.col("lang").alias("domain"))
    labels = _labels(spark, sf_dir)
    feats = checkpointed(features(docs, ["doc_id", "domain", "source"], groups(docs, labels)))
    mixed = mix(feats, labels)(feats)
    return mixed.select(
        "doc_id",
        "source",
        F.col("_n").alias("n_words"),
        F.col("_domain").alias("domain"),
        F.round(F.array_max("_p"), 6).alias("domain_probability"),
        F.round("_rate", 6).alias("rate"),
        F.col("_copies").alias("copies"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row of ``docs`` as often as its copies say."""
    named, labels = docs.select("doc_id", F.col("lang").alias("domain"), "text"), _labels(spark, sf_dir)
    found = groups(named, labels)
    feats = checkpointed(features(named, ["doc_id", "domain"], found))
    apply = mix(feats, labels)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("text"))
    mixed = apply(features(rows, ["_row", "doc_id"], found)).where("_copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


assert math.isclose(sum(TARGETS.values()), 1.0)
